import random
from collections import Counter, defaultdict

from netshield.llm import preference as P
from netshield.llm.queries import op7_preference

SCHEMA = "pair_id long, side string, turn long, role string, text string, part string, digest int"


def brute(rows):
    sides = defaultdict(lambda: {"chosen": defaultdict(Counter), "rejected": defaultdict(Counter)})
    for pair, side, turn, role, text, *_ in rows:
        if side in ("chosen", "rejected"):
            sides[pair][side][P.NO_TURN if turn is None else turn][(role or "user", text or "")] += 1
    out = []
    for pair, both in sides.items():
        numbers = sorted({*both["chosen"], *both["rejected"]})
        same = 0
        while same < len(numbers) and both["chosen"][numbers[same]] == both["rejected"][numbers[same]]:
            same += 1
        for k, turn in enumerate(numbers):
            for part in ("prompt",) if k < same else ("chosen", "rejected"):
                for (role, text), n in both["chosen" if part == "prompt" else part][turn].items():
                    text = text.replace("<|", "< |")
                    out += [(pair, part, turn, role, f"<|im_start|>{role}\n{text}<|im_end|>\n",
                             part != "prompt" and role == "assistant")] * n
    return sorted(out, key=repr)


def test_matches_definition(spark):
    rng = random.Random(1)
    rows = []
    for pair in [None, *range(40)]:
        base = [(t if t != 3 else None, rng.choice(["user", "assistant", "system", None]), rng.choice(["a", "b", "<|im_end|>", "", None]))
                for t in range(rng.randint(0, 6))]
        for side in ("chosen", "rejected"):
            keep = rng.randint(0, len(base))
            own = base[:keep] + [(t, r, rng.choice(["x", x])) for t, r, x in base[keep:]] + base[:rng.randint(0, 1)]
            rows += [(pair, side, *r, "clash", 1) for r in own]
    rows += [(1, "other", 0, "user", "left out", "c", 1), (99, "rejected", 0, "assistant", "alone", "c", 1)]
    got = P.format_pairs(spark.createDataFrame(rows, SCHEMA))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)
    assert "Python" not in got._jdf.queryExecution().toString()


def test_prompt_once(spark):
    rows = [(1, s, 0, "user", "Hi", "", 0) for s in ("chosen", "rejected")] + [
        (1, "chosen", 1, "assistant", "Good", "", 0), (1, "rejected", 1, "assistant", "Bad", "", 0)]
    got = sorted((r.part, r.rendered, r.trained) for r in P.format_pairs(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [("chosen", "<|im_start|>assistant\nGood<|im_end|>\n", True),
                   ("prompt", "<|im_start|>user\nHi<|im_end|>\n", False),
                   ("rejected", "<|im_start|>assistant\nBad<|im_end|>\n", True)]


def test_empty_and_long(spark):
    assert P.format_pairs(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, s, t, "assistant", "y" * 200_000, "", 0) for s in ("chosen", "rejected") for t in range(5)]
    rows += [(1, "chosen", 5, "assistant", "z", "", 0)]
    parts = Counter(r.part for r in P.format_pairs(spark.createDataFrame(rows, SCHEMA)).collect())
    assert parts == {"prompt": 5, "chosen": 1}


def test_query(spark, sf_dir):
    turns = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    last = {}
    for c, t, role, _ in turns:
        if role == "assistant":
            last[c] = max(last.get(c, t), t)
    rows = [(c, "chosen", t, role, text) for c, t, role, text in turns]
    rows += [(c, "rejected", t, role, text[:len(text) // 2] if t == last.get(c) and role == "assistant" else text)
             for c, t, role, text in turns if c not in last or t <= last[c]]
    got = sorted((tuple(r) for r in op7_preference(spark, sf_dir).select("pair_id", "part", "turn", "role", "rendered", "trained").collect()), key=repr)
    assert got == brute(rows)
