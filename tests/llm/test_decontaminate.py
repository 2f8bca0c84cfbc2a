import random

import numpy as np
import pytest

from netshield.llm import decontaminate as D
from netshield.llm.queries import op5_decontamination


def norm(text):
    return " ".join("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split())


def fewest(probe, text):
    """Edits of the probe against its best region, by the full table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(probe, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def brute(text, bench):
    out = set()
    for item, t in bench:
        t = norm(t)
        if item is None or len(t) < D.SHORTEST:
            continue
        last = max(0, len(t) - D.PROBE)
        for s in {*range(0, last, D.PROBE // 2), last}:
            probe = t[s:s + D.PROBE]
            if fewest(probe, norm(text)) <= int(D.EDITS * len(probe)):
                out.add(item)
    return sorted(out)


def spoiled(rng, text, edits):
    text = list(text)
    for _ in range(edits):
        k = rng.randrange(len(text))
        text[k:k + 1] = rng.choice([[], [rng.choice("abc")], [text[k], "x"]])
    return "".join(text)


@pytest.mark.parametrize("index_bytes", [D.INDEX_BYTES, 300])
def test_matches_full_tables(spark, index_bytes):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["th", "an", "er", "on", "É", "re"]) for _ in range(rng.randint(1, 4)))
    words = lambda n: " ".join(word() for _ in range(n))
    bench = [(i, words(rng.choice([4, 9, 20, 45]))) for i in range(14)] + [(20, ""), (21, None), (None, words(20)), (22, "short")]
    docs = [None, "", "x", words(60)]
    for item, text in bench[:14]:
        for edits in (0, len(text) // 12, len(text) // 9, len(text) // 7):
            docs.append(words(rng.choice([0, 5])) + " \n\t" + spoiled(rng, text.upper().replace("É", "É"), edits) + "  " + words(5))
        docs.append(text[:len(text) // 2])
        docs.append(text[5:] + " " + words(200) + text)
    df = spark.createDataFrame([(i, d, 1) for i, d in enumerate(docs)], "doc_id long, text string, leaks int")
    b = spark.createDataFrame(bench, "item_id long, text string")
    rows = D.search(df.union(df.limit(3)), b, index_bytes=index_bytes).collect()
    assert len(rows) == len(docs) + 3
    for r in rows:
        assert [x.item_id for x in r.leaks] == brute(r.text, bench), r.doc_id
        for x in r.leaks:
            assert 0 <= x.start < x.end <= len(r.text)


def test_region(spark):
    text = "Some  words before.\nThe quick brown fox jumps over the lazy dog and runs away.  After."
    item = "the quick brown fox jumps over the lazy dog and runs away."
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    b = spark.createDataFrame([(7, item)], "item_id long, text string")
    (leak,) = D.search(df, b).first().leaks
    assert text[leak.start:leak.end].lower() == item and leak.edits == 0 and leak.item_id == 7


def test_empty(spark):
    df = spark.createDataFrame([(1, "text " * 30)], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert D.search(df, b).first().leaks == []
    assert D.search(df.limit(0), b).collect() == []


def test_long_text():
    rng = np.random.default_rng(1)
    text = "".join(rng.choice(list("abcdefgh "), 300_000))
    index = D.Index.build([(1, text[200_000:200_150])])
    ((_, start, end, edits),) = index.matches(text)
    assert edits == 0 and 200_000 <= start < end <= 200_151


def test_query(spark, sf_dir):
    bench = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op5_decontamination(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        whole = {i for i, t in bench if norm(t) in norm(docs[r.doc_id])}
        assert whole <= set(r.items) and r.contaminated == bool(r.items)


@pytest.mark.parametrize("size, edits", [(100, 11), (100, 12), (50, 6)])
def test_edit_share(size, edits):
    """A passage with 12 % of its characters changed is found."""
    rng = random.Random(7)
    item = "".join(rng.choice("abcdefghijklm ") for _ in range(size)).replace("  ", "xy").strip().ljust(size, "z")
    text = list(item)
    for k in range(edits):
        text[(2 * k + 1) * size // (2 * edits)] = "#"
    around = "".join(rng.choice("nopqrstuvw ") for _ in range(400))
    ((found, _, _, least),) = D.Index.build([(5, item)]).matches(around + " " + "".join(text) + " " + around)
    assert found == 0 and least == edits


@pytest.mark.parametrize("start, size", [(20, 100), (25, 100), (77, 110), (125, 120), (294, 100)])
def test_fragments_off_the_grid(start, size):
    """Characters of a longer item in a row are found wherever they start."""
    rng = random.Random(8)
    other = lambda n: "".join(rng.choice("nopqrstuvw ") for _ in range(n))
    item = "".join(rng.choice("abcdefghijklm") for _ in range(394))
    text = other(300) + item[start:start + size] + other(300)
    index = D.Index.build([(1, other(200)), (2, item), (3, "z" + item[5:])])
    for (number, begin, end, edits), want in zip(index.matches(text), (1, 2), strict=True):
        assert (number, edits) == (want, 0)
        assert text[begin:end] == item[start:start + size]


def test_one_index_at_a_time(spark, monkeypatch):
    """A pass writes its result before the next index is built."""
    events, build, settle = [], D.Index.build, D.settle
    monkeypatch.setattr(D.Index, "build", lambda rows: events.append("build") or build(rows))
    monkeypatch.setattr(D, "settle", lambda df, label: events.append(label) or settle(df, label))
    items = [(i, f"item number {i * 7919} of a benchmark with its own words {i * 104729}") for i in range(6)]
    df = spark.createDataFrame([(7, None, "r"), (8, items[2][1] + " and " + items[5][1], "s"), (8, "clean", "t")],
                               "found long, text string, row string")
    rows = D.search(df, spark.createDataFrame(items, "item_id long, text string"), index_bytes=150).collect()
    assert sorted((r.found, r.row, [x.item_id for x in r.leaks]) for r in rows) == [(7, "r", []), (8, "s", [2, 5]), (8, "t", [])]
    built = [e for e in events if e in ("build", "leaks")]
    assert len(built) > 2 and built == ["build", "leaks"] * (len(built) // 2)
