import random

from pyspark.sql import functions as F

from netshield.operators.blockops import LISTED, apply_commands
from netshield.options import Options
from netshield.session import work_dir
from netshield.streaming.blockops import LiveBlocklist

OPTIONS = Options(block_seconds=30)
SCHEMA = "seq long, op string, ip string, us long"


def commands(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_micros("us"))


def walked(rows, listed=None):
    """One command after the other: answers, and what is listed in the end."""
    held, answers = dict(listed or {}), []
    for seq, op, ip, us in sorted((r for r in rows if r[3] is not None), key=lambda r: (r[3], -1 if r[0] is None else r[0])):
        number = -1 if seq is None else seq
        if op == "clear":
            held = {}
        elif op == "purge":
            held = {k: v for k, v in held.items() if v[0] > us - 30_000_000}
        elif ip is None:
            continue
        elif op == "add":
            held[ip] = (us, number)
        elif op == "remove":
            held.pop(ip, None)
        elif op == "contains":
            answers.append((number, ip, us, ip in held))
    return sorted(answers), held


def random_commands(seed, n, start=0, ips="abcd"):
    rng = random.Random(seed)
    kinds = ["add"] * 6 + ["remove"] * 3 + ["contains"] * 12 + ["purge"] * 2 + ["clear", "unknown"]
    rows = [(k, rng.choice(kinds), rng.choice([*ips, None]), start + rng.choice([rng.randrange(200), rng.randrange(200)]) * 1_000_000
             + rng.choice([0, 0, 1, 500_000])) for k in range(n)]
    return rows + [(None, "add", "a", start + 5), (n, "contains", "a", None), (n + 1, None, "a", start + 7)]


def got_answers(df):
    return sorted((r["seq"], r["ip"], r["us"], r["is_blocked"]) for r in df.withColumn("us", F.unix_micros("ts")).collect())


def got_list(df):
    return {r["ip"]: (r["us"], r["seq"]) for r in df.withColumn("us", F.unix_micros("ts")).collect()}


def test_against_a_walk(spark):
    none = spark.createDataFrame([], LISTED)
    for seed, n in ((1, 400), (2, 60)):
        rows = random_commands(seed, n)
        answers, after = apply_commands(commands(spark, rows), none, OPTIONS)
        want_answers, want_held = walked(rows)
        assert got_answers(answers) == want_answers and got_list(after) == want_held


def test_one_hot_address_and_no_commands(spark):
    none = spark.createDataFrame([], LISTED)
    rows = [(k, ("contains", "add", "contains", "remove")[k * 7 % 4], "hot", k * 3_000) for k in range(4000)]
    answers, after = apply_commands(commands(spark, rows), none, OPTIONS)
    want_answers, want_held = walked(rows)
    assert got_answers(answers) == want_answers and got_list(after) == want_held
    answers, after = apply_commands(commands(spark, []), none, OPTIONS)
    assert answers.count() == after.count() == 0


def test_batches_with_an_initial_list(spark):
    """Batch after batch, one of them twice, is the same as one walk from the list at the start."""
    start = {"a": (-20_000_000, 3), "z": (-40_000_000, 4)}
    listed = spark.createDataFrame([(ip, us, seq) for ip, (us, seq) in start.items()], "ip string, us long, seq long").withColumn(
        "ts", F.timestamp_micros("us"))
    live, every = LiveBlocklist(work_dir(spark, "test"), listed, OPTIONS), []
    for k in range(3):
        rows = random_commands(10 + k, 80, start=k * 300_000_000, ips="abz")
        every += rows
        for _ in range(1 + (k == 1)):
            live.handle(commands(spark, rows).drop("us"), k)
        want_answers, want_held = walked(every, start)
        assert got_list(live.entries(spark)) == want_held
    assert got_answers(spark.read.parquet(f"{live.out}/answers").drop("batch_id")) == want_answers
