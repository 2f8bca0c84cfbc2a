import random

import numpy as np
import pytest

from netshield.llm import minhash
from netshield.llm.components import components
from netshield.llm.queries import op4_minhash


def brute(rows, words, share=80):
    """(doc_id, n, component, kept) from the definition, all pairs compared."""
    sets = []
    for _, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for c in "\t\n\x0b\x0c\r":
            low = low.replace(c, " ")
        found = [w for w in low.split(" ") if w]
        sets.append({tuple(found[i:i + words]) for i in range(max(1, len(found) - words + 1))} if found else set())
    ids = [r[0] for r in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            x, y = sets[i], sets[j]
            if ids[i] is not None and ids[j] is not None and x and y and 100 * len(x & y) >= share * len(x | y):
                parent[root(i)] = root(j)
    low = {}
    for i, d in enumerate(ids):
        if d is not None:
            low[root(i)] = min(low.get(root(i), d), d)
    return sorted(((d, len(s), low.get(root(i)) if d is not None else None,
                    True if d is None else low[root(i)] == d)
                   for i, (d, s) in enumerate(zip(ids, sets))), key=repr)


def plain(df):
    return df.select("doc_id", "n_shingles", "component_id", "kept")


def edited(rng, words, share):
    return [rng.choice("alpha beta gamma delta".split()) if rng.random() < share else w for w in words]


def test_matches_all_pairs(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = [(None, "no id at all"), (900, None), (901, ""), (902, " \n\t "), (903, "One"), (904, "one"),
            (905, "one two"), (5, "same id other text"), (906, "É é x"), (907, "é é x")]
    for group in range(12):
        base = rng.choices(vocabulary, k=rng.choice([6, 30, 120, 700]))
        for _ in range(rng.choice([1, 2, 5, 20])):
            rows.append((len(rows), " ".join(edited(rng, base, rng.choice([0, 0.01, 0.03, 0.06])))))
            base = edited(rng, base, 0.02)
    rows += rows[15:20]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, node string, bands int")
    for words in (2, 5):
        got = sorted((tuple(r) for r in plain(minhash.near_duplicates(df, words)).collect()), key=repr)
        assert got == brute(rows, words)


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 100, 5000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        out = minhash.sketch(a)
        assert (out != np.iinfo(np.uint64).max).all()
    estimates = []
    for _ in range(40):
        shared = rng.integers(0, 2**63, 800).astype(np.uint64)
        a, b = (np.concatenate([shared, rng.integers(0, 2**63, 100).astype(np.uint64)]) for _ in range(2))
        estimates.append((minhash.sketch(a) == minhash.sketch(b)).mean())
    assert abs(np.mean(estimates) - 0.8) < 0.02


@pytest.mark.parametrize("small, shingles", [(10**9, 1), (0, 10**9), (3, 4000)])
def test_large_group_of_near_copies(spark, monkeypatch, small, shingles):
    monkeypatch.setattr(minhash, "SMALL", small)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", shingles)
    rng = random.Random(5)
    base = [f"v{i}" for i in range(200)]
    rows = [(i, " ".join(edited(rng, base, rng.choice([0.04, 0.12])))) for i in range(250)] + [(1000 + i, "copy of one text here") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in plain(minhash.near_duplicates(df, 2)).collect()), key=repr)
    assert got == brute(rows, 2)


def test_members_of_a_large_group_are_compared_with_few_others(spark, monkeypatch):
    """At most one pair for each draw and member in a turn, whatever the group's size."""
    compared, confirmed = [], minhash.confirmed
    monkeypatch.setattr(minhash, "confirmed", lambda pairs, *rest: compared.append(pairs.count()) or confirmed(pairs, *rest))
    rng = random.Random(11)
    base = [f"v{i}" for i in range(150)]
    rows = [(i, " ".join(edited(rng, base, 0.03))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in plain(minhash.near_duplicates(df, 2)).collect()), key=repr)
    assert got == brute(rows, 2)
    assert compared[0] <= minhash.DRAWS * len(rows)
    assert sum(compared) <= 2 * minhash.DRAWS * len(rows)


def test_blocks_link_labels_only(spark):
    """Members 1 to 3 are linked already, as are 4 and 5; one more link joins the two labels."""
    values = {1: range(20), 2: range(20), 3: range(1, 20), 4: range(1, 20), 5: range(2, 20), 6: range(100, 120)}
    labels = {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6}
    large = spark.createDataFrame([(n, 0, labels[n], len(v)) for n, v in values.items()], "node long, key long, label long, n long")
    sets = spark.createDataFrame(
        [(n, bytearray(np.array(v, np.uint64).tobytes())) for n, v in values.items()], "node long, shingles binary")
    got = [tuple(sorted(r)) for r in minhash._in_blocks(large, sets, 80).collect()]
    assert got == [(1, 4)]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(df).collect() == []


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (2, 1)]
    df = spark.createDataFrame(chain, "a long, b long")
    got = {r.node: r.label for r in components(df).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}


def tasks_of(spark, group, run):
    """What ``run`` returns, and the tasks of its jobs while shuffles have 32 partitions."""
    held = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = run()
    finally:
        spark.sparkContext.setJobGroup("", "")
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    seen = spark.sparkContext.statusTracker()
    stages = {s for job in seen.getJobIdsForGroup(group) for s in seen.getJobInfo(job).stageIds}
    return out, sum(x.numCompletedTasks for x in map(seen.getStageInfo, stages) if x)


def test_components_of_stars_take_one_round(spark):
    """Few tasks on many partitions, as the driver keeps records of all of them."""
    links = [(c, c + k) for c in (0, 1000, 2000) for k in range(1, 60)] + [(1003, 1004), (2005, 2002), (2002, 2005)]
    df = spark.createDataFrame(links, "a long, b long").repartition(2)
    got, tasks = tasks_of(spark, "stars", lambda: {r.node: r.label for r in components(df).collect()})
    assert got == {c + k: c for c in (0, 1000, 2000) for k in range(60)}
    assert tasks <= 220


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = sorted((tuple(r) for r in op4_minhash(spark, sf_dir).collect()), key=repr)
    assert got == brute([(r.doc_id, r.text) for r in docs], 2)


def test_keep_one(spark):
    text = "one two three four five six seven"
    rows = [(1, text, "a"), (2, text, "b"), (3, "other words of another text here", "c"), (3, "other words of another text here", "c"),
            (4, None, "d"), (None, text, "e"), (2, "yet another text with id two", "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, mark string")
    got = sorted((tuple(r) for r in minhash.keep_one(df).collect()), key=repr)
    assert got == sorted([rows[0], rows[2], rows[4], rows[5], rows[6]], key=repr)
