import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from netshield.llm import neighbours
from netshield.llm.queries import op2_neighbours


def brute(rows, k=20, step=20):
    good = {}
    for i, v in rows:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        good[i] = np.array(v, np.float64)
    out = {}
    for i, v in good.items():
        if i % step == 0:
            found = sorted((-sum(float(a) * float(b) for a, b in zip(v, w)), j) for j, w in good.items() if j != i)[:k]
            out[i] = [(n + 1, j, -s) for n, (s, j) in enumerate(found)]
    return out


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return out


SCHEMA = "vec_id long, embedding array<float>, class string"


@pytest.mark.parametrize("exact", [True, False])
def test_small_table_and_ties(spark, exact, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 40)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 3)
    rng = random.Random(1)
    rows = [(i, [float(rng.randint(-3, 3)) for _ in range(5)]) for i in range(150)]
    rows += [(i, [1.0, 2.0, 3.0, 0.0, 1.0]) for i in range(200, 290)]
    rows += [(300, None), (320, []), (340, [0.0] * 5), (360, [1.0, None, 1.0, 1.0, 1.0]), (380, [float("nan")] * 5),
             (400, [float("inf"), 1.0, 1.0, 1.0, 1.0]), (None, [1.0] * 5)]
    df = spark.createDataFrame([(*r, "x") for r in rows + rows[:5]], SCHEMA)
    # with a limit that nothing meets every query takes the exact way; with the least one all rows are candidates
    vectors = np.array([r[1] for r in rows[:20]])
    index = neighbours.Index(vectors, 10**6 if exact else 0)
    got = answers(neighbours.nearest(df, F.col("vec_id") % 20 == 0, index=index))
    assert got == brute([(i, v) for i, v in rows])


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], "x"), (1, [0.5, 0.5], "x"), (20, [1.0, 0.0], "x")], SCHEMA)
    assert answers(neighbours.nearest(df, F.col("vec_id") % 20 == 0)) == {
        0: [(1, 20, 1.0), (2, 1, 0.5)], 20: [(1, 0, 1.0), (2, 1, 0.5)]}
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []
    assert neighbours.nearest(df.filter("vec_id = 1"), F.col("vec_id") % 20 == 0).collect() == []


def test_shared_weight_is_footrule():
    rng = np.random.default_rng(2)
    index = neighbours.Index(rng.normal(size=(30, 8)), 0)
    vectors = rng.normal(size=(50, 8))
    monkey = neighbours.LISTED
    lists = index.lists(vectors)
    shared = index.shared(lists[0], index.files(lists), 50)
    n = index.listed
    place = np.full((50, 30), n)
    np.put_along_axis(place, lists, np.arange(n)[None, :].repeat(50, 0), 1)
    assert (n * (n + 1) - 2 * shared == np.abs(place - place[0]).sum(1)).all() and monkey == 64


def test_recall(spark, sf_dir):
    for folder in (sf_dir, sf_dir.replace("sf0.001", "sf0.1")):
        rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
        got = answers(op2_neighbours(spark, folder))
        good = {i: np.array(v, np.float64) for i, v in rows}
        ids, matrix = np.array(list(good)), np.stack(list(good.values()))
        hits = total = 0
        for i in [i for i in good if i % 20 == 0]:
            score = matrix @ good[i]
            score[ids == i] = -np.inf
            want = set(ids[np.lexsort((ids, -score))[:20]])
            assert len(got[i]) == 20
            for _, j, s in got[i]:
                assert abs(s - good[i] @ good[j]) < 1e-12
            hits += len(want & {j for _, j, _ in got[i]})
            total += 20
        assert hits / total >= 0.9, hits / total


@pytest.mark.parametrize("copies, sigma", [(500, 0.0), (750, 0.0), (0, 1.0), (500, 1.0)])
def test_near_copies_and_norms(spark, copies, sigma):
    """Near copies of one vector (not equal) among the rows, and vectors of log-normal norms."""
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(1500, 64))
    vectors[rng.permutation(1500)[:copies]] = rng.normal(size=64) + rng.normal(scale=0.01, size=(copies, 64))
    vectors *= rng.lognormal(0, sigma, (1500, 1)) / np.linalg.norm(vectors, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(vectors)], SCHEMA.replace("float", "double"))
    got = answers(neighbours.nearest(df, F.col("vec_id") % 20 == 0))
    for i in range(0, 1500, 20):
        score = vectors @ vectors[i]
        score[i] = -np.inf
        assert [j for _, j, _ in got[i]] == np.argsort(-score)[:20].tolist(), i


def test_pivots_of_near_copies(spark):
    """A group of near copies gives one pivot while other directions are left."""
    rng = np.random.default_rng(4)
    vectors = np.concatenate([rng.normal(size=16) + rng.normal(scale=1e-4, size=(300, 16)), rng.normal(size=(60, 16))])
    classes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "class long, v array<double>")
    pivots = neighbours.fit(classes, pivots=40).pivots
    centre = vectors[0] / np.linalg.norm(vectors[0])
    assert (pivots @ centre > 0.9999).sum() <= 1
