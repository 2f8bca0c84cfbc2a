"""Nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order. Every pivot has an inverted file of the
vectors that list it, with their places. The footrule distance of two lists (absent pivots count as
one place past the end) is ``L * (L + 1)`` less twice the sum, over the pivots in both, of the
smaller number of places from the end; so it is summed along the inverted files of a query's
pivots. Of a block's vectors the share with the smallest distances is scored first, by inner products
in double precision. The k-th score is then a bound: every other vector is scored too, unless its
norm times the query's stays below that. So the index only saves work, and results are exact.

Pivots are directions of a bounded sample, each the farthest from those before, so that a group of
near copies gives one; every vector is indexed. Equal vectors are one class that keeps as many of
its smallest ids as a result can hold. Queries and classes are dealt into blocks of bounded size,
and a task takes one block of each.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netshield.session import settle

#: Pivots, pivots in a vector's list, vectors that pivots are chosen from, and the share of a block scored first.
PIVOTS, LISTED, SAMPLE, WITHIN = 256, 64, 3000, 0.3
#: Vectors of a block, and queries of a block.
BLOCK, QUERY_BLOCK = 8192, 1024
#: Queries whose products with a block are held at once.
PRODUCTS = 128


def usable(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``id, v``: distinct rows that take part, as doubles; see ``nearest`` for those that don't."""
    rows = vectors.select(F.col(id).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter(
        F.col("id").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("v", lambda x: x != 0))
    width = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return (rows.filter(F.size("v") == (width["n"] if width else 0))
            .withColumn("v", F.transform("v", lambda x: x + 0.0)).distinct())


@dataclass
class Index:
    """Pivots (one a row) and the least shared weight of a vector that is scored first."""

    pivots: np.ndarray
    least: int

    @property
    def listed(self) -> int:
        return min(LISTED, len(self.pivots))

    def lists(self, vectors: np.ndarray) -> np.ndarray:
        """Each vector's nearest pivots, nearest first; of equally near ones the first."""
        return np.argsort(-(vectors @ self.pivots.T), axis=1, kind="stable")[:, :self.listed].astype(np.int32)

    def shared(self, query_list: np.ndarray, files: list[tuple[np.ndarray, np.ndarray]], size: int) -> np.ndarray:
        """What the query shares with each of ``size`` vectors; the more, the smaller the footrule distance."""
        out = np.zeros(size, np.int32)
        for place, pivot in enumerate(query_list):
            members, weights = files[pivot]
            out[members] += np.minimum(weights, self.listed - place)
        return out

    def files(self, lists: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """The inverted file of every pivot: vectors that list it, and their places from the end."""
        pivot, member = lists.ravel(), np.repeat(np.arange(len(lists)), self.listed)
        weight = np.tile(self.listed - np.arange(self.listed, dtype=np.int32), len(lists))
        order = np.argsort(pivot, kind="stable")
        cut = np.searchsorted(pivot[order], np.arange(len(self.pivots) + 1))
        return [(member[order[a:b]], weight[order[a:b]]) for a, b in zip(cut, cut[1:])]


def fit(classes: DataFrame, pivots: int = PIVOTS, sample: int = SAMPLE) -> Index:
    """Pivots from at most ``sample`` vectors, taken in the order of a hash: farthest directions first."""
    rows = classes.orderBy("class").limit(sample).select("v").collect()
    if not rows:
        return Index(np.zeros((0, 0)), 0)
    vectors = np.array([r["v"] for r in rows])
    vectors /= np.abs(vectors).max(1, keepdims=True)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    chosen, near = [0], vectors @ vectors[0]
    while len(chosen) < min(pivots, len(vectors)):
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, vectors @ vectors[chosen[-1]])
        near[chosen] = np.inf
    return Index(vectors[chosen], 1)


def classes_of(rows: DataFrame, keep: int) -> DataFrame:
    """``class, v, ids``: distinct vectors under a hash, with their ``keep`` smallest ids."""
    order = Window.partitionBy("v").orderBy("id")
    return (rows.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= keep)
            .groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
            .select(F.xxhash64("v").alias("class"), "v", "ids"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _first(index: Index, query_list: np.ndarray, files: list[tuple[np.ndarray, np.ndarray]], size: int, k: int) -> np.ndarray:
    """Of ``size`` vectors the share nearest to the query by footrule distance, at least ``k`` if there are as many."""
    shared = index.shared(query_list, files, size)
    keep = min(size, max(k, math.ceil(WITHIN * size)))
    return np.flatnonzero(shared >= max(index.least, int(np.partition(shared, size - keep)[size - keep])))


def _best(index: Index, k: int):
    """The ``k`` nearest of a block of classes for each query of a block."""

    def found(queries: pa.Table, classes: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if len(queries) and len(classes):
            # by falling norm, so that what a bound lets through comes first
            c = _matrix(classes["v"])
            norms = np.linalg.norm(c, axis=1)
            order = np.argsort(-norms, kind="stable")
            c, norms = c[order], norms[order]
            names, low = classes["class"].to_numpy()[order], classes["low"].to_numpy()[order]
            files = index.files(_matrix(classes["list"])[order])
            q, lists, asked = _matrix(queries["v"]), _matrix(queries["list"]), queries["class"].to_numpy()
            for begin in range(0, len(q), PRODUCTS):
                part = slice(begin, begin + PRODUCTS)
                lengths = np.linalg.norm(q[part], axis=1)
                firsts = [_first(index, x, files, len(c), k) for x in lists[part]]
                slack = 1e-12 * lengths * norms[0]  # more than rounding takes
                bounds = np.full(len(firsts), -np.inf)
                for n, near in enumerate(firsts):
                    if len(near) >= k:
                        bounds[n] = np.partition(c[near] @ q[begin + n], len(near) - k)[len(near) - k] - slack[n]
                # vectors from here on can't reach the bound of any of these queries
                reach = max(int((~(norms * x < b)).sum()) for x, b in zip(lengths, bounds))
                products = q[part] @ c[:reach].T
                for n, bound in enumerate(bounds):
                    near = np.flatnonzero(~(products[n] < bound))
                    if len(near) > k:
                        score = products[n, near]
                        near = near[~(score < np.partition(score, len(near) - k)[len(near) - k] - slack[n])]
                    # summed in the order of ``_product``, so that equal scores are equal there
                    score = np.cumsum(c[near] * q[begin + n], axis=1)[:, -1]
                    best = np.lexsort((low[near], -score))[:k]
                    out.append((np.full(len(best), asked[begin + n]), names[near[best]], low[near[best]], score[best]))
        columns = [np.concatenate(x) for x in zip(*out)] if out else [[], [], [], []]
        return pa.table({"query": pa.array(columns[0], pa.int64()), "class": pa.array(columns[1], pa.int64()),
                         "low": pa.array(columns[2], pa.int64()), "near": pa.array(columns[3], pa.float64())})

    return found


def _in_blocks(queries: DataFrame, classes: DataFrame, index: Index, k: int) -> DataFrame:
    """``query, class``: the ``k`` best classes of each query class over all blocks."""
    blocks = max(1, -(-classes.count() // BLOCK))
    query_blocks = max(1, -(-queries.count() // QUERY_BLOCK))

    def dealt(df: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        return (df.withColumn(own, F.pmod(F.xxhash64("class"), F.lit(n)).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1)))))

    left = dealt(queries, "qb", query_blocks, "cb", blocks)
    right = dealt(classes, "cb", blocks, "qb", query_blocks)
    pairs = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(
        _best(index, k), "query long, class long, low long, near double")
    order = Window.partitionBy("query").orderBy(F.desc("near"), "low")
    return pairs.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k).select("query", "class")


def _product(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id: str = "vec_id",
            vector: str = "embedding", index: Index | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows with the largest inner products.

    Queries are the rows for which ``is_query``, a condition on the id, holds; candidates are all
    rows but the query's own. Ties go to the smaller id. Rows without an id, and vectors that are
    null, empty, zero, hold null or non-finite components, or haven't the most frequent number of
    components (the larger one in a tie) take no part. A repeated row counts once; an id with
    several vectors counts with each, though never as its own neighbour. Other columns are ignored.
    An empty table, or one without queries, gives an empty result.
    """
    rows = settle(usable(vectors, id, vector), "vectors")
    classes = settle(classes_of(rows, k + 1), "classes")
    index = index or fit(classes)
    asked = rows.withColumnRenamed("id", id).filter(is_query).withColumnRenamed(id, "id").select(
        "id", F.xxhash64("v").alias("class"))
    asked = settle(asked.distinct(), "queries")
    if not index.listed:
        return asked.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"),
                            F.lit(0.0).alias("score")).limit(0)

    @F.arrow_udf("array<int>")
    def listed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = index.lists(_matrix(pa.chunked_array([batch]))) if len(batch) else []
            yield pa.array(list(out), pa.list_(pa.int32()))

    indexed = settle(classes.select("class", "v", F.col("ids")[0].alias("low"), listed("v").alias("list")), "index")
    queries = settle(indexed.join(asked.select("class").distinct(), "class", "left_semi"), "asked")

    def ranked(found: DataFrame, of: DataFrame) -> DataFrame:
        names = classes.select("class", "v", "ids")
        scored = (found.join(names.select(F.col("class").alias("query"), F.col("v").alias("w")), "query")
                  .join(names, "class")
                  .select("query", F.explode("ids").alias("vec_id"), _product("w", "v").alias("score")))
        best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
        scored = scored.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1).drop("n")
        joined = of.select(F.col("id").alias("query_id"), F.col("class").alias("query")).join(scored, "query").filter(
            "query_id <> vec_id")
        order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
        return (joined.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
                .select("query_id", "query", "rank", "vec_id", "score"))

    return ranked(_in_blocks(queries, indexed, index, k + 1), asked).select("query_id", "rank", "vec_id", "score")
