"""Connected components of links between long ids, as joins and aggregations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netshield.session import settle


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _smallest(edges: DataFrame) -> DataFrame:
    """The smallest of each node ``a`` and its neighbours; counted map-side, so hubs are cheap."""
    return edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of its neighbourhood (edges have a > b).

    A row for each edge, so the links don't grow in number.
    """
    low = _smallest(_both_ways(edges)).select(F.col("a").alias("b"), "low")
    return edges.join(low, "b").select("a", F.col("low").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link every node and its smaller neighbours to the smallest of them (edges have a > b)."""
    joined = edges.join(_smallest(edges), "a")
    linked = [F.struct(F.col(c).alias("a"), F.col("low").alias("b")) for c in "ab"]
    return joined.select(F.inline(F.array(*linked))).filter("a <> b")


def _named(edges: DataFrame) -> DataFrame:
    """``node, label, done`` of distinct edges with a > b: ``done`` if the node is a star's center or has one link only.

    Where all nodes are done, the links are stars, whose centers are the labels.
    """
    ends = edges.select(F.col("a").alias("node"), "b").union(
        edges.select("b", F.lit(None).cast("bigint")))
    return ends.groupBy("node").agg(
        F.coalesce(F.min("b"), F.col("node")).alias("label"),
        ((F.count("b") == 0) | (F.count("*") == 1)).alias("done"))


def components(edges: DataFrame) -> DataFrame:
    """``node, label``: the smallest node that each node of ``edges`` (``a, b``) reaches, written to the shared folder.

    Nodes without a link to another node don't occur. Direction, repeats, loops and nulls of the
    edges don't matter. Each round is written to the shared folder, and rounds go on until the
    links are stars; their number grows with the logarithm of the longest chain. Skewed hubs
    only meet in joins, which Spark can split. A round has few shuffles: the driver keeps records
    of every task, and on many partitions those of short rounds add up.
    """
    current = settle(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"),
                                                   F.least("a", "b").alias("b")), "links")
    while True:
        current = settle(_small_star(settle(_large_star(current), "links")).distinct(), "links")
        named = settle(_named(current), "labels")
        if named.agg(F.bool_and("done").alias("done")).first()["done"] is not False:
            return named.select("node", "label")
