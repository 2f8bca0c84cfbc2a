"""Row positions within large ordered groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_position(rows: DataFrame, keys: Sequence[str], order: Sequence[str],
                  slice_us: int = 1_000_000) -> DataFrame:
    """Adds ``pos``: the 1-based place of a row in its group, ordered by ``us`` and then ``order``.

    Ranks are taken inside short time slices and shifted by the counts of earlier slices, so a heavy
    group is sorted by many tasks instead of one.
    """
    keys = list(keys)
    rank = F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy("us", *order))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sliced = rows.withColumn("_slice", F.expr(f"us div {slice_us}"))
    offsets = (
        sliced.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, "_slice", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    )
    return (
        sliced.withColumn("_rank", rank)
        .join(offsets, [*keys, "_slice"])
        .withColumn("pos", F.col("_before") + F.col("_rank"))
        .drop("_slice", "_rank", "_before")
    )
