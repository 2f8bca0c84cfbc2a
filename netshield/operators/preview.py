"""A bounded sample of the requests behind an alert."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netshield.constants import PREVIEW_BYTES
from netshield.functions.request import preview
from netshield.operators.positions import with_position


def preview_rows(rows: DataFrame, keys: Sequence[str], order: Sequence[str] = ("seq",),
                 max_bytes: int = PREVIEW_BYTES) -> DataFrame:
    """Rows kept for each group's preview: ``keys, pos, row_json, rows_total, stride``.

    When a group's JSON text exceeds ``max_bytes``, every k-th row is kept, with
    ``k = max(2, size / max_bytes + 1)``. Sizes add up per row, so no group is assembled.
    """
    keys = list(keys)
    shaped = rows.select(*keys, "us", *order, F.to_json(F.struct(
        F.col("us").alias("timestamp"), "status", "bytes_sent",
        F.col("request_time").cast("decimal(18,6)").alias("request_time"), "request_length",
        preview(F.col("request")).alias("request_preview"),
        preview(F.col("user_agent")).alias("ua_preview"))).alias("row_json"))
    size = F.sum(F.octet_length("row_json")) + F.count(F.lit(1)) + 1
    sizes = shaped.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows_total"), size.alias("size"))
    strides = sizes.select(
        *keys, "rows_total",
        F.when(F.col("size") <= max_bytes, F.lit(1))
        .otherwise(F.greatest(F.lit(2), F.floor(F.col("size") / max_bytes) + 1))
        .cast("bigint").alias("stride"))
    placed = with_position(shaped, keys, order).join(strides, keys)
    return placed.where((F.col("pos") - 1) % F.col("stride") == 0).select(
        *keys, "pos", "row_json", "rows_total", "stride")


def previews(rows: DataFrame, keys: Sequence[str], order: Sequence[str] = ("seq",),
             max_bytes: int = PREVIEW_BYTES) -> DataFrame:
    """One JSON array per group, about ``max_bytes`` long at most, with its row counts."""
    kept = preview_rows(rows, keys, order, max_bytes)
    ordered = F.array_sort(F.collect_list(F.struct("pos", "row_json")))
    texts = F.transform(ordered, lambda row: row["row_json"])
    return kept.groupBy(*keys).agg(
        F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]")).alias("ip_data"),
        F.max("rows_total").alias("ip_data_rows_total"),
        F.count(F.lit(1)).alias("ip_data_rows_preview"))
