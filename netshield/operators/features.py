"""Per-group request statistics.

Three aggregations over the same keys, joined on those keys. No task ever holds one address's
requests: counters and moments combine algebraically, entropies work on value counts, both map-side
before their shuffle, and gaps order the requests of one second at a time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netshield.constants import FEATURES
from netshield.functions.moments import adjusted_kurt, adjusted_skew, or_zero, ratio, seconds
from netshield.functions.request import match_request
from netshield.options import Options

#: Width of the slices in which an address's requests are put in order.
SLICE_US = 1_000_000


def minute_start(us: Column, opts: Options) -> Column:
    """Start of the calendar-aligned window that holds a microsecond instant."""
    return F.timestamp_micros(us - us % opts.window_us)


def with_window(logs: DataFrame, opts: Options = Options()) -> DataFrame:
    us = F.unix_micros("ts")
    return logs.withColumn("us", us).withColumn("win", minute_start(us, opts))


def _count(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def counters(rows: DataFrame, keys: Sequence[str], opts: Options = Options()) -> DataFrame:
    """Features that combine algebraically: counts, ratios, byte and time statistics, errors."""
    return counter_features(counter_sums(rows, keys), keys, opts)


def counter_sums(rows: DataFrame, keys: Sequence[str], *more: Column) -> DataFrame:
    """What ``counter_features`` is made of, per group; ``more`` aggregates may use bytes ``b`` and seconds ``t``."""
    parts = match_request(F.col("request"))
    base = rows.select(
        *keys, "us", "status",
        F.col("bytes_sent").cast("double").alias("b"),
        F.col("request_time").cast("double").alias("t"),
        parts["method"].alias("m"),
        parts["version"].alias("v"),
    )
    status = F.col("status")
    return base.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("us").alias("first_us"),
        F.max("us").alias("last_us"),
        _count(F.col("m") == "GET").alias("gets"),
        _count(F.col("m") == "POST").alias("posts"),
        F.count("v").alias("versions"),
        _count(F.col("v").contains("HTTP/1")).alias("http1"),
        _count(F.col("v").contains("HTTP/2")).alias("http2"),
        _count(status >= 400).alias("errors"),
        _count((status >= 400) & (status < 500)).alias("errors4"),
        _count(status >= 500).alias("errors5"),
        *[
            fn(x).alias(f"{x}_{name}")
            for x in ("b", "t")
            for name, fn in (
                ("n", F.count), ("mean", F.avg), ("std", F.stddev_samp), ("skew", F.skewness),
                ("kurt", F.kurtosis), ("min", F.min), ("max", F.max),
            )
        ],
        *more,
    )


def counter_features(sums: DataFrame, keys: Sequence[str], opts: Options = Options()) -> DataFrame:
    n = F.col("n")
    session = seconds(F.col("last_us") - F.col("first_us"))
    get_ratio, post_ratio = F.col("gets") / n, F.col("posts") / n
    return sums.select(
        *keys,
        F.timestamp_micros("last_us").alias("timestamp"),
        n.alias("request_count"),
        (n / F.lit(float(opts.window_seconds))).alias("request_rate"),
        get_ratio.alias("get_ratio"),
        post_ratio.alias("post_ratio"),
        (F.lit(1.0) - get_ratio - post_ratio).alias("other_method_ratio"),
        ratio(F.col("http1"), F.col("versions")).alias("http1_ratio"),
        ratio(F.col("http2"), F.col("versions")).alias("http2_ratio"),
        *[
            column.alias(f"{name}_{stat}")
            for x, name in (("b", "bytes"), ("t", "time"))
            for stat, column in (
                ("mean", or_zero(F.col(f"{x}_mean"))),
                ("std", or_zero(F.col(f"{x}_std"))),
                ("skew", adjusted_skew(F.col(f"{x}_n"), F.col(f"{x}_skew"))),
                ("kurt", adjusted_kurt(F.col(f"{x}_n"), F.col(f"{x}_kurt"))),
                ("min", or_zero(F.col(f"{x}_min"))),
                ("max", or_zero(F.col(f"{x}_max"))),
            )
        ],
        (F.col("errors") / n).alias("error_rate"),
        (F.col("errors4") / n).alias("error_4xx_rate"),
        (F.col("errors5") / n).alias("error_5xx_rate"),
        session.alias("session_length"),
        F.when(session > 0, n / session).otherwise(n.cast("double")).alias("requests_per_second"),
    )


def value_counts(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Occurrences of each non-null path, method and status per group, in one shuffle."""
    parts = match_request(F.col("request"))
    values = F.array(
        F.struct(F.lit("path").alias("field"), parts["path"].alias("value")),
        F.struct(F.lit("method").alias("field"), parts["method"].alias("value")),
        F.struct(F.lit("status").alias("field"), F.col("status").cast("string").alias("value")),
    )
    return (
        rows.select(*keys, F.inline(values))
        .where(F.col("value").isNotNull())
        .groupBy(*keys, "field", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _entropy(field: str) -> list[Column]:
    n = F.when(F.col("field") == field, F.col("n").cast("double"))
    return [
        F.count(n).alias(f"{field}_distinct"),
        F.sum(n).alias(f"{field}_total"),
        F.sum(n * F.ln(n)).alias(f"{field}_nlogn"),
    ]


def diversity(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct paths and the natural-log entropies of path, method and status."""
    return diversity_of(value_counts(rows, keys), keys)


def diversity_of(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    fields = ("path", "method", "status")
    sums = counts.groupBy(*keys).agg(*[c for f in fields for c in _entropy(f)])

    def entropy(field: str) -> Column:
        total = F.col(f"{field}_total")
        value = F.ln(total) - F.col(f"{field}_nlogn") / total
        return F.when(F.col(f"{field}_distinct") > 1, value).otherwise(F.lit(0.0))

    return sums.select(
        *keys,
        F.col("path_distinct").alias("unique_paths"),
        *[entropy(field).alias(f"{field}_entropy") for field in fields],
    )


def gaps(rows: DataFrame, keys: Sequence[str], opts: Options = Options()) -> DataFrame:
    """Inter-arrival statistics and bursts.

    The gap before a group's first request counts as 0. Requests are ordered inside one-second
    slices only, so a group's requests are never in one task; each slice leaves one row, and the
    gaps between slices are added from their ends. A burst starts at a near request whose
    predecessor isn't near; whether a slice's first request is near shows at its edge.
    """
    return gap_features(merged_runs(gap_slices(rows, keys, opts), keys, "slice", True, opts), keys)


def gap_slices(rows: DataFrame, keys: Sequence[str], opts: Options = Options()) -> DataFrame:
    """The run of requests of every group and one-second ``slice``, see ``merged_runs``."""
    sliced = [*keys, F.expr(f"us div {SLICE_US}").alias("slice")]
    inside = Window.partitionBy(*keys, "slice").orderBy("us")
    near_gap = F.col("gap_us") <= opts.burst_gap_us
    ordered = rows.select(*sliced, "us").select(
        *keys, "slice", "us", F.row_number().over(inside).alias("i"),
        (F.col("us") - F.lag("us").over(inside)).alias("gap_us"),
    ).withColumn("near", F.coalesce(near_gap, F.lit(False)))
    ordered = ordered.withColumn("prev_near", F.lag("near").over(inside))
    gap = seconds(F.col("gap_us"))
    return ordered.groupBy(*keys, "slice").agg(
        F.count(F.lit(1)).alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"),
        *[F.coalesce(F.sum(F.pow(gap, F.lit(k))), F.lit(0.0)).alias(f"s{k}") for k in (2, 3, 4)],
        _count((F.col("i") > 2) & F.col("near") & ~F.col("prev_near")).alias("starts"),
        _count(F.col("near")).alias("near"),
        F.sum(F.when(F.col("near"), F.col("gap_us")).otherwise(F.lit(0))).alias("near_us"),
        F.max((F.col("i") == 2) & F.col("near")).alias("second_near"),
        F.max_by("near", "i").alias("last_near"),
    )


def merged_runs(runs: DataFrame, keys: Sequence[str], order: str, closed: bool, opts: Options = Options()) -> DataFrame:
    """Consecutive runs of requests of a group as one run.

    A run has its number ``n`` of requests, first and last instant, power sums of its gaps, and of
    its near requests their number, the sum of their gaps and how many start a burst. Nothing is known
    of what comes before its first request, so that one never counts, and a second request after it
    doesn't count as a start; ``second_near`` says whether it may. A ``closed`` run is a whole group,
    whose first request counts as near at a gap of 0.
    """
    by_order = Window.partitionBy(*keys).orderBy(order)
    edge_us = F.col("first_us") - F.lag("last_us").over(by_order)
    edged = runs.withColumn("edge_us", F.coalesce(edge_us, F.lit(0)) if closed else edge_us)
    edged = edged.withColumn("first_near", F.col("edge_us") <= opts.burst_gap_us)
    end_near = F.when(F.col("n") > 1, F.col("last_near")).otherwise(F.col("first_near"))
    edged = edged.withColumn("end_near", end_near)
    before_near = F.lag("end_near").over(by_order)
    edged = edged.withColumn("before_near", F.coalesce(before_near, F.lit(False)) if closed else before_near)
    edge = seconds(F.col("edge_us"))
    flag = lambda condition: F.when(condition, 1).otherwise(0)
    second = F.when(F.col("edge_us").isNull(), F.col("second_near") & (F.col("n") > 1)).when(
        F.col("before_near").isNull(), F.col("first_near"))
    return edged.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"),
        *[F.sum(F.col(f"s{k}") + F.coalesce(F.pow(edge, F.lit(k)), F.lit(0.0))).alias(f"s{k}") for k in (2, 3, 4)],
        F.sum(F.col("starts") + flag(F.col("second_near") & ~F.col("first_near"))
              + flag(F.col("first_near") & ~F.col("before_near"))).alias("starts"),
        F.sum(F.col("near") + flag(F.col("first_near"))).alias("near"),
        F.sum(F.col("near_us") + F.when(F.col("first_near"), F.col("edge_us")).otherwise(F.lit(0))).alias("near_us"),
        F.coalesce(F.max(second), F.lit(False)).alias("second_near"),
        F.coalesce(F.max_by("end_near", order), F.lit(False)).alias("last_near"),
    )


def gap_features(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Interval and burst features of closed runs."""
    raw = runs.withColumn("span_us", F.col("last_us") - F.col("first_us"))
    # power sums about the mean from those about zero; a group's zero gap keeps them well apart
    n, mean = F.col("n"), seconds(F.col("span_us")) / F.col("n")
    s2, s3, s4 = (F.col(f"s{k}") for k in (2, 3, 4))
    sums = raw.withColumns({
        "m2": F.greatest(s2 - n * mean * mean, F.lit(0.0)),
        "m3": s3 - 3 * mean * s2 + 2 * n * F.pow(mean, F.lit(3)),
        "m4": s4 - 4 * mean * s3 + 6 * mean * mean * s2 - 3 * n * F.pow(mean, F.lit(4)),
    })
    n, varied = F.col("n"), F.col("span_us") > 0
    variance = F.col("m2") / n
    several = n > 1
    return sums.select(
        *keys,
        seconds(F.col("span_us") / n).alias("interval_mean"),
        or_zero(F.when(several, F.sqrt(F.col("m2") / (n - 1)))).alias("interval_std"),
        or_zero(F.when(varied, F.col("m3") / n / F.pow(variance, F.lit(1.5)))).alias("interval_skew"),
        or_zero(F.when(varied, F.col("m4") / n / F.pow(variance, F.lit(2)) - 3)).alias("interval_kurt"),
        F.when(several, F.col("starts") / n).otherwise(F.lit(0.0)).alias("burst_rate"),
        F.when(several, seconds(F.col("near_us") / F.col("starts"))).otherwise(F.lit(0.0))
        .alias("burst_duration_mean"),
        F.when(several, F.col("near") / F.col("starts")).otherwise(F.lit(0.0))
        .alias("burst_size_mean"),
    )


def grouped_features(rows: DataFrame, keys: Sequence[str], opts: Options = Options()) -> DataFrame:
    """All 36 features plus ``timestamp`` per group; ``rows`` must carry ``us``."""
    keys = list(keys)
    return joined_features(counters(rows, keys, opts), gaps(rows, keys, opts), diversity(rows, keys), keys)


def joined_features(counted: DataFrame, intervals: DataFrame, varied: DataFrame, keys: Sequence[str]) -> DataFrame:
    joined = counted.join(intervals, list(keys)).join(varied, list(keys), "left")
    filled = joined.withColumns({
        "unique_paths": F.coalesce("unique_paths", F.lit(0)),
        **{f"{f}_entropy": F.coalesce(f"{f}_entropy", F.lit(0.0)) for f in ("path", "method", "status")},
    }).withColumn("unique_paths_ratio", F.col("unique_paths") / F.col("request_count"))
    return filled.select(*keys, "timestamp", *FEATURES)


def minute_features(logs: DataFrame, opts: Options = Options()) -> DataFrame:
    """The feature row of every (ip, calendar window) that has requests."""
    return grouped_features(with_window(logs, opts), ["ip", "win"], opts)


def last_windows(features: DataFrame) -> DataFrame:
    """The feature row of each address's newest window, the one a scorer sees."""
    rest = [c for c in features.columns if c != "ip"]
    newest = features.groupBy("ip").agg(F.max_by(F.struct(*rest), "win").alias("row"))
    return newest.select("ip", "row.*")
