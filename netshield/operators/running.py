"""Features of every request over its address's most recent requests.

A request is scored on the requests of its own calendar window so far, at most ``buffer_rows`` of
them. Groups are cut into chunks that repeat the last ``buffer_rows - 1`` rows of the chunk before,
which is all a frame can reach, so results do not depend on where a group is cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netshield.constants import FEATURES
from netshield.functions.moments import adjusted_kurt, adjusted_skew, or_zero, ratio, seconds
from netshield.functions.request import match_request
from netshield.operators.features import with_window
from netshield.operators.positions import with_position
from netshield.options import Options

_KEYS = ("ip", "win")
_FIELDS = ("path", "method", "status")


def trailing_buffer(logs: DataFrame, opts: Options = Options()) -> DataFrame:
    """Adds ``buffer_rows``: how many requests the trailing buffer holds after each request.

    The buffer spans the window length before the request, both ends included, capped in rows.
    """
    rows = logs.withColumn("us", F.unix_micros("ts"))
    counts = rows.where("ip IS NOT NULL AND us IS NOT NULL").groupBy("ip", "us").agg(F.count(F.lit(1)).alias("c"))
    sizes = _held(counts, opts.window_us)
    # Requests of one instant enter one by one.
    later = F.count(F.lit(1)).over(
        Window.partitionBy("ip", "us").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1))
    return (
        rows.withColumn("later", later).join(sizes, ["ip", "us"])
        .withColumn("buffer_rows", F.least(F.col("held") - F.col("later"), F.lit(opts.buffer_rows)))
        .drop("later", "held", "us")
    )


def _held(counts: DataFrame, width_us: int, slice_us: int = 1_000_000) -> DataFrame:
    """``(ip, us, held)`` of instants ``(ip, us, c)``: requests from ``us - width_us`` to ``us``, both included.

    That is the running count at the instant less the one just before the window, so a row costs the same for
    any width. Running counts are taken inside short slices of time and raised by the totals of earlier slices.
    """
    ends = F.array(
        F.struct(F.col("us").alias("at"), F.col("c").alias("n"), F.lit(1).alias("sign")),
        F.struct((F.col("us") - width_us).alias("at"), F.lit(0).cast("bigint").alias("n"), F.lit(-1).alias("sign")))
    marks = counts.select("ip", "us", F.inline(ends)).withColumn("_slice", F.expr(f"at div {slice_us}"))
    # A window's start comes before the requests of its instant, which the window holds.
    so_far = Window.partitionBy("ip", "_slice").orderBy("at", "sign").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("ip").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = marks.groupBy("ip", "_slice").agg(F.sum("n").alias("_n")).select(
        "ip", "_slice", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    total = F.col("_before") + F.col("_here")
    return (
        marks.withColumn("_here", F.sum("n").over(so_far)).join(before, ["ip", "_slice"])
        .groupBy("ip", "us").agg(F.sum(F.col("sign") * total).alias("held"))
    )


def _xlogx(n: Column) -> Column:
    return F.when(n > 0, n * F.ln(n)).otherwise(F.lit(0.0))


_STATS = {"n": F.count, "mean": F.avg, "var": F.var_pop, "skew": F.skewness, "kurt": F.kurtosis,
          "min": F.min, "max": F.max}


def _sliding_stats(df: DataFrame, keys: list[str], widths: dict[str, int]) -> DataFrame:
    """Count, mean, central moments 2-4, minimum and maximum of each column's last rows.

    Positions fall into blocks as wide as the frame, so a frame is the end of one block plus the
    start of the next. Both are running aggregates; merging them costs the same for any width.
    """
    columns = df.columns
    for width in sorted(set(widths.values())):
        names = [x for x, w in widths.items() if w == width]
        df = df.withColumn("_block", F.floor((F.col("pos") - 1) / width))
        block = Window.partitionBy(*keys, "_block")
        so_far = (Window.unboundedPreceding, 0)
        start, end = block.orderBy("pos").rowsBetween(*so_far), block.orderBy(
            F.desc("pos")).rowsBetween(*so_far)
        df = df.withColumns({f"{x}_a_{s}": fn(x).over(end) for x in names for s, fn in _STATS.items()})
        df = df.withColumns({f"{x}_b_{s}": fn(x).over(start) for x in names for s, fn in _STATS.items()})
        ordered = Window.partitionBy(*keys).orderBy("pos")
        spans_two = F.col("pos") % width != 0
        df = df.withColumns({
            f"{x}_a_{s}": F.when(spans_two, F.lag(f"{x}_a_{s}", width - 1).over(ordered))
            for x in names for s in _STATS})
    merged = {}
    for x in widths:
        def moments(side: str) -> tuple[Column, ...]:
            n, var = F.coalesce(f"{x}_{side}_n", F.lit(0)).cast("double"), F.col(f"{x}_{side}_var")
            skew, kurt = F.col(f"{x}_{side}_skew"), F.col(f"{x}_{side}_kurt")
            zero = F.lit(0.0)
            return (n, F.coalesce(f"{x}_{side}_mean", zero), F.coalesce(var * n, zero),
                    F.coalesce(skew * n * F.pow(var, F.lit(1.5)), zero),
                    F.coalesce((kurt + 3) * n * var * var, zero))

        merged[x] = _merge(moments("a"), moments("b"))
    return df.select(
        *columns,
        *[value.alias(f"{x}_{name}") for x in widths
          for name, value in zip(("n", "mean", "m2", "m3", "m4"), merged[x])],
        *[F.least(f"{x}_a_min", f"{x}_b_min").alias(f"{x}_min") for x in widths],
        *[F.greatest(f"{x}_a_max", f"{x}_b_max").alias(f"{x}_max") for x in widths])


def _merge(a: tuple[Column, ...], b: tuple[Column, ...]) -> tuple[Column, ...]:
    """Count, mean and sums of powers around the mean of two samples together."""
    (na, ma, a2, a3, a4), (nb, mb, b2, b3, b4) = a, b
    n = na + nb
    d = mb - ma
    mean = ma + d * nb / n
    m2 = a2 + b2 + d * d * na * nb / n
    m3 = (a3 + b3 + F.pow(d, F.lit(3)) * na * nb * (na - nb) / (n * n)
          + 3 * d * (na * b2 - nb * a2) / n)
    m4 = (a4 + b4 + F.pow(d, F.lit(4)) * na * nb * (na * na - na * nb + nb * nb) / (n * n * n)
          + 6 * d * d * (na * na * b2 + nb * nb * a2) / (n * n) + 4 * d * (na * b3 - nb * a3) / n)
    return n, mean, m2, m3, m4


def running_features(logs: DataFrame, opts: Options = Options(), chunk_rows: int = 10_000,
                     task_rows: int = 50_000) -> DataFrame:
    """One feature row per request ``(ip, ts, seq, ...)``, exact for any chunk size.

    A row grows to many times its shuffled size before the frames are done, so tasks are dealt by rows
    (counted): about ``task_rows`` each, however large the log is.
    """
    depth = opts.buffer_rows
    chunk_rows = max(chunk_rows, depth)
    parts = match_request(F.col("request"))
    rows = with_window(logs, opts).select(
        *_KEYS, "seq", "us",
        F.col("bytes_sent").cast("double").alias("b"), F.col("request_time").cast("double").alias("t"),
        parts["method"].alias("method"), parts["path"].alias("path"), parts["version"].alias("version"),
        F.col("status").alias("code"), F.col("status").cast("string").alias("status"))
    placed = with_position(rows, _KEYS, ["seq"])
    index = F.col("pos") - 1
    chunk, place = F.floor(index / chunk_rows), index % chunk_rows
    reach = F.when(place >= chunk_rows - (depth - 1), F.array(chunk, chunk + 1)).otherwise(F.array(chunk))
    chunked = placed.withColumn("home", chunk).withColumn("chunk", F.explode(reach))

    keys = [*_KEYS, "chunk"]
    tasks = max(logs.sparkSession.sparkContext.defaultParallelism, -(-logs.count() // task_rows))
    chunked = chunked.repartition(tasks, *keys)
    ordered = Window.partitionBy(*keys).orderBy("pos")
    so_far = ordered.rowsBetween(Window.unboundedPreceding, 0)

    def by_value(name: str):
        return Window.partitionBy(*keys, name).orderBy("pos")

    # Occurrences of the row's value in the frame ending at it and in the one that starts at it.
    counted = chunked.withColumns({
        column: F.count(name).over(by_value(name).rangeBetween(*reach_)).cast("double")
        for name in _FIELDS
        for column, reach_ in ((f"{name}_in", (-(depth - 1), 0)), (f"{name}_out", (0, depth - 1)))
    })
    gap_us = F.coalesce(F.col("us") - F.lag("us").over(ordered), F.lit(0))
    spaced = counted.withColumn("gap_us", gap_us).withColumn(
        "near", F.col("gap_us") <= opts.burst_gap_us)
    starts = F.col("near") & ~F.coalesce(F.lag("near").over(ordered), F.lit(False))

    def flag(condition: Column) -> Column:
        return F.coalesce(condition, F.lit(False)).cast("bigint")

    code = F.col("code")
    totals = {
        "gets": flag(F.col("method") == "GET"), "posts": flag(F.col("method") == "POST"),
        "versions": flag(F.col("version").isNotNull()),
        "http1": flag(F.col("version").contains("HTTP/1")),
        "http2": flag(F.col("version").contains("HTTP/2")),
        "errors": flag(code >= 400), "errors4": flag((code >= 400) & (code < 500)),
        "errors5": flag(code >= 500),
        **{f"{f}_n": flag(F.col(f).isNotNull()) for f in _FIELDS},
    }
    entering = {f"{f}_enter": F.when(F.col(f).isNotNull(),
                                     _xlogx(F.col(f"{f}_in")) - _xlogx(F.col(f"{f}_in") - 1))
                .otherwise(0.0) for f in _FIELDS}
    leaving = {f"{f}_leave": F.when(F.col(f).isNotNull(),
                                    _xlogx(F.col(f"{f}_out")) - _xlogx(F.col(f"{f}_out") - 1))
               .otherwise(0.0) for f in _FIELDS}
    first_seen = {f"{f}_first": flag(F.col(f).isNotNull() & (F.col(f"{f}_in") == 1)) for f in _FIELDS}
    last_seen = {f"{f}_last": flag(F.col(f).isNotNull() & (F.col(f"{f}_out") == 1)) for f in _FIELDS}
    flags = {**totals, **entering, **leaving, **first_seen, **last_seen,
             "start": starts.cast("bigint"), "burst": F.col("near").cast("bigint"),
             "burst_gap": F.when(F.col("near"), F.col("gap_us")).otherwise(F.lit(0))}
    flagged = spaced.withColumns(flags)
    measured = _sliding_stats(
        flagged.withColumn("g", seconds(F.col("gap_us"))), keys,
        {"b": depth, "t": depth, "g": depth - 1})
    summed = measured.withColumns({
        **{f"cum_{name}": F.sum(name).over(so_far) for name in flags},
        "first_us": F.coalesce(F.lag("us", depth - 1).over(ordered), F.first("us").over(so_far)),
    })

    def before(name: str, distance: int, missing) -> Column:
        return F.coalesce(F.lag(f"cum_{name}", distance).over(ordered), F.lit(missing))

    lagged = summed.withColumns({
        **{f"old_{name}": before(name, depth, 0) for name in totals},
        **{f"old_{name}": before(name, depth, 0.0) for name in leaving},
        **{f"old_{name}": before(name, depth, 0) for name in last_seen},
        "old_start": before("start", depth - 2, 1),
        "old_burst": before("burst", depth - 1, 1),
        "old_burst_gap": before("burst_gap", depth - 1, 0),
    }).where(F.col("chunk") == F.col("home"))

    n = F.least(F.col("pos"), F.lit(depth)).cast("double")

    def total(name: str) -> Column:
        return F.col(f"cum_{name}") - F.col(f"old_{name}")

    def entropy(field: str) -> Column:
        # The frame's sums: what entered so far minus what left before the frame's start.
        distinct = F.col(f"cum_{field}_first") - F.col(f"old_{field}_last")
        size = total(f"{field}_n")
        inner = (F.col(f"cum_{field}_enter") - F.col(f"old_{field}_leave")) / size
        return F.when(distinct > 1, F.ln(size) - inner).otherwise(F.lit(0.0))

    # The frame's first gap counts as 0: a full frame's other gaps merge with one zero.
    gaps = tuple(F.col(f"g_{name}") for name in ("n", "mean", "m2", "m3", "m4"))
    zeros = n - F.col("g_n")
    _, _, m2, m3, m4 = _merge(gaps, (zeros, *[F.lit(0.0)] * 4))
    merged = lagged.withColumns({"n": n, "m2": m2, "m3": m3, "m4": m4})
    n, span = F.col("n"), F.col("us") - F.col("first_us")
    varied, several = span > 0, n > 1
    bursts = 1 + F.col("cum_start") - F.col("old_start")
    session = seconds(span)
    get_ratio, post_ratio = total("gets") / n, total("posts") / n

    def shape(x: str, k: int) -> Column:
        """Standardised third or fourth (excess) moment; NULL for equal values."""
        size, m2 = F.col(f"{x}_n"), F.col(f"{x}_m2")
        value = F.col(f"{x}_m{k}") / size / F.pow(m2 / size, F.lit(k / 2)) - (3 if k == 4 else 0)
        return F.when(F.col(f"{x}_min") < F.col(f"{x}_max"), value)

    features = {
        "request_count": n.cast("bigint"),
        "request_rate": n / F.lit(float(opts.window_seconds)),
        "unique_paths": F.col("cum_path_first") - F.col("old_path_last"),
        "unique_paths_ratio": (F.col("cum_path_first") - F.col("old_path_last")) / n,
        **{f"{f}_entropy": entropy(f) for f in _FIELDS},
        "interval_mean": seconds(span / n),
        "interval_std": or_zero(F.when(several, F.sqrt(F.col("m2") / (n - 1)))),
        "interval_skew": or_zero(F.when(varied, F.col("m3") / n / F.pow(F.col("m2") / n, F.lit(1.5)))),
        "interval_kurt": or_zero(F.when(varied, F.col("m4") / n / F.pow(F.col("m2") / n, F.lit(2)) - 3)),
        "burst_rate": F.when(several, bursts / n).otherwise(0.0),
        "burst_duration_mean": F.when(several, seconds(total("burst_gap") / bursts)).otherwise(0.0),
        "burst_size_mean": F.when(several, (1 + total("burst")) / bursts).otherwise(0.0),
        "get_ratio": get_ratio, "post_ratio": post_ratio,
        "other_method_ratio": F.lit(1.0) - get_ratio - post_ratio,
        "http1_ratio": ratio(total("http1"), total("versions")),
        "http2_ratio": ratio(total("http2"), total("versions")),
        **{f"{name}_{stat}": column
           for x, name in (("b", "bytes"), ("t", "time"))
           for stat, column in (
               ("mean", or_zero(F.col(f"{x}_mean"))),
               ("std", or_zero(F.when(several, F.sqrt(F.col(f"{x}_m2") / (n - 1))))),
               ("skew", adjusted_skew(n, shape(x, 3))),
               ("kurt", adjusted_kurt(n, shape(x, 4))),
               ("min", or_zero(F.col(f"{x}_min"))), ("max", or_zero(F.col(f"{x}_max"))))},
        "error_rate": total("errors") / n, "error_4xx_rate": total("errors4") / n,
        "error_5xx_rate": total("errors5") / n,
        "session_length": session,
        "requests_per_second": F.when(session > 0, n / session).otherwise(n),
    }
    return merged.select(
        *_KEYS, "seq", F.timestamp_micros("us").alias("timestamp"),
        *[features[name].alias(name) for name in FEATURES])
