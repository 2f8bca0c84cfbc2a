"""The expiring list of blocked addresses, as a table ``(ip, added_at, expires_at)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netshield.options import Options
from netshield.session import broadcast_if_small, rows_within, settle


def _seconds(count: float) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(count))


def with_expiry(entries: DataFrame, opts: Options = Options()) -> DataFrame:
    return entries.select(
        "ip", "added_at", (F.col("added_at") + _seconds(opts.block_seconds)).alias("expires_at"))


def add(blocklist: DataFrame, entries: DataFrame, opts: Options = Options()) -> DataFrame:
    """Insert ``(ip, added_at)``; adding a listed address again refreshes its time."""
    both = blocklist.select("ip", "added_at").unionByName(entries.select("ip", "added_at"))
    return with_expiry(both.groupBy("ip").agg(F.max("added_at").alias("added_at")), opts)


def remove(blocklist: DataFrame, addresses: DataFrame) -> DataFrame:
    return blocklist.join(addresses.select("ip"), "ip", "left_anti")


def contains(df: DataFrame, blocklist: DataFrame, ip: str = "ip") -> DataFrame:
    """Adds ``is_blocked``: whether the address is listed, whatever the time."""
    listed = blocklist.select(F.col("ip").alias("_ip")).distinct().withColumn("is_blocked", F.lit(True))
    return df.join(listed, F.col(ip) == F.col("_ip"), "left").drop("_ip").withColumn(
        "is_blocked", F.coalesce("is_blocked", F.lit(False)))


def purge_old(blocklist: DataFrame, now: Column) -> DataFrame:
    return blocklist.where(F.col("expires_at") > now)


def clear(blocklist: DataFrame) -> DataFrame:
    return blocklist.where(F.lit(False))


def drop_blocked(rows: DataFrame, blocklist: DataFrame, ip: str = "ip", ts: str = "ts",
                 opts: Options = Options()) -> DataFrame:
    """Anti-join against entries that were active at the row's time."""
    active = blocklist.select(
        F.col("ip").alias("_ip"), F.col("added_at").alias("_from"),
        F.col("expires_at").alias("_until"))
    return rows.join(
        broadcast_if_small(active, opts.broadcast_rows),
        (F.col(ip) == F.col("_ip")) & (F.col("_from") <= F.col(ts)) & (F.col(ts) < F.col("_until")),
        "left_anti")


def forget_blocked(rows: DataFrame, blocklist: DataFrame, ip: str = "ip", ts: str = "ts",
                   opts: Options = Options()) -> DataFrame:
    """Drop what an address's series lost to its blocks.

    Its records were deleted when it was listed and not collected until the entry expired.
    """
    until = blocklist.groupBy(F.col("ip").alias("_ip")).agg(F.max("expires_at").alias("_until"))
    return rows.join(
        broadcast_if_small(until, opts.broadcast_rows),
        (F.col(ip) == F.col("_ip")) & (F.col(ts) < F.col("_until")), "left_anti")


#: Slices of a block's length in which an address's detections are put in order.
SLICES = 60


def successors(detections: DataFrame, opts: Options = Options()) -> DataFrame:
    """Each distinct detection ``(ip, us)`` with ``next_us``, the first one at least a block later, and ``fresh``.

    ``fresh`` says that no other detection lies less than a block before it. Instants are ordered inside
    short slices of time only; what lies beyond a slice comes from the ends of the address's other slices.
    """
    block = opts.block_seconds * 1_000_000
    width = max(1, block // SLICES)
    slice_of = lambda at: F.call_function("div", at - F.pmod(at, F.lit(width)), F.lit(width))
    points = detections.select("ip", "us").where("ip IS NOT NULL AND us IS NOT NULL").distinct()
    asks = points.select("ip", F.lit(None).cast("bigint").alias("us"), (F.col("us") + block).alias("at"))
    both = points.withColumn("at", F.col("us")).unionByName(asks).withColumn("slice", slice_of(F.col("at")))
    ends = both.groupBy("ip", "slice").agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"))
    by_slice = Window.partitionBy("ip").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    from_last = Window.partitionBy("ip").orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("ip", "slice", F.max("last_us").over(by_slice).alias("before_us"), F.min("first_us").over(from_last).alias("after_us"))
    backwards = Window.partitionBy("ip", "slice").orderBy(F.desc("at"))
    forwards = Window.partitionBy("ip", "slice").orderBy("at", F.col("us").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    placed = both.withColumns({"here_us": F.min("us").over(backwards), "earlier_us": F.max("us").over(forwards)}).join(ends, ["ip", "slice"])
    previous = F.coalesce("earlier_us", "before_us")
    answers = placed.where("us IS NULL").select("ip", (F.col("at") - block).alias("us"), F.coalesce("here_us", "after_us").alias("next_us"))
    known = placed.where("us IS NOT NULL").select(
        "ip", "us", F.coalesce(F.col("us") - previous >= block, F.lit(True)).alias("fresh"))
    return known.join(answers, ["ip", "us"])


def first_detections(detections: DataFrame, opts: Options = Options()) -> DataFrame:
    """Detections ``(ip, us)`` that raise an alert: the first one, then the first after each block.

    While an address is blocked, later detections are suppressed. Chains of ``successors`` from the
    detections that start afresh are followed by pointer doubling: each round adds what the alerts so
    far reach, and doubles how far a step goes. So there are as many rounds as the logarithm of an
    address's alerts, each a join on (address, instant). Rows without an address or instant are left
    out; repeated ones are one.
    """
    links = settle(successors(detections, opts), "successors")
    reached = links.where("fresh").select("ip", "us")
    steps = links.where("next_us IS NOT NULL").select("ip", "us", "next_us")
    while not rows_within(steps, 0):
        new = reached.join(steps, ["ip", "us"]).select("ip", F.col("next_us").alias("us"))
        reached = settle(reached.union(new).distinct(), "reached")
        then = steps.select("ip", F.col("us").alias("next_us"), F.col("next_us").alias("then_us"))
        steps = settle(steps.join(then, ["ip", "next_us"]).select("ip", "us", F.col("then_us").alias("next_us")), "steps")
    return reached
