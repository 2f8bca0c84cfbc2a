"""The per-address request series as a table ``(ip, ts, payload)``.

Equal records are one record, and records of one instant are ordered by their payload text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netshield.options import Options

KEY = ["ip", "ts", "payload"]


def push(series: DataFrame, records: DataFrame) -> DataFrame:
    """Add records that carry their own time."""
    return dedup(series.select(*KEY).unionByName(records.select(*KEY)))


def batch_push(series: DataFrame, records: DataFrame, now: Column,
               opts: Options = Options()) -> DataFrame:
    """Add ``(ip, payload)`` records stamped ``now``; series of those addresses lose expired rows."""
    stamped = records.select("ip", now.alias("ts"), "payload")
    touched = stamped.select("ip").distinct().withColumn("touched", F.lit(True))
    fresh = F.unix_micros("ts") > F.unix_micros(now) - opts.series_max_age_seconds * 1_000_000
    kept = series.select(*KEY).join(touched, "ip", "left").where(F.col("touched").isNull() | fresh)
    return push(kept.drop("touched"), stamped)


def dedup(series: DataFrame) -> DataFrame:
    return series.dropDuplicates(KEY)


def last_n(series: DataFrame, n: int = 100) -> DataFrame:
    """The n latest records, oldest first."""
    newest = series.orderBy(F.desc("ts"), F.desc("payload")).limit(n)
    return newest.orderBy("ts", "payload")


def first_n(series: DataFrame, n: int = 100) -> DataFrame:
    return series.orderBy("ts", "payload").limit(n)


def by_ip(series: DataFrame, ip: str, start: Column | None = None,
          end: Column | None = None) -> DataFrame:
    """One address's records in time order, both ends of the range included."""
    rows = series.where(F.col("ip") == ip)
    if start is not None:
        rows = rows.where(F.col("ts") >= start)
    if end is not None:
        rows = rows.where(F.col("ts") <= end)
    return rows.orderBy("ts", "payload")


def last_seconds(series: DataFrame, seconds: int, now: Column, ip: str | None = None) -> DataFrame:
    """Records of the last seconds before ``now``, of all addresses or one; both ends included."""
    since = F.timestamp_micros(F.unix_micros(now) - seconds * 1_000_000)
    rows = series.where(F.col("ts").between(since, now))
    return rows if ip is None else rows.where(F.col("ip") == ip)


def cap_per_ip(series: DataFrame, newest: int, pane_seconds: int = 60) -> DataFrame:
    """The newest records of each address.

    Counts per time pane first show which panes of an address are wholly kept or wholly dropped, so
    only the one pane that the cap cuts through is ever ranked.
    """
    pane = F.floor(F.unix_micros("ts") / (pane_seconds * 1_000_000))
    rows = series.withColumn("_pane", pane)
    later = Window.partitionBy("ip").orderBy(F.desc("_pane")).rowsBetween(
        Window.unboundedPreceding, -1)
    room = (
        rows.groupBy("ip", "_pane").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_room", newest - F.coalesce(F.sum("_n").over(later), F.lit(0)))
        .where(F.col("_room") > 0)
    )
    rank = F.row_number().over(
        Window.partitionBy("ip", "_pane").orderBy(F.desc("ts"), F.desc("payload")))
    placed = rows.join(room, ["ip", "_pane"])
    whole = placed.where(F.col("_n") <= F.col("_room"))
    cut = placed.where(F.col("_n") > F.col("_room")).withColumn("_rank", rank).where(
        F.col("_rank") <= F.col("_room"))
    return whole.select(*series.columns).unionByName(cut.select(*series.columns))


def show_all(series: DataFrame) -> DataFrame:
    """Every address's records in time order: rows sorted by address, time and payload."""
    return series.orderBy("ip", "ts", "payload")


def active_ips(series: DataFrame) -> DataFrame:
    return series.select("ip").distinct()


def purge_old(series: DataFrame, now: Column, opts: Options = Options()) -> DataFrame:
    """Drop records at or before the maximum age."""
    limit = F.timestamp_micros(F.unix_micros(now) - opts.series_max_age_seconds * 1_000_000)
    return series.where(F.col("ts") > limit)


def delete_ips(series: DataFrame, alerts: DataFrame) -> DataFrame:
    """Drop the records of alerted addresses ``(ip, alert_ts)`` up to the alert's time."""
    last = alerts.groupBy("ip").agg(F.max("alert_ts").alias("_until"))
    return series.join(last, (series["ip"] == last["ip"]) & (series["ts"] <= last["_until"]), "left_anti")


def delete_records(series: DataFrame, records: DataFrame) -> DataFrame:
    """Drop exactly the given records; a record without address or time is an error."""
    checked = records.select(
        F.coalesce("ip", F.raise_error(F.lit("record without ip")).cast("string")).alias("ip"),
        F.coalesce("ts", F.raise_error(F.lit("record without ts")).cast("timestamp")).alias("ts"),
        "payload")
    return series.join(checked, KEY, "left_anti")


def flush_all(series: DataFrame) -> DataFrame:
    return series.where(F.lit(False))


def deleted_count(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per-address number of records that an operation removed."""
    counts = before.groupBy("ip").agg(F.count(F.lit(1)).alias("before"))
    left = after.groupBy("ip").agg(F.count(F.lit(1)).alias("after"))
    joined = counts.join(left, "ip", "left")
    return joined.select("ip", (F.col("before") - F.coalesce("after", F.lit(0))).alias("deleted"))
