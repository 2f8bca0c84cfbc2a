"""A log of blocklist commands, answered and applied in order of time without walking it.

Commands are ``add``, ``remove`` and ``contains`` of an address, and ``purge`` and ``clear`` of the whole
list. What a command finds depends on the latest earlier command of each kind only, so running maxima
answer all of them: inside slices of one second, and over an address's slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netshield.options import Options

_SLICE_US = 1_000_000
LISTED = "ip string, ts timestamp, seq bigint"


def _slice(us: Column) -> Column:
    return F.call_function("div", us - F.pmod(us, F.lit(_SLICE_US)), F.lit(_SLICE_US))


def _at() -> Column:
    return F.struct("us", "seq")


def _holds(added: Column, removed: Column, cleared: Column, purged: Column, opts: Options) -> Column:
    """Whether an entry of that time is still listed after the latest commands of the other kinds."""
    before = lambda other: other.isNull() | (other < added)
    young = added["us"] > purged["us"] - opts.block_seconds * 1_000_000
    return added.isNotNull() & before(removed) & before(cleared) & (before(purged) | young)


def apply_commands(commands: DataFrame, listed: DataFrame, opts: Options = Options()) -> tuple[DataFrame, DataFrame]:
    """Answers ``(seq, ip, ts, is_blocked)`` of the ``contains`` commands, and the list afterwards.

    ``commands`` are ``(seq, op, ip, ts)`` in the order of time and ``seq``, ``listed`` entries
    ``(ip, ts, seq)`` of earlier adds. Adding again refreshes an entry; a purge removes entries that are
    a block old or older. Commands without a time, unknown ones, and those on an address without one
    are left out; a missing ``seq`` comes first.
    """
    us = F.unix_micros("ts").alias("us")
    every = commands.where("ts IS NOT NULL").select("op", "ip", us, F.coalesce("seq", F.lit(-1)).cast("bigint").alias("seq"))
    own = every.where("op IN ('add', 'remove', 'contains') AND ip IS NOT NULL").unionByName(
        listed.select(F.lit("add").alias("op"), "ip", us, "seq")).withColumn("slice", _slice(F.col("us")))
    whole = every.where("op IN ('clear', 'purge')")
    latest = {name: F.max(F.when(F.col("op") == name, _at())) for name in ("add", "remove", "clear", "purge")}

    # commands on the whole list, by the seconds in which others need them: an operator sends few
    marks = whole.groupBy(_slice(F.col("us")).alias("slice")).agg(
        F.collect_list(F.struct("op", _at().alias("at"))).alias("marks"), *[latest[k].alias(k) for k in ("clear", "purge")])
    in_time = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = own.where("op = 'contains'").select("slice").distinct().join(marks, "slice", "full")
    slices = slices.select("slice", "marks", *[F.max(k).over(in_time).alias(f"{k}_before") for k in ("clear", "purge")])

    inside = Window.partitionBy("ip", "slice").orderBy("us", "seq").rowsBetween(Window.unboundedPreceding, -1)
    over_slices = Window.partitionBy("ip").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    ends = own.groupBy("ip", "slice").agg(*[latest[k].alias(k) for k in ("add", "remove")])
    carried = ends.select("ip", "slice", *[F.max(k).over(over_slices).alias(f"{k}_before") for k in ("add", "remove")])
    placed = own.withColumns({f"{k}_here": latest[k].over(inside) for k in ("add", "remove")})
    asked = placed.where("op = 'contains'").join(carried, ["ip", "slice"]).join(slices, "slice").withColumn("at", _at())

    def of_list(name: str) -> Column:
        earlier = F.filter("marks", lambda m: (m["op"] == name) & (m["at"] < F.col("at")))
        return F.coalesce(F.array_max(F.transform(earlier, lambda m: m["at"])), F.col(f"{name}_before"))

    found = {k: F.coalesce(f"{k}_here", f"{k}_before") for k in ("add", "remove")}
    answers = asked.select("seq", "ip", F.timestamp_micros("us").alias("ts"), F.coalesce(
        _holds(found["add"], found["remove"], of_list("clear"), of_list("purge"), opts), F.lit(False)).alias("is_blocked"))

    last = whole.agg(*[latest[k].alias(k) for k in ("clear", "purge")]).first()
    moment = lambda at: F.lit(None).cast("struct<us:bigint,seq:bigint>") if at is None else F.struct(
        F.lit(at["us"]).cast("bigint").alias("us"), F.lit(at["seq"]).cast("bigint").alias("seq"))
    states = own.groupBy("ip").agg(*[latest[k].alias(k) for k in ("add", "remove")])
    kept = states.where(_holds(F.col("add"), F.col("remove"), moment(last["clear"]), moment(last["purge"]), opts))
    return answers, kept.select("ip", F.timestamp_micros("add.us").alias("ts"), F.col("add.seq").alias("seq"))
