"""Reverse-DNS names from a table of earlier resolutions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netshield.options import Options
from netshield.session import rows_within


#: Slices in which an answer's life is cut to order an address's answers and requests.
SLICES = 16


def match_hostname(df: DataFrame, ip: str, ts: str, resolved: DataFrame,
                   opts: Options = Options()) -> DataFrame:
    """As-of lookup in ``resolved(ip, hostname, resolved_at)``.

    Adds ``ptr`` and ``ptr_known``: the newest answer younger than the timeout, where a NULL
    hostname is a known negative answer; of answers of one instant the largest name counts. Answers
    without a time are left out; requests without an address or a time stay, without an answer.

    Nothing orders an address's whole history: answers and requests are ordered inside slices of time,
    and what a slice starts with is carried from the slices before it that are still alive. Answers
    within ``broadcast_rows`` (counted) become intervals that are broadcast; otherwise both sides meet
    by (address, slice).
    """
    life = opts.hostname_timeout_seconds * 1_000_000
    answers = resolved.where("ip IS NOT NULL AND resolved_at IS NOT NULL").groupBy(
        "ip", F.unix_micros("resolved_at").alias("from_us")).agg(F.max("hostname").alias("ptr"))
    if rows_within(resolved, opts.broadcast_rows):
        return _by_intervals(df, ip, ts, answers, life)
    return _by_slices(df, ip, ts, answers, life)


def _slice(us: Column, width: int) -> Column:
    return F.floor(us / width).cast("bigint")


def _near(marks: DataFrame, slices: int, ahead: bool) -> DataFrame:
    """Copies of ``(ip, slice, ...)`` by ``block`` such that each slice's own block also holds the ``slices`` before or after it."""
    own = F.floor(F.col("slice") / slices).cast("bigint")
    return marks.withColumn("block", F.explode(F.array(own, own - 1 if ahead else own + 1)))


def _by_intervals(df: DataFrame, ip: str, ts: str, answers: DataFrame, life: int) -> DataFrame:
    """Answers as disjoint intervals, joined on (address, stretch of one life) with at most one match a row."""
    width = max(1, life // SLICES)
    sliced = answers.withColumn("slice", _slice(F.col("from_us"), width))
    inside = Window.partitionBy("ip", "slice").orderBy("from_us")
    over = Window.partitionBy("ip", "block").orderBy("slice")
    # the next answer of another slice only matters within a life, that is SLICES slices and a rest
    firsts = sliced.groupBy("ip", "slice").agg(F.min("from_us").alias("first"))
    following = _near(firsts, SLICES + 2, ahead=True).withColumn("after", F.lead("first").over(over))
    following = following.where(F.col("block") == F.floor(F.col("slice") / (SLICES + 2))).select("ip", "slice", "after")
    ends = sliced.withColumn("next", F.lead("from_us").over(inside)).join(following, ["ip", "slice"])
    bounded = ends.withColumn("to_us", F.least(F.col("from_us") + life, "next", "after"))
    stretch = _slice(F.col("from_us"), life), _slice(F.col("to_us") - 1, life)
    table = bounded.select(F.col("ip").alias("_ip"), F.explode(F.sequence(*stretch)).alias("_stretch"),
                           F.col("from_us").alias("_from"), F.col("to_us").alias("_to"), "ptr")
    at = F.unix_micros(ts)
    matched = df.join(F.broadcast(table), (F.col(ip) == F.col("_ip")) & (_slice(at, life) == F.col("_stretch"))
                      & (at >= F.col("_from")) & (at < F.col("_to")), "left")
    return matched.withColumn("ptr_known", F.col("_from").isNotNull()).drop("_ip", "_stretch", "_from", "_to")


def _by_slices(df: DataFrame, ip: str, ts: str, answers: DataFrame, life: int) -> DataFrame:
    """Answers and requests merged in slices; the last answer before a slice comes in as a row of its own."""
    width = max(1, life // SLICES)
    answer = F.struct("from_us", "ptr")
    said = answers.select("ip", F.col("from_us").alias("us"), answer.alias("answer"), _slice(F.col("from_us"), width).alias("slice"))
    asked = df.select(F.col(ip).alias("ip"), F.unix_micros(ts).alias("us"), F.struct(*df.columns).alias("row"))
    # rows that can't be asked are spread over slices that hold nothing for them
    spread = F.when(F.col("ip").isNotNull(), _slice(F.col("us"), width))
    asked = asked.withColumn("slice", F.coalesce(spread, -1 - F.pmod(F.monotonically_increasing_id(), F.lit(1024))))

    lasts = said.groupBy("ip", "slice").agg(F.max("answer").alias("answer"))
    wanted = asked.where("ip IS NOT NULL AND us IS NOT NULL").select("ip", "slice").distinct()
    marks = _near(lasts, SLICES + 2, ahead=False).unionByName(
        wanted.withColumn("block", F.floor(F.col("slice") / (SLICES + 2)).cast("bigint")).withColumn("wanted", F.lit(True)),
        allowMissingColumns=True)
    before = Window.partitionBy("ip", "block").orderBy("slice").rangeBetween(Window.unboundedPreceding, -1)
    carried = marks.withColumn("answer", F.max("answer").over(before)).where("wanted AND answer IS NOT NULL").select(
        "ip", "slice", F.col("answer.from_us").alias("us"), "answer")

    rows = asked.unionByName(said, allowMissingColumns=True).unionByName(carried, allowMissingColumns=True)
    so_far = Window.partitionBy("ip", "slice").orderBy("us").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    newest = rows.withColumn("newest", F.max("answer").over(so_far)).where("row IS NOT NULL")
    known = F.coalesce((F.col("newest.from_us") > F.col("us") - life) & F.col("ip").isNotNull() & F.col("us").isNotNull(), F.lit(False))
    return newest.select("row.*", F.when(known, F.col("newest.ptr")).alias("ptr"), known.alias("ptr_known"))


def to_resolve(matched: DataFrame, ip: str) -> DataFrame:
    """Distinct addresses without a usable answer, for an external resolver."""
    return matched.where(~F.col("ptr_known")).select(ip).distinct()


def newest_hostnames(resolved: DataFrame) -> DataFrame:
    """The newest answer per address."""
    return resolved.groupBy("ip").agg(
        F.max_by("hostname", "resolved_at").alias("hostname"),
        F.max("resolved_at").alias("resolved_at"))
