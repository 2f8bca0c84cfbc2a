"""Mergeable partial states of an address's requests, from which periodic evaluations are put together.

Time is cut into panes by the greatest common divisor of the evaluation step, the window and the block,
so that all of these start and end on pane borders. As windows hold both their ends, an instant on a
border is a pane of its own: the interior after border ``k`` has number ``2k + 1``, the border ``2k``.
A pane's state has counts, moments and extremes of bytes and times, the run of its gaps, and its
value counts. Requests are aggregated once; evaluations merge the few panes of their window.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netshield.operators.features import (
    counter_features, counter_sums, diversity_of, gap_features, gap_slices, joined_features, merged_runs,
    value_counts, with_window,
)
from netshield.options import Options
from netshield.session import settle

KEYS = ["ip", "win", "pane"]
_COUNTS = ("n", "gets", "posts", "versions", "http1", "http2", "errors", "errors4", "errors5")
#: Whole units of bytes and seconds, whose sums don't depend on their order.
_UNITS = {"b": 1, "t": 1_000_000_000}
_RUN = ("n", "first_us", "last_us", "s2", "s3", "s4", "starts", "near", "near_us", "second_near", "last_near")


def pane_us(opts: Options = Options()) -> int:
    """Width of a pane."""
    return gcd(opts.tick_seconds * 1_000_000, opts.window_us, opts.block_seconds * 1_000_000)


def first_pane(us: Column, opts: Options = Options()) -> Column:
    """The pane that starts with an instant on a border."""
    return F.call_function("div", us, F.lit(pane_us(opts))) * 2


def with_panes(logs: DataFrame, opts: Options = Options()) -> DataFrame:
    width = pane_us(opts)
    return with_window(logs, opts).withColumn("pane", F.expr(f"us div {width} * 2 + IF(us % {width} = 0, 0, 1)"))


def pane_counts(logs: DataFrame, opts: Options = Options()) -> DataFrame:
    """Requests and the latest instant of every address and pane."""
    return with_panes(logs, opts).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.max("us").alias("last_us"))


@dataclass(frozen=True)
class Panes:
    """``states`` has a row for every address and pane, ``values`` one for each value in it."""

    states: DataFrame
    values: DataFrame

    def resumed(self, starts: DataFrame, opts: Options = Options()) -> Panes:
        """The panes of the addresses of ``starts``, each from its ``resumed_us`` on."""
        return Panes(*[df.join(starts, "ip").where(F.col("pane") >= first_pane(F.col("resumed_us"), opts))
                       for df in (self.states, self.values)])


def _moments(sums: DataFrame) -> DataFrame:
    """Statistics of bytes and times as sums of powers about the pane's own mean."""
    out = sums
    for x in ("b", "t"):
        n = F.col(f"{x}_n")
        shape = lambda name: F.coalesce(F.nanvl(F.col(name), F.lit(0.0)), F.lit(0.0))
        out = out.withColumn(f"{x}_m2", F.coalesce(F.col(f"{x}_std") * F.col(f"{x}_std") * (n - 1), F.lit(0.0)))
        m2 = F.col(f"{x}_m2")
        out = out.withColumns({
            f"{x}_m3": F.when(m2 > 0, shape(f"{x}_skew") * F.pow(m2, F.lit(1.5)) / F.sqrt(n)).otherwise(F.lit(0.0)),
            f"{x}_m4": F.when(m2 > 0, (shape(f"{x}_kurt") + 3) * m2 * m2 / n).otherwise(F.lit(0.0)),
        })
    kept = [f"{x}_{name}" for x in ("b", "t") for name in ("n", "units", "mean", "m2", "m3", "m4", "min", "max")]
    return out.select(*KEYS, *_COUNTS, "first_us", "last_us", *kept)


def panes(logs: DataFrame, opts: Options = Options()) -> Panes:
    """The states of all panes of a log, written once."""
    rows = with_panes(logs, opts)
    runs = merged_runs(gap_slices(rows, KEYS, opts), KEYS, "slice", False, opts)
    run = F.struct(*_RUN).alias("run")
    units = [F.sum(F.round(F.col(x) * scale).try_cast("bigint")).alias(f"{x}_units") for x, scale in _UNITS.items()]
    states = _moments(counter_sums(rows, KEYS, *units)).join(runs.select(*KEYS, run), KEYS)
    return Panes(settle(states, "panes"), settle(value_counts(rows, KEYS), "pane-values"))


def over_ticks(df: DataFrame, opts: Options = Options(), after_us: int | None = None, until_us: int | None = None) -> DataFrame:
    """Each pane once per evaluation ``tick`` whose window holds it, of ``after_us < tick <= until_us``."""
    width = pane_us(opts)
    step, reach = opts.tick_seconds * 1_000_000 // width, opts.window_us // width
    ticks = F.expr(f"transform(sequence(((pane + 1) div 2 + {step - 1}) div {step} * {step}, "
                   f"(pane div 2 + {reach}) div {step} * {step}, {step}L), x -> x * {width})")
    out = df.withColumn("tick", F.explode(ticks))
    if after_us is not None:
        out = out.where(F.col("tick") > after_us)
    return out if until_us is None else out.where(F.col("tick") <= until_us)


def merged_counters(states: DataFrame, keys: Sequence[str], opts: Options = Options()) -> DataFrame:
    """Counter features of groups of panes.

    Moments are moved from each pane's mean to the group's before they are added, which keeps them
    exact however far apart the panes' means lie.
    """
    group, moved = Window.partitionBy(*keys), states
    for x in ("b", "t"):
        n, mean, m2, m3, m4 = (F.col(f"{x}_{name}") for name in ("n", "mean", "m2", "m3", "m4"))
        moved = moved.withColumn(f"{x}_d", mean - F.sum(n * mean).over(group) / F.sum(n).over(group))
        d = F.col(f"{x}_d")
        moved = moved.withColumns({
            f"{x}_s2": m2 + n * d * d,
            f"{x}_s3": m3 + 3 * d * m2 + n * F.pow(d, F.lit(3)),
            f"{x}_s4": m4 + 4 * d * m3 + 6 * d * d * m2 + n * F.pow(d, F.lit(4)),
        })
    sums = [*_COUNTS, *(f"{x}_{name}" for x in ("b", "t") for name in ("n", "units", "s2", "s3", "s4"))]
    out = moved.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in sums], F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"),
        *[fn(f"{x}_{name}").alias(f"{x}_{name}") for x in ("b", "t") for name, fn in (("min", F.min), ("max", F.max))])
    for x in ("b", "t"):
        n, s2, s3, s4 = (F.col(f"{x}_{name}") for name in ("n", "s2", "s3", "s4"))
        # equal values have no spread, whatever rounding says
        varied = (F.col(f"{x}_min") < F.col(f"{x}_max")) & (s2 > 0)
        out = out.withColumns({
            f"{x}_mean": F.when(n > 0, F.col(f"{x}_units") / (n * _UNITS[x])),
            f"{x}_std": F.when(n > 1, F.when(varied, F.sqrt(s2 / (n - 1))).otherwise(F.lit(0.0))),
            f"{x}_skew": F.when(varied, F.sqrt(n) * s3 / F.pow(s2, F.lit(1.5))),
            f"{x}_kurt": F.when(varied, n * s4 / (s2 * s2) - 3),
        })
    return counter_features(out, keys, opts)


def merged_features(states: DataFrame, values: DataFrame, keys: Sequence[str], opts: Options = Options()) -> DataFrame:
    """All features of groups of panes."""
    keys = list(keys)
    runs = states.select(*keys, "pane", "run.*")
    counts = values.groupBy(*keys, "field", "value").agg(F.sum("n").alias("n"))
    return joined_features(
        merged_counters(states, keys, opts), gap_features(merged_runs(runs, keys, "pane", True, opts), keys),
        diversity_of(counts, keys), keys)
