"""Periodic evaluation: every few seconds, each active address over its trailing window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netshield.operators.features import with_window
from netshield.operators.panes import Panes, merged_features, over_ticks
from netshield.options import Options
from netshield.session import broadcast_if_small

KEYS = ["ip", "tick", "win"]


def tick_rows(logs: DataFrame, opts: Options = Options()) -> DataFrame:
    """Each request once per evaluation time whose window ``[tick - window, tick]`` holds it.

    For work on the requests themselves, such as previews; features come from panes.
    """
    step, span = opts.tick_seconds * 1_000_000, opts.window_us
    ticks = F.expr(
        f"sequence((us + {step - 1}) div {step} * {step}, (us + {span}) div {step} * {step}, {step}L)")
    return with_window(logs, opts).withColumn("tick", F.explode(ticks))


def scored_windows(panes: DataFrame, opts: Options = Options(), after_us: int | None = None,
                   until_us: int | None = None) -> DataFrame:
    """The (ip, tick, win) groups that are scored, from counts of panes.

    An address needs enough requests in the trailing window and one in the look-back; its latest
    occupied calendar window is the one that counts.
    """
    counts = over_ticks(panes.select("ip", "win", "pane", "n", "last_us"), opts, after_us, until_us).groupBy(*KEYS).agg(
        F.sum("n").alias("n"), F.max("last_us").alias("last_us"))
    latest = counts.groupBy("ip", "tick").agg(
        F.sum("n").alias("total"), F.max("last_us").alias("last_us"), F.max("win").alias("win"),
        F.max_by("n", "win").alias("n"))
    return latest.where(
        (F.col("total") >= opts.min_records)
        & (F.col("last_us") >= F.col("tick") - opts.lookback_seconds * 1_000_000))


def tick_features(panes: Panes, groups: DataFrame, opts: Options = Options()) -> DataFrame:
    """Feature rows of the given groups only, each merged from the panes of its window."""
    wanted = broadcast_if_small(groups.select(*KEYS), opts.broadcast_rows)
    held = [over_ticks(df, opts).join(wanted, KEYS, "left_semi") for df in (panes.states, panes.values)]
    return merged_features(*held, KEYS, opts)
