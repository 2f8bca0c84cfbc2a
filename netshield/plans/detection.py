"""From access logs to alerts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netshield.constants import FEATURES
from netshield.operators.features import last_windows, minute_features
from netshield.operators.hostnames import match_hostname
from netshield.operators.lookup import match_geo
from netshield.operators.panes import Panes, pane_counts, panes
from netshield.operators.preview import previews
from netshield.operators.scoring import Scorer, decide
from netshield.operators.ticks import scored_windows, tick_features
from netshield.options import Options
from netshield.session import broadcast_if_small, rows_within, settle

_SUMMARY = ("ip", "req_count", "rps", "req_rate", "err_rate", "problem", "normal", "speed")


def summarize(scored: DataFrame, speed: Column | None = None) -> DataFrame:
    """Adds the rounded figures of an alert and their one-line ``message``."""
    speed = F.lit(0.0) if speed is None else speed
    figures = scored.withColumns({
        "req_count": F.col("request_count"),
        "rps": F.bround("requests_per_second", 2),
        "req_rate": F.bround("request_rate", 2),
        "err_rate": F.bround("error_rate", 2),
        "problem": F.bround(F.col("p") * 100, 0).cast("int"),
        "normal": F.bround((1 - F.col("p")) * 100, 0).cast("int"),
        "speed": F.bround(speed, 3),
    })
    text = F.concat_ws(", ", *[
        F.concat(F.lit(f"{name}: "), F.col(name).cast("string")) for name in _SUMMARY])
    return figures.withColumn("message", text)


def gate(scored: DataFrame, opts: Options = Options()) -> DataFrame:
    return scored.where((F.col("p") >= opts.threshold) & (F.col("request_rate") >= opts.min_rps))


def split_results(scored: DataFrame, opts: Options = Options()) -> tuple[DataFrame, DataFrame]:
    """Normal and problem rows."""
    problem = (F.col("p") >= opts.threshold) & (F.col("request_rate") >= opts.min_rps)
    return scored.where(~problem), scored.where(problem)


def score_history(logs: DataFrame, scorer: Scorer, opts: Options = Options()) -> DataFrame:
    """Each address's newest window with its features and probability."""
    return decide(scorer(last_windows(minute_features(logs, opts))), opts)


def score_ticks(logs: DataFrame, scorer: Scorer, opts: Options = Options()) -> DataFrame:
    """Every evaluation ``(ip, tick)`` with its features and probability."""
    held = panes(logs, opts)
    groups = settle(scored_windows(held.states, opts), "windows")
    return decide(scorer(tick_features(held, groups, opts)), opts)


def _busy_windows(counts: DataFrame, opts: Options, after_us: int | None, until_us: int | None) -> DataFrame:
    """Scored windows that reach the gate's request rate, which counts alone decide."""
    scored = scored_windows(counts, opts, after_us, until_us)
    return scored.where(F.col("n") / opts.window_seconds >= opts.min_rps)


def detections(logs: DataFrame, scorer: Scorer, opts: Options = Options(),
               after_us: int | None = None, until_us: int | None = None) -> DataFrame:
    """Evaluations that pass the gate, optionally only those with ``after_us < tick <= until_us``.

    Windows below the gate's rate are dropped before any feature work.
    """
    held = panes(busy_requests(logs, opts, after_us, until_us), opts)
    return _gated(held, settle(_busy_windows(held.states, opts, after_us, until_us), "windows"), scorer, opts)


def _gated(held: Panes, busy: DataFrame, scorer: Scorer, opts: Options) -> DataFrame:
    return gate(decide(scorer(tick_features(held, busy, opts)), opts), opts)


def raised_alerts(logs: DataFrame, scorer: Scorer, opts: Options = Options(),
                  after_us: int | None = None, until_us: int | None = None) -> DataFrame:
    """The detections that raise an alert, with ``resumed_us``, where their address's series began.

    An alert deletes its address's series, and nothing is collected until the block ends. So each
    round takes every address's first detection and continues, for the few addresses that are busy
    again later, with their panes from the end of the block on. There are as many rounds as an
    address can be blocked within the time span of the input. The whole log is read for the first
    counts of panes only; ``busy_requests`` are aggregated into panes once, for all rounds.
    """
    return _raised(busy_requests(logs, opts, after_us, until_us), scorer, opts, after_us, until_us)


def busy_requests(logs: DataFrame, opts: Options = Options(), after_us: int | None = None,
                  until_us: int | None = None) -> DataFrame:
    """The requests of addresses that reach the gate's rate at some tick, written once.

    A series cut by an alert is never busier than the whole, so no other address can be detected.
    """
    busy = settle(_busy_windows(pane_counts(logs, opts), opts, after_us, until_us).select("ip").distinct(), "busy")
    return settle(logs.join(broadcast_if_small(busy, opts.broadcast_rows), "ip", "left_semi"), "requests")


def _raised(logs: DataFrame, scorer: Scorer, opts: Options, after_us: int | None, until_us: int | None) -> DataFrame:
    block_us = opts.block_seconds * 1_000_000
    held = whole = panes(logs, opts)
    starts, rounds = None, []
    while True:
        busy = settle(_busy_windows(held.states, opts, after_us, until_us), "windows")
        found = settle(_gated(held, busy, scorer, opts), "detections")
        firsts = found.groupBy("ip").agg(F.min("tick").alias("tick"))
        alerts = found.join(firsts, ["ip", "tick"], "left_semi")
        if starts is None:
            alerts = alerts.withColumn("resumed_us", F.lit(0).cast("long"))
        else:
            alerts = alerts.join(starts, "ip")
        rounds.append(alerts)
        resumed = firsts.select("ip", (F.col("tick") + block_us).alias("resumed_us"))
        later = busy.select("ip", "tick").join(resumed, "ip").where(F.col("tick") >= F.col("resumed_us"))
        starts = settle(later.select("ip", "resumed_us").distinct(), "resumed")
        if rows_within(starts, 0):
            return reduce(DataFrame.unionByName, rounds)
        held = whole.resumed(broadcast_if_small(starts, opts.broadcast_rows), opts)


def _behind(logs: DataFrame, alerts: DataFrame, opts: Options) -> DataFrame:
    """The requests in the trailing window of each alert, without those before its series resumed."""
    wanted = broadcast_if_small(alerts.select("ip", "tick", "resumed_us"), opts.broadcast_rows)
    us = F.unix_micros("ts")
    return logs.withColumn("us", us).join(wanted, "ip").where(
        F.col("us").between(F.col("tick") - opts.window_us, F.col("tick")) & (F.col("us") >= F.col("resumed_us")))


def detect(logs: DataFrame, scorer: Scorer, hostnames: DataFrame | None = None,
           geo: DataFrame | None = None, opts: Options = Options(), after_us: int | None = None,
           until_us: int | None = None) -> DataFrame:
    """Alerts, one per address and block period.

    ``logs`` are eligible typed rows with ``seq``. Each alert carries its window's first domain, its
    location (looked up in ``geo`` for the few alerted addresses), the name found in ``hostnames``,
    a preview of its requests and its feature row.
    """
    logs = busy_requests(logs, opts, after_us, until_us)
    alerts = settle(summarize(_raised(logs, scorer, opts, after_us, until_us)), "alerts")
    behind = _behind(logs, alerts, opts)
    first = behind.groupBy("ip", "tick").agg(
        F.min_by("domain", F.struct("us", "seq")).alias("domain"))
    full = alerts.join(first, ["ip", "tick"]).join(previews(behind, ["ip", "tick"]), ["ip", "tick"])
    full = full.withColumn("alert_ts", F.timestamp_micros("tick"))
    nowhere = F.lit(None).cast("struct<country:string,region:string,city:string>")
    if hostnames is None:
        full = full.withColumn("ptr", F.lit(None).cast("string"))
    else:
        full = match_hostname(full, "ip", "alert_ts", hostnames, opts)
    if geo is None:
        full = full.withColumns(
            {"ip2location": nowhere, "country": F.lit("NA"), "city": F.lit("NA")})
    else:
        full = match_geo(full, "ip", geo, opts)
    return full.select(
        "alert_ts", *_SUMMARY, "message", "ptr", "timestamp",
        "domain", F.lit(opts.alert_priority).alias("priority"), F.lit(opts.alert_tag).alias("tag"),
        "ip_data", "ip_data_rows_total", "ip_data_rows_preview",
        F.struct(*FEATURES).alias("last_feature"), "ip2location", "country", "city")


def new_blocks(alerts: DataFrame, opts: Options = Options()) -> DataFrame:
    """Blocklist entries for the alerts, for external enforcement."""
    entries = alerts.groupBy("ip").agg(F.max("alert_ts").alias("added_at"))
    until = F.timestamp_micros(F.unix_micros("added_at") + opts.block_seconds * 1_000_000)
    return entries.withColumn("expires_at", until)
