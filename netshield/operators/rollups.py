"""Report aggregates: traffic, known networks and delivery counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def traffic(enriched: DataFrame, every: str = "1 minute") -> DataFrame:
    """Requests, errors and bytes per time step, by country and city with subtotals.

    Bytes are a wide decimal, as forged sizes may add up beyond a bigint.
    """
    timed = enriched.withColumn("win", F.window("ts", every)["start"])
    return timed.rollup("win", "country", "city").agg(
        F.count(F.lit(1)).alias("requests"),
        F.count(F.when(F.col("status") >= 400, 1)).alias("errors"),
        F.sum(F.col("bytes_sent").cast("decimal(20,0)")).alias("bytes"),
        F.grouping_id().alias("level"))


CELLS = "win timestamp, country string, city string, requests bigint, errors bigint, bytes decimal(38,0)"
_PLACE = ("win", "country", "city")


def traffic_cells(enriched: DataFrame, every: str = "1 minute") -> DataFrame:
    """The finest level of ``traffic``, of some of the requests; ``CELLS``."""
    return enriched.groupBy(F.window("ts", every)["start"].alias("win"), "country", "city").agg(
        F.count(F.lit(1)).alias("requests"), F.count(F.when(F.col("status") >= 400, 1)).alias("errors"),
        F.sum(F.col("bytes_sent").cast("decimal(20,0)")).cast("decimal(38,0)").alias("bytes"))


def _sums() -> list[Column]:
    return [F.sum(name).alias(name) for name in ("requests", "errors", "bytes")]


def combine_cells(cells: DataFrame) -> DataFrame:
    """One cell for the cells of one step and place."""
    return cells.groupBy(*_PLACE).agg(*_sums())


def traffic_of_cells(cells: DataFrame) -> DataFrame:
    """What ``traffic`` gives for all requests that the cells count."""
    return cells.rollup(*_PLACE).agg(*_sums(), F.grouping_id().alias("level"))


def known_networks(enriched: DataFrame, every: str = "1 minute") -> DataFrame:
    """Requests of known networks per time step, category and name."""
    named = enriched.where(F.col("bot_name").isNotNull())
    return named.groupBy(
        F.window("ts", every)["start"].alias("win"), "bot_category", "bot_name", "bot_support"
    ).agg(F.count(F.lit(1)).alias("requests"))


def search_traffic(enriched: DataFrame, every: str = "1 minute") -> DataFrame:
    """Search-engine requests per time step and path."""
    crawled = enriched.where(F.col("bot_category").isin("search", "minor_search"))
    return crawled.groupBy(
        F.window("ts", every)["start"].alias("win"), "bot_name", "http_uri"
    ).agg(F.count(F.lit(1)).alias("requests"),
          F.count(F.when(F.col("status") >= 400, 1)).alias("errors"))


def detection_counts(alerts: DataFrame, every: str = "1 minute") -> DataFrame:
    return alerts.groupBy(F.window("alert_ts", every)["start"].alias("win"), "country").agg(
        F.count(F.lit(1)).alias("alerts"), F.max("problem").alias("highest"))


def counted(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Count rows as they pass, without another job; read the number after the action."""
    observation = Observation(name)
    return df.observe(observation, F.count(F.lit(1)).alias("rows")), observation


def message_counters(messages: DataFrame) -> DataFrame:
    """Accepted and dropped messages by reason."""
    return messages.groupBy(F.coalesce("reason", F.lit("accepted")).alias("outcome")).agg(
        F.count(F.lit(1)).alias("messages"))
