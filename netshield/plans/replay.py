"""Offline replay of a labelled capture, request by request."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netshield.operators.positions import with_position
from netshield.operators.running import running_features
from netshield.operators.scoring import Scorer, decide
from netshield.options import Options
from netshield.session import settle

REPLAY_SCHEMA = (
    "ip string, timestamp timestamp, request string, status int, bytes_sent bigint, "
    "request_time double"
)


def read_replay(spark: SparkSession, path: str) -> DataFrame:
    """Headed CSV as detector input; ``seq`` numbers rows in time order."""
    rows = spark.read.schema(REPLAY_SCHEMA).option("header", True).csv(path)
    typed = rows.select(
        "ip", F.col("timestamp").alias("ts"), "request", "status", "bytes_sent", "request_time",
        F.unix_micros("timestamp").alias("us"), F.lit("").alias("_all"))
    placed = with_position(typed, ["_all"], ["ip", "request"])
    return placed.withColumnRenamed("pos", "seq").drop("_all", "us")


def replay_report(logs: DataFrame, scorer: Scorer, opts: Options = Options()) -> DataFrame:
    """Detected requests in order, with the running number of detections."""
    scored = decide(scorer(running_features(logs, opts)), opts)
    found = settle(scored.where("is_ddos").select(
        "seq", F.unix_micros("timestamp").alias("us"), F.col("timestamp").alias("ts"), "ip",
        F.bround(F.col("p") * 100, 0).cast("int").alias("ddos_percent"),
        F.bround((1 - F.col("p")) * 100, 0).cast("int").alias("normal_percent")), "found")
    numbered = with_position(found.withColumn("_all", F.lit("")), ["_all"], ["seq"])
    statuses = logs.select("seq", "status")
    return numbered.join(statuses, "seq").select(
        F.col("seq").alias("line"), "ts", "status", "ip", "ddos_percent", "normal_percent",
        F.col("pos").alias("detections"))
