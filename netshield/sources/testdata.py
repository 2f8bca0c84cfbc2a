"""Access-log view of the driver's ``events`` table.

Time is compressed 7200-fold (30 days become 6 minutes) so that per-minute rates are realistic;
one address receives a fifth of all requests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH_US = 1_704_067_200_000_000
COMPRESSION = 7200


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def access_logs(events_df: DataFrame) -> DataFrame:
    """Typed access log (detector input) plus ``seq``, a unique arrival number."""
    user, event = F.col("user_id"), F.col("event_id")
    slot = user % 10
    host = (user % 250).cast("string")
    elapsed = F.unix_micros(F.col("ts").cast("timestamp")) - EPOCH_US
    kind = F.col("event_type")
    ip = (
        F.when(slot.isin(0, 5), F.lit("100.100.100.100"))
        .when(slot == 1, F.concat(F.lit("31.13.64."), host))
        .when(slot == 2, F.concat(F.lit("1.117.3."), host))
        .when(slot == 3, F.lit("2.56.150.9"))
        .when(slot == 4, F.lit("2607:6bc0:0:1::5"))
        .when(slot == 6, F.concat(F.lit("10.1.2."), host))
        .otherwise(F.concat(F.lit("203.0.113."), (user % 20).cast("string")))
    )
    method = (
        F.when(kind.isin("view", "click"), "GET").when(kind == "error", "HEAD").otherwise("POST")
    )
    path = F.when(event % 13 == 0, "/a/app.js").otherwise(
        F.concat(F.lit("/p/"), (event % 17).cast("string"))
    )
    version = F.when(user % 3 == 0, "HTTP/2.0").otherwise("HTTP/1.1")
    status = (
        F.when((kind == "error") & (event % 2 == 0), 404)
        .when(kind == "error", 500)
        .when(event % 7 == 0, 301)
        .otherwise(200)
    )
    return events_df.select(
        event.alias("seq"),
        ip.alias("ip"),
        F.timestamp_micros(
            EPOCH_US + ((elapsed - elapsed % COMPRESSION) / COMPRESSION).cast("bigint")
        ).alias("ts"),
        F.concat(F.lit("d"), (user % 3).cast("string"), F.lit(".example.com")).alias("domain"),
        F.concat_ws(" ", method, path, version).alias("request"),
        (event % 800 + 200).alias("request_length"),
        status.cast("int").alias("status"),
        F.round(F.col("value") * 100).cast("bigint").alias("bytes_sent"),
        (F.col("value") / 1000).alias("request_time"),
        F.concat(F.lit("agent/"), (user % 7).cast("string")).alias("user_agent"),
    )


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access_logs(events(spark, sf_dir))
