"""Deterministic test traffic in the syslog format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Choices of the smoke-test traffic.
STATUSES = (200, 200, 200, 200, 404, 500, 301)
METHODS = ("GET", "POST")
PATHS = ("/api/users", "/api/orders", "/test-endpoint", "/images", "/api/auth")
TEST_IP = "100.100.100.100"
AGENT = "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36"
PRIORITY, SENDER_TAG, CACHE, UPSTREAM, REFERRER_PATH = "<13>", "app", "HIT", "10.0.1.50:8080", "/dashboard"
#: Each field draws with a multiplier of its own, modulo a prime, so that any engine can repeat it.
PRIME = 1_000_003
DRAWS = {"method": 7919, "path": 104_729, "status": 15_485, "time": 32_452, "upstream": 49_979, "bytes": 67_867,
         "requests": 86_028, "length": 1_299}


def _between(number: Column, field: str, low: int, count: int) -> Column:
    drawn = F.pmod(F.pmod(number, F.lit(PRIME)) * DRAWS[field] + DRAWS[field] // 7, F.lit(PRIME))
    return drawn % count + low


def _pick(values: tuple, number: Column, field: str) -> Column:
    choice = _between(number, field, 1, len(values))
    return F.element_at(F.array(*map(F.lit, values)), choice.cast("int"))


def traffic(numbers: DataFrame, start: Column, domain: str = "example.com", ip: str = TEST_IP,
            step_ms: int = 10) -> DataFrame:
    """One syslog datagram per ``number``, ``step_ms`` apart; equal numbers give equal requests."""
    n = F.col("number")
    ts = F.timestamp_micros(F.unix_micros(start) + n * (step_ms * 1000))
    request = F.concat(_pick(METHODS, n, "method"), F.lit(" "), _pick(PATHS, n, "path"), F.lit("/"),
                       n.cast("string"), F.lit(" HTTP/1.1"))
    payload = F.to_json(F.struct(
        F.lit(domain).alias("domain"),
        F.format_string("%.3f", F.unix_millis(ts) / 1000).alias("timestamp"),
        F.date_format(ts, "dd/MMM/yyyy:HH:mm:ss xx").alias("timestamp_local"),
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssxxx").alias("timestamp_iso8601"),
        F.lit(ip).alias("remote_addr"), request.alias("request"),
        _pick(STATUSES, n, "status").cast("string").alias("response_status"),
        _between(n, "bytes", 500, 5000).cast("string").alias("body_bytes_sent"),
        F.lit(f"https://{domain}{REFERRER_PATH}").alias("http_referrer"),
        F.lit(AGENT).alias("http_user_agent"),
        F.concat(F.lit("0."), _between(n, "time", 100, 999).cast("string")).alias("request_time"),
        (n + 12000).cast("string").alias("connection"),
        _between(n, "requests", 1, 10).cast("string").alias("connection_requests"),
        _between(n, "length", 200, 1000).cast("string").alias("request_length"),
        F.lit(CACHE).alias("upstream_cache_status"), F.lit(UPSTREAM).alias("upstream_addr"),
        F.lit("").alias("http_x_forwarded_for"),
        F.concat(F.lit("0."), _between(n, "upstream", 50, 200).cast("string")).alias("upstream_response_time")))
    line = F.concat(F.lit(PRIORITY), F.date_format(ts, "MMM d HH:mm:ss"), F.lit(f" {domain} {SENDER_TAG}: "), payload)
    return numbers.select(
        F.lit("127.0.0.1").alias("client_address"), line.cast("binary").alias("data"),
        ts.alias("recv_ts"))


def numbered(spark: SparkSession, requests: int) -> DataFrame:
    return spark.range(requests).withColumnRenamed("id", "number")
