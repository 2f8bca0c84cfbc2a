"""Syslog lines with a JSON payload → typed access logs and a quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netshield.constants import (
    JSON_PATTERN, MAX_DATAGRAM_BYTES, PAYLOAD_FIELDS, SYSLOG_PATTERN,
)
from netshield.functions.maps import last_wins
from netshield.session import compute_once

RAW_SCHEMA = "client_address string, data binary, recv_ts timestamp"


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Captured datagrams, one row each, in ``RAW_SCHEMA``."""
    return spark.read.schema(RAW_SCHEMA).parquet(path)


def read_lines(spark: SparkSession, path: str, client_address: str, recv_ts: Column) -> DataFrame:
    """Plain text capture, one message per line."""
    text = spark.read.text(path)
    return text.select(
        F.lit(client_address).alias("client_address"), F.col("value").cast("binary").alias("data"),
        recv_ts.alias("recv_ts"))


def decode(data: Column) -> Column:
    """UTF-8, or Latin-1 where the bytes are not valid UTF-8; surrounding white space removed."""
    text = F.when(F.is_valid_utf8(data.cast("string")), data.cast("string")).otherwise(
        F.decode(data, "ISO-8859-1"))
    return F.btrim(text, F.lit(" \t\n\r\x0b\x0c"))


def parse_messages(raw: DataFrame) -> DataFrame:
    """Adds the syslog header parts, ``payload`` (map of text) and ``reason`` for unusable rows."""
    oversize = F.octet_length("data") > MAX_DATAGRAM_BYTES
    lines = compute_once(
        raw.select("client_address", "recv_ts", "data"),
        line=F.when(~oversize, decode(F.col("data"))))
    # One pass marks the four header groups; whatever follows the message's line is dropped.
    pattern = f"(?d){SYSLOG_PATTERN}"
    marked = F.regexp_replace("line", pattern + r"(?s:.*)\z", "$1\u0001$2\u0001$3\u0001$4")
    headed = compute_once(
        lines, parts=F.when(F.col("line").rlike(pattern), F.split(marked, "\u0001", 4)))
    message = F.get("parts", F.lit(3))
    json = F.nullif(F.regexp_extract(message, f"(?d){JSON_PATTERN}", 0), F.lit(""))
    opened = compute_once(headed, json=json)
    # The brackets make trailing text an error instead of being ignored.
    objects = F.from_json(
        F.concat(F.lit("["), "json", F.lit("]")), "array<map<string,string>>",
        {"allowSingleQuotes": "false"})
    parsed = compute_once(opened, objects=objects)
    parsed = compute_once(parsed, payload=last_wins(F.when(F.size("objects") == 1, F.get("objects", F.lit(0)))))
    payload = F.col("payload")
    return parsed.select(
        "client_address", "recv_ts", "data",
        F.get("parts", F.lit(0)).try_cast("int").alias("priority"),
        F.get("parts", F.lit(1)).alias("header_time"),
        F.get("parts", F.lit(2)).alias("hostname"),
        message.alias("message"),
        payload.alias("payload"),
        F.when(oversize, "oversize")
        .when(F.col("parts").isNull(), "no header")
        .when(F.col("json").isNull(), "no json")
        .when(payload.isNull(), "bad json")
        .when(payload["remote_addr"].isNull(), "no remote_addr")
        .when(payload["request"].isNull(), "no request")
        .alias("reason"),
    )


def parsed_logs(messages: DataFrame, time_field: str | None = None) -> DataFrame:
    """Usable messages with one text column per payload field.

    ``ts`` is the arrival time; ``time_field`` selects a payload field with epoch seconds instead.
    Payload keys outside the known ones stay in ``extras``.
    """
    payload = F.col("payload")
    arrival = F.col("recv_ts")
    if time_field:
        event = F.timestamp_micros(F.round(payload[time_field].try_cast("double") * 1e6).try_cast("bigint"))
        arrival = F.coalesce(event, arrival)
    fields = [payload[name].alias(name) for name in PAYLOAD_FIELDS if name != "timestamp"]
    extras = F.map_filter(payload, lambda key, _: ~key.isin(*PAYLOAD_FIELDS))
    return messages.where(F.col("reason").isNull()).select(
        arrival.alias("ts"), payload["remote_addr"].alias("ip"), "client_address", "hostname",
        "message", "priority", *fields, extras.alias("extras"))


def quarantine(messages: DataFrame) -> DataFrame:
    return messages.where(F.col("reason").isNotNull()).select(
        "client_address", "recv_ts", "data", "reason")


def typed_logs(logs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nine detector columns, and the rows whose numbers cannot be read."""
    typed = logs.select(
        "ip", "ts", "domain", "request",
        F.col("request_length").try_cast("bigint").alias("request_length"),
        F.col("response_status").try_cast("int").alias("status"),
        F.col("body_bytes_sent").try_cast("bigint").alias("bytes_sent"),
        F.col("request_time").try_cast("double").alias("request_time"),
        F.col("http_user_agent").alias("user_agent"),
    )
    numbers = ("request_length", "status", "bytes_sent", "request_time")
    complete = F.lit(True)
    for name in numbers:
        complete = complete & F.col(name).isNotNull()
    return typed.where(complete), typed.where(~complete)


def log_records(logs: DataFrame, tag: str) -> DataFrame:
    """Log-store record: the message's own fields overlaid with the payload's.

    ``hostname`` falls back to the payload's domain; same-named payload keys win, but for the
    sender's address, which stays what was seen.
    """
    extras = F.col("extras")

    def own(name: str, value: Column) -> Column:
        return F.coalesce(extras[name], value.cast("string")).alias(name)

    names = ("hostname", "message", "priority", "tag")
    host = F.coalesce(F.nullif("hostname", F.lit("")), F.col("domain"))
    rest = [c for c in logs.columns if c not in (*names, "extras")]
    return logs.select(
        own("hostname", host), own("message", F.col("message")), own("priority", F.col("priority")),
        own("tag", F.lit(tag)), *rest,
        F.map_filter(extras, lambda key, _: ~key.isin(*names, "client_address")).alias("extras"))
