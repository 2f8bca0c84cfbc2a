"""From raw datagrams to enriched, detection-eligible logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netshield.operators.enrich import enrich, is_candidate
from netshield.operators.gelf import JSON_OPTIONS
from netshield.options import Options
from netshield.sources.syslog import log_records, parse_messages, parsed_logs, quarantine, typed_logs

_DETECTOR = ["ip", "ts", "domain", "request", "request_length", "status", "bytes_sent",
             "request_time", "user_agent"]
_EPOCH = T.DecimalType(20, 6)


def ingest(raw: DataFrame, prefixes: DataFrame, geo: DataFrame, time_field: str | None = None,
           opts: Options = Options()) -> tuple[DataFrame, DataFrame]:
    """Every usable message enriched, and the messages that could not be used."""
    return ingest_parsed(parse_messages(raw), prefixes, geo, time_field, opts)


def ingest_parsed(messages: DataFrame, prefixes: DataFrame, geo: DataFrame, time_field: str | None = None,
                  opts: Options = Options()) -> tuple[DataFrame, DataFrame]:
    """The same of messages that ``parse_messages`` has parsed; each result reads them once."""
    logs = enrich(parsed_logs(messages, time_field), prefixes, geo, opts=opts)
    return logs, quarantine(messages)


def detector_rows(enriched: DataFrame) -> DataFrame:
    """Typed rows of the eligible logs; ``seq`` breaks ties between requests of one instant."""
    typed, _ = typed_logs(enriched.where(is_candidate()))
    return typed.withColumn("seq", F.xxhash64(*_DETECTOR))


def _json_value(field: T.StructField) -> Column:
    """A column as the variant that its JSON text gives; NULL becomes JSON's ``null``.

    Texts, truth values, whole numbers and the record's time need no JSON text for that.
    """
    value = F.col(field.name)
    if field.dataType == _EPOCH or isinstance(field.dataType, (T.StringType, T.BooleanType, T.IntegralType)):
        return F.coalesce(value.cast("variant"), F.parse_json(F.lit("null")))
    text = F.to_json(F.struct(value.alias("value")), {"ignoreNullFields": "false"})
    return F.parse_json(text).cast("map<string,variant>")["value"]


def gelf_messages(enriched: DataFrame, tag: str, queue: str, exchange: str) -> DataFrame:
    """Log-store messages ``(doc, queue, exchange)`` of enriched logs.

    Payload keys named like a column of the record are left out: what ingestion found wins.
    """
    records = log_records(enriched, tag)
    epoch = (F.unix_micros("ts").cast("decimal(20,0)") / 1000000).cast(_EPOCH)
    stamped = records.withColumn("timestamp", epoch)
    own = stamped.drop("ts", "ip", "extras")
    # Most values are taken as they are: no text of the whole record is written and parsed.
    fields = sorted(own.schema.fields, key=lambda f: f.name)
    known = F.create_map(*[c for f in fields for c in (F.lit(f.name), _json_value(f))])
    others = F.map_filter("extras", lambda key, _: ~key.isin(*own.columns))
    extras = F.transform_values(others, lambda _, value: value.cast("variant"))
    return stamped.select(
        F.map_concat(known, F.coalesce(extras, F.create_map().cast("map<string,variant>"))).alias("doc"),
        F.lit(queue).alias("queue"), F.lit(exchange).alias("exchange"))


def alert_messages(alerts: DataFrame, queue: str, exchange: str) -> DataFrame:
    """Log-store messages ``(doc, queue, exchange)`` of alerts, nested parts kept as JSON values."""
    epoch = (F.unix_micros("timestamp").cast("decimal(20,0)") / 1000000).cast("decimal(20,6)")
    own = alerts.withColumn("timestamp", epoch).drop("alert_ts")
    text = F.to_json(F.struct(*own.columns), JSON_OPTIONS)
    return own.select(F.parse_json(text).cast("map<string,variant>").alias("doc"),
                      F.lit(queue).alias("queue"), F.lit(exchange).alias("exchange"))
