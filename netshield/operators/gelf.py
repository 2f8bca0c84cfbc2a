"""Log-store documents (GELF 1.1) and JSON output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netshield.constants import GELF_FACILITY, GELF_VERSION
from netshield.functions.timestamps import normalize_epoch
from netshield.session import compute_once

# Times carry their zone and microseconds, like ISO-8601 text.
JSON_OPTIONS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx", "ignoreNullFields": "false"}


def flatten(df: DataFrame) -> DataFrame:
    """Replace each struct column by its fields, one level deep."""
    return df.select(*[
        f"{f.name}.*" if isinstance(f.dataType, T.StructType) else f.name for f in df.schema.fields])


def as_json(df: DataFrame, name: str = "body") -> DataFrame:
    """One JSON text per row."""
    return df.select(F.to_json(F.struct(*df.columns), JSON_OPTIONS).alias(name))


def _text(value: Column) -> Column:
    """A variant's text when it is a string, otherwise its JSON."""
    return F.coalesce(F.try_variant_get(value, "$", "string"), F.to_json(value))


def gelf_documents(docs: DataFrame, now: Column, offset_hours: int = 0,
                   facility: str = GELF_FACILITY) -> DataFrame:
    """``(doc, queue, exchange)`` → ``gelf``, one JSON document per row.

    Known keys move to their GELF names; every other key gets a ``_`` prefix unless it has one
    already, in which case it is left out. A message's own ``source_queue`` and ``source_exchange``
    win over those it was taken from. A time that is no number, or too large for one, becomes ``now``.
    """
    doc = F.col("doc")
    stamped = compute_once(docs, _stamp=_text(doc["timestamp"]))

    def field(key: str, default: Column) -> Column:
        return F.when(F.map_contains_key(doc, key), doc[key]).otherwise(default.cast("variant"))

    epoch = F.coalesce(
        normalize_epoch(F.col("_stamp"), now, offset_hours).try_cast("decimal(20,6)"),
        now.cast("decimal(20,6)"))
    known = F.create_map(
        F.lit("version"), F.lit(GELF_VERSION).cast("variant"),
        F.lit("host"), field("hostname", F.lit("unknown")),
        F.lit("short_message"), field("message", F.lit("")),
        F.lit("timestamp"), epoch.cast("variant"),
        F.lit("facility"), F.lit(facility).cast("variant"),
        F.lit("_source_queue"), field("source_queue", F.col("queue")),
        F.lit("_source_exchange"), field("source_exchange", F.col("exchange")),
        F.lit("tag"), field("tag", F.lit("")),
    )
    own = F.map_filter(
        doc, lambda key, _: ~key.isin("message", "hostname", "timestamp", "tag", "source_queue",
                                      "source_exchange") & ~key.startswith("_") & (key != ""))
    named = F.transform_keys(own, lambda key, _: F.concat(F.lit("_"), key))
    return stamped.select(F.to_json(F.map_concat(known, named), JSON_OPTIONS).alias("gelf"))
