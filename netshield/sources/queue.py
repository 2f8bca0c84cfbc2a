"""Bodies taken from message queues → one JSON object per row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netshield.functions.maps import last_wins
from netshield.session import compute_once


def _one_value(text: Column) -> Column:
    """The single JSON value in a text as an array of one variant; NULL for malformed text."""
    wrapped = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    values = F.try_variant_get(wrapped, "$", "array<variant>")
    return F.when(F.size(values) == 1, values)


def _object(value: Column) -> Column:
    """Map of a JSON object; NULL for any other value."""
    return F.when(F.schema_of_variant(value).startswith("OBJECT"),
                  F.try_variant_get(value, "$", "map<string,variant>"))


def _like_object(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\r")).startswith("{")


def _objects(text: Column) -> Column:
    """The one JSON object of a text, with repeated keys, in an array; texts that don't start like one aren't parsed."""
    objects = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<map<string,variant>>",
                          {"allowSingleQuotes": "false"})
    return F.when(_like_object(text), objects)


def _repeating(objects: Column) -> Column:
    """Map of the single object, the last value of a repeated key winning; else NULL."""
    return last_wins(F.when(F.size(objects) == 1, F.get(objects, F.lit(0))))


def normalize_messages(bodies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split ``(body, queue, exchange)`` into documents and undecodable bodies.

    A JSON object is taken as is, and so is one wrapped in a JSON string; any other value becomes
    ``{"message": value}``. ``doc`` is ``map<string, variant>``, so values keep their JSON types.
    """
    body = F.col("body")
    parsed = compute_once(bodies, _values=_one_value(body))
    # the value parser refuses objects that repeat a key
    parsed = compute_once(parsed, _again=F.when(F.col("_values").isNull(), _objects(body)))
    parsed = compute_once(parsed, _repeated=F.when(F.col("_again").isNotNull(), _repeating(F.col("_again"))))
    usable = F.col("_values").isNotNull() | F.col("_repeated").isNotNull()
    value = F.coalesce(F.get("_values", F.lit(0)), F.parse_json(F.lit("null")))
    good = compute_once(parsed.where(usable), _value=value)
    # an object wrapped in a JSON string is parsed like a body
    inner = F.when(F.schema_of_variant("_value") == "STRING", F.try_variant_get("_value", "$", "string"))
    good = compute_once(good, _inner=inner)
    opened = F.when(_like_object(F.col("_inner")), _one_value(F.col("_inner")))
    good = compute_once(good, _opened=opened)
    again = F.when(F.col("_opened").isNull() & F.col("_inner").isNotNull(), _objects(F.col("_inner")))
    good = compute_once(good, _inner_again=again)
    wrapped = F.create_map(F.lit("message"), F.col("_value"))
    docs = compute_once(good, doc=F.coalesce(
        "_repeated", _object(F.col("_value")), _object(F.get("_opened", F.lit(0))),
        F.when(F.col("_inner_again").isNotNull(), _repeating(F.col("_inner_again"))), wrapped))
    bad = parsed.where(~usable).drop("_values", "_again", "_repeated")
    return docs.select("doc", "queue", "exchange"), bad


def union_queues(sources: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """All queues in one stream; each body is tagged with the queue and exchange it came from."""
    tagged = [
        df.select("body", F.lit(queue).alias("queue"), F.lit(exchange).alias("exchange"))
        for df, queue, exchange in sources
    ]
    return reduce(DataFrame.unionByName, tagged)
