"""Not-modified revisit records resolved to earlier responses, as an as-of join with functions only.

A revisit refers to the latest earlier full response of its canonical URL. Captures are cut into
slices of time, about ``SLICE_ROWS`` captures each; inside a URL's slice a window carries the last
response forward, and a second window over one row for each URL and slice carries it across
slices. A URL that was captured all the time is thus never whole in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netshield.llm.common import quoted

#: Captures of all URLs that a slice of time holds on average.
SLICE_ROWS = 20_000
# Query parameters that name no resource, and headers that a 304 may update.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "ref", "sessionid")
UPDATED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "age", "server")


def canonical(url: Column) -> Column:
    """Host and path without scheme, ``www.``, default port, fragment, tracking and trailing slash.

    The host is lower-cased; query parameters are sorted. Null without ``://``.
    """
    bare = F.regexp_replace(url, r"(?s)#.*$", "")
    scheme = F.lower(F.substring_index(bare, "://", 1))
    rest = F.substring(bare, F.instr(bare, "://") + 3, F.length(bare))
    host = F.lower(F.regexp_extract(rest, r"(?s)^([^/?]*)", 1))
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(
        scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    path = F.regexp_replace(F.regexp_extract(rest, r"(?s)^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(rest, r"(?s)^[^?]*\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(*TRACKING)))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(F.instr(bare, "://") > 0, F.concat(F.regexp_replace(host, r"^www\.", ""), path, tail))


def _lowered(headers: Column) -> Column:
    """Header names lower-cased; of names that then repeat, the last by name and value stays."""
    entries = F.array_sort(F.transform(F.map_entries(headers), lambda e: F.struct(
        F.lower(e["key"]).alias("key"), F.coalesce(e["value"], F.lit("")).alias("value"))))
    last = F.filter(entries, lambda e, i: F.coalesce(F.get(entries, i + 1)["key"] != e["key"], F.lit(True)))
    return F.coalesce(F.map_from_entries(last), F.create_map().cast("map<string,string>"))


def _opaque(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def resolve(captures: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """One row per revisit: ``record_id, url, ts, refers_to, outcome, headers, digest``.

    ``captures`` has ``record_id`` (long), ``url``, ``ts`` (long), ``kind`` (``response`` or
    ``revisit``), ``status`` (int), ``headers`` (map) and ``digest``; other columns are ignored, as
    are rows of another kind. A full response has status 200 and a digest. Earlier means a smaller
    (``ts``, ``record_id``), with nulls first. The outcome is ``resolved`` when the entity tags
    agree (weak comparison), or, where either has none, the last-modified dates do, or, where
    either has none of those too, nothing contradicts and the digests agree or the revisit has none.
    Otherwise it is ``changed``, or ``missing`` without an earlier response; these two have the
    revisit's own headers and digest and no ``refers_to``. Resolved rows have the response's
    digest, and its headers with those in ``UPDATED`` taken from the revisit where it has them.
    Revisits with a null or relative URL are ``missing``. Repeated rows give repeated results; a
    table without revisits gives none.
    """
    rows = captures.select(
        F.col("record_id").cast("bigint").alias("record_id"), "url", F.col("ts").cast("bigint").alias("ts"), "kind",
        F.col("status").cast("int").alias("status"), _lowered(F.col(quoted("headers"))).alias("headers"), "digest",
        canonical(F.col(quoted("url"))).alias("canonical")).filter(F.col("kind").isin("response", "revisit"))
    shape = rows.agg(F.count("*").alias("n"), F.min("ts").alias("low"), F.max("ts").alias("high")).first()
    low, high = shape["low"] or 0, shape["high"] or 0
    width = max(1, -(-(high - low + 1) * slice_rows // max(1, shape["n"])))
    full = (F.col("kind") == "response") & (F.col("status") == 200) & F.col("digest").isNotNull()
    known = F.struct("record_id", "headers", "digest")
    rows = rows.withColumn("slice", F.floor((F.coalesce("ts", F.lit(low)) - low) / width).cast("bigint"))
    # rows without a URL can't meet anything, so they needn't stand in one window
    placed = rows.filter("canonical is not null and (kind = 'revisit' or (status = 200 and digest is not null))")
    order = [F.col("ts").asc_nulls_first(), F.col("record_id").asc_nulls_first(), F.col("kind")]
    before = Window.partitionBy("canonical", "slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = placed.withColumn("base", F.last(F.when(full, known), ignorenulls=True).over(before)).filter("kind = 'revisit'")
    # nulls sort before values, which is their order here too
    last = placed.filter(full).groupBy("canonical", "slice").agg(F.max_by(known, F.struct("ts", "record_id")).alias("last"))
    slices = last.unionByName(inside.filter("base is null").select("canonical", "slice").distinct().withColumn(
        "last", F.lit(None).cast(last.schema["last"].dataType))).groupBy("canonical", "slice").agg(F.max_by("last", F.col("last").isNotNull()).alias("last"))
    earlier = Window.partitionBy("canonical").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = slices.withColumn("carried", F.last("last", ignorenulls=True).over(earlier)).select("canonical", "slice", "carried")
    own = ["record_id", "url", "ts", "headers", "digest"]
    met = (inside.join(carried, ["canonical", "slice"], "left")
           .select(*own, F.coalesce("base", "carried").alias("base"))
           .unionByName(rows.filter("canonical is null and kind = 'revisit'").select(
               *own, F.lit(None).cast(last.schema["last"].dataType).alias("base"))))

    def both(name: str) -> tuple[Column, Column]:
        return F.try_element_at("headers", F.lit(name)), F.try_element_at("base.headers", F.lit(name))

    (tag, base_tag), (date, base_date) = both("etag"), both("last-modified")
    agree = F.when(tag.isNotNull() & base_tag.isNotNull(), _opaque(tag) == _opaque(base_tag)).when(
        date.isNotNull() & base_date.isNotNull(), date == base_date).otherwise(
        F.col("digest").isNull() | (F.col("digest") == F.col("base.digest")))
    outcome = F.when(F.col("base").isNull(), "missing").when(agree, "resolved").otherwise("changed")
    met = met.withColumn("outcome", outcome)
    updates = F.map_filter("headers", lambda k, _: k.isin(*UPDATED))
    stays = F.map_filter("base.headers", lambda k, _: ~F.map_contains_key(updates, k))
    good = F.col("outcome") == "resolved"
    return met.select(
        "record_id", "url", "ts", F.when(good, F.col("base.record_id")).alias("refers_to"), "outcome",
        F.when(good, F.map_concat(stays, updates)).otherwise(F.col("headers")).alias("headers"),
        F.when(good, F.col("base.digest")).otherwise(F.col("digest")).alias("digest"))


def captures_of(pages: DataFrame) -> DataFrame:
    """A response and a later revisit for each page, with varied URLs and validators.

    The page id is the time. The revisit comes up to 50 ids later, under another form of the URL;
    each seventh has another entity tag, each fifth only a date (each tenth a wrong one), and each
    eleventh a weak tag.
    """
    n = F.col("page_id")
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce("html", F.lit(""))), 1, 16), F.lit('"'))
    date = F.concat(F.lit("day "), (n % 1000).cast("string"))
    response = pages.select(
        (n * 2).alias("record_id"), "url", (n * 10).alias("ts"), F.lit("response").alias("kind"), F.lit(200).alias("status"),
        F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("ETag"), tag, F.lit("Last-Modified"), date,
                     F.lit("Content-Length"), F.octet_length(F.coalesce("html", F.lit(""))).cast("string")).alias("headers"),
        F.sha2(F.coalesce("html", F.lit("")), 256).alias("digest"))
    shown = F.when(n % 7 == 0, F.lit('"other"')).when(n % 11 == 0, F.concat(F.lit("W/"), tag)).otherwise(tag)
    sent = F.when(n % 5 == 0, F.create_map(F.lit("last-modified"), F.when(n % 10 == 0, F.lit("never")).otherwise(date))).otherwise(
        F.create_map(F.lit("etag"), shown))
    revisit = pages.select(
        (n * 2 + 1).alias("record_id"), F.concat(F.regexp_replace("url", "#.*$", ""), F.lit("#again")).alias("url"),
        (n * 10 + 5 + (n * 7 % 50) * 10).alias("ts"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"),
        F.map_concat(sent, F.create_map(F.lit("Date"), F.concat(F.lit("at "), n.cast("string")), F.lit("Content-Length"), F.lit("0"))).alias("headers"),
        F.lit(None).cast("string").alias("digest"))
    return response.union(revisit)
