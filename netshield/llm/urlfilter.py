"""Allow and block rules for URLs, matched by hashed host-suffix and path-prefix expressions.

A rule is a host and a path, such as ``example.com`` and ``/en/``. It fits its host and all
subdomains when the URL's path starts with the rule's. Every URL is expanded into its host
suffixes times its path prefixes; expressions meet rules on the first four bytes of their SHA-256
digest, and whole digests confirm. Suffixes are only taken at the label counts, and prefixes at
the lengths, that occur among the rules: a bounded number whatever the URL's length, and no
expression that could fit is left out.

URLs with the same host and the same leading part of the path (as long as the longest rule path)
get the same answer, so those are expanded once; a hot host costs a map-side count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netshield.llm.common import bytes_within, fresh, quoted
from netshield.session import settle

#: Bytes of rules up to which they are sent to every executor; larger lists are shuffled.
BROADCAST_BYTES = 16_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    # the length keeps apart hosts that contain a slash and paths that begin otherwise
    return F.sha2(F.concat_ws("\n", F.length(host).cast("string"), host, path), 256)


def rule_table(rules: DataFrame) -> DataFrame:
    """Usable rules: ``rule_host, rule_path, action``, one action for each host and path.

    Hosts are A-Z lower-cased. Rules with a null or empty host, a null path or another action than
    ``allow`` or ``block`` are left out. Where the same rule allows and blocks, it blocks.
    """
    return (rules.select(F.translate("host", _UPPER, _LOWER).alias("rule_host"), F.col("path").alias("rule_path"),
                         F.col("action"))
            .filter("rule_host <> '' and rule_path is not null and action in ('allow', 'block')")
            .groupBy("rule_host", "rule_path").agg(F.max("action").alias("action")))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url",
          broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to every row of ``pages``.

    ``rules`` has ``host``, ``path`` and ``action``. Among the rules that fit, the longest (host
    and path together) wins; of equally long ones the one with the longer host. ``rule`` is its
    host and path as one string, ``verdict`` its action; without a fitting rule they are null and
    ``default``. A null URL or one without ``://`` has an empty host and path and fits nothing.
    Input columns with the names of the four results are replaced; other columns, repeated rows
    and rows with null ids pass through. Without rules every row gets ``default``.
    """
    listed = settle(rule_table(rules), "rules")
    text = F.col(quoted(url))
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    key = fresh(pages, "lead")
    shape = listed.agg(
        F.sort_array(F.collect_set(F.length("rule_path"))).alias("lengths"),
        F.sort_array(F.collect_set(F.size(F.split("rule_host", r"\.")))).alias("labels")).first()
    lengths, labels = list(shape["lengths"]), list(shape["labels"])
    found = pages.select(*[quoted(c) for c in kept], host_of(text).alias("host"), path_of(text).alias("path"))
    if not lengths:
        return found.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    found = found.withColumn(key, F.substring("path", 1, max(lengths)))

    distinct = found.select("host", F.col(key).alias("lead")).filter("host <> ''").distinct()
    parts = F.split("host", r"\.")
    suffixes = F.filter(
        F.array(*[F.when(F.size(parts) >= n, F.substring_index("host", ".", -n)) for n in labels]),
        lambda x: x.isNotNull())
    prefixes = F.filter(
        F.array(*[F.when(F.length("lead") >= n, F.substring("lead", 1, n)) for n in lengths]),
        lambda x: x.isNotNull())
    expressions = (distinct.withColumn("suffix", F.explode(suffixes)).withColumn("prefix", F.explode(prefixes))
                   .withColumn("digest", _digest(F.col("suffix"), F.col("prefix"))))
    hashed = listed.withColumn("rule_digest", _digest(F.col("rule_host"), F.col("rule_path")))
    if bytes_within(hashed, broadcast_bytes):
        hashed = F.broadcast(hashed)
    matched = (expressions.withColumn("short", F.substring("digest", 1, 8))
               .join(hashed.withColumn("short", F.substring("rule_digest", 1, 8)), "short")
               .filter("digest = rule_digest"))
    best = (matched.groupBy("host", "lead")
            .agg(F.max(F.struct((F.length("rule_host") + F.length("rule_path")).alias("size"),
                                F.length("rule_host").alias("of_host"),
                                F.concat("rule_host", "rule_path").alias("rule"), "action")).alias("best"))
            .select(F.col("host").alias("of"), F.col("lead").alias("at"), "best.rule", "best.action"))
    return (found.join(best, (F.col("host") == F.col("of")) & (F.col(key) == F.col("at")), "left")
            .select(*[quoted(c) for c in kept], "host", "path", "rule",
                    F.coalesce("action", F.lit(default)).alias("verdict")))
