"""Network prefix lists: one CIDR or address per line, one list per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netshield.constants import SUPPORTED_NETWORKS, UNSUPPORTED_NETWORKS
from netshield.functions.address import hex_family, ip_hex, prefix_bound
from netshield.session import compute_once

PREFIX_SCHEMA = "fam int, plen int, lo string, hi string, name string, category string, support int"


def category_of(name: Column) -> tuple[Column, Column]:
    """Category and support flag of a list name; the trusted lists are consulted first."""
    category, support = F.lit(None).cast("string"), F.lit(None).cast("int")
    for lists, flag in ((UNSUPPORTED_NETWORKS, 0), (SUPPORTED_NETWORKS, 1)):
        for label, names in lists.items():
            category = F.when(name.isin(*names), label).otherwise(category)
            support = F.when(name.isin(*names), flag).otherwise(support)
    return category, support


def parse_prefix_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split ``(name, line)`` rows into prefixes and unreadable lines.

    Blank lines, comments and lists without a category are skipped, repeated lines collapse, a bare
    address becomes a host prefix and host bits are masked off.
    """
    category, support = category_of(F.col("name"))
    listed = lines.select("name", F.btrim("line", F.lit(" \t\r\n")).alias("line")).where(
        (F.col("line") != "") & ~F.col("line").startswith("#"))
    # Addresses are read once per distinct line.
    distinct = compute_once(listed.distinct(), digits=ip_hex(F.split_part("line", F.lit("/"), F.lit(1))))
    length = F.split_part("line", F.lit("/"), F.lit(2))
    parsed = (
        distinct.withColumns({"category": category, "support": support})
        .where(F.col("category").isNotNull())
        .withColumn("width", F.length("digits") * 4)
        .withColumn("plen", F.when(~F.col("line").contains("/"), F.col("width"))
                    .when(length.rlike(r"\A\d{1,3}\z"), length.try_cast("int")))
        .withColumn("valid", F.coalesce(F.col("plen").between(0, F.col("width")), F.lit(False)))
    )
    prefixes = parsed.where("valid").select(
        hex_family(F.col("digits")).alias("fam"), "plen",
        prefix_bound(F.col("digits"), F.col("plen"), "0").alias("lo"),
        prefix_bound(F.col("digits"), F.col("plen"), "F").alias("hi"),
        "name", "category", "support",
    )
    return prefixes, parsed.where(~F.col("valid")).select("name", "line")


def read_prefix_lists(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Read every ``*.ips`` file of a folder; the file stem names the network."""
    stem = F.regexp_extract("_metadata.file_name", r"^(.*)\.ips$", 1)
    text = spark.read.option("pathGlobFilter", "*.ips").text(path)
    return parse_prefix_lines(text.select(stem.alias("name"), F.col("value").alias("line")))


def save_prefixes(prefixes: DataFrame, path: str) -> None:
    """Keep the parsed lists so later runs skip the text files."""
    prefixes.write.mode("overwrite").parquet(path)


def load_prefixes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PREFIX_SCHEMA).parquet(path)
