"""Geographic address ranges from the vendor's CSV edition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netshield.functions.address import ip_hex
from netshield.session import compute_once

_CSV_SCHEMA = (
    "ip_from string, ip_to string, country string, country_name string, region string, city string"
)


def ranges_from_addresses(rows: DataFrame) -> DataFrame:
    """``(ip_from, ip_to, country, region, city)`` with textual bounds → lookup intervals."""
    texts = rows.groupBy("ip_from", "ip_to").agg(F.min(F.struct("country", "region", "city")).alias("place"))
    # Addresses are read once per distinct pair of texts.
    ranges = compute_once(texts, lo=ip_hex(F.col("ip_from")), hi=ip_hex(F.col("ip_to")))
    return ranges.where(F.col("lo").isNotNull() & F.col("hi").isNotNull()).select(
        "lo", "hi", "place.*")


def read_geo_text(spark: SparkSession, path: str) -> DataFrame:
    """Headed CSV whose bounds are written as addresses; serves both families."""
    schema = "ip_from string, ip_to string, country string, region string, city string"
    return ranges_from_addresses(spark.read.schema(schema).option("header", True).csv(path))


def read_geo_v4(spark: SparkSession, path: str) -> DataFrame:
    """Headerless CSV whose bounds are 32-bit integers."""
    rows = spark.read.schema(_CSV_SCHEMA).csv(path)
    bounds = [F.lpad(F.hex(F.col(c).cast("bigint")), 8, "0").alias(a)
              for c, a in (("ip_from", "lo"), ("ip_to", "hi"))]
    return rows.select(*bounds, "country", "region", "city")


def wide_hex(digits: Column) -> Column:
    """The 32 hex digits of a decimal text below 2**128.

    With ``n = a * 10**18 + b`` and ``a = a1 * 2**64 + a0``, all parts fit a 38-digit decimal.
    """
    def whole(value: Column) -> Column:
        return value.cast("decimal(38,0)")

    def parts(value: Column, bits: int) -> tuple[Column, Column]:
        unit = whole(F.lit(str(1 << bits)))
        return whole(F.floor((value - value % unit) / unit)), whole(value % unit)

    text = F.lpad(F.btrim(digits), 57, "0")
    a1, a0 = parts(whole(F.left(text, F.lit(39))), 64)
    scale = whole(F.lit(str(10 ** 18)))
    carry, low = parts(whole(whole(a0 * scale) + whole(F.right(text, F.lit(18)))), 64)
    words = [*parts(whole(whole(a1 * scale) + carry), 32), *parts(low, 32)]
    return F.concat(*[F.lpad(F.hex(w.cast("bigint")), 8, "0") for w in words])


def read_geo_v6(spark: SparkSession, path: str) -> DataFrame:
    """Headerless CSV whose bounds are 128-bit integers, wider than any SQL number type."""

    rows = spark.read.schema(_CSV_SCHEMA).csv(path)
    return rows.select(
        wide_hex(F.col("ip_from")).alias("lo"), wide_hex(F.col("ip_to")).alias("hi"), "country", "region", "city")
