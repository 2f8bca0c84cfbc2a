"""Helpers shared by the text operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    return stem if stem.lower() not in taken else f"{stem}_{uuid.uuid4().hex[:12]}"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(quoted(name)).cast("string"), F.lit(""))


def bytes_within(df: DataFrame, limit: int) -> bool:
    """True when the string and numeric columns of ``df`` together take at most ``limit`` bytes."""
    size = sum((F.coalesce(F.octet_length(F.col(quoted(f.name)).cast("string")), F.lit(0)) + 16
                for f in df.schema.fields), F.lit(0))
    total = df.agg(F.sum(size.cast("bigint")).alias("size")).first()["size"]
    return (total or 0) <= limit
