from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def work_dir(spark: SparkSession, label: str) -> str:
    """A new folder for checkpoints and written tables.

    Lives under the shared folder named by ``spark.checkpoint.dir``. Without that setting a local
    session (tests on one machine) uses a temporary folder; on a cluster, where executors would
    each write to their own disk, it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all of {master} shares")
        base = tempfile.mkdtemp(prefix="netshield-")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def _store(spark: SparkSession, path: str):
    """The file system of a path, and the path in its form."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def exists(spark: SparkSession, path: str) -> bool:
    store, found = _store(spark, path)
    return store.exists(found)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where there is no such folder."""
    store, found = _store(spark, path)
    return [x.getPath().getName() for x in store.listStatus(found)] if store.exists(found) else []


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder with all in it; what is gone already is no error."""
    store, found = _store(spark, path)
    store.delete(found, True)


class _Scopes(threading.local):
    """Open scratch scopes; each thread has its own, as each streaming query calls back in one."""

    def __init__(self) -> None:
        self.open: list[list[str]] = []


_scopes = _Scopes()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete what ``settle`` writes inside, once the results that read it are written.

    For loops that settle in every round. Scopes nest, and belong to the thread that opened them.
    """
    _scopes.open.append([])
    try:
        yield
    finally:
        for path in _scopes.open.pop():
            delete(spark, path)


def settle(df: DataFrame, label: str = "settled") -> DataFrame:
    """Write an intermediate result to the shared folder and continue from the written table.

    Used where a small result feeds several later steps: they reuse it, lost executors do not
    recompute it, and its file sizes let Spark choose join strategies.
    """
    path = work_dir(df.sparkSession, label)
    if _scopes.open:
        _scopes.open[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rows_within(df: DataFrame, limit: int) -> bool:
    """True when ``df`` has at most ``limit`` rows; reads no more than ``limit + 1`` of them."""
    return df.select(F.lit(1)).limit(limit + 1).count() <= limit


def broadcast_if_small(df: DataFrame, limit: int) -> DataFrame:
    """Hint a broadcast only after the row count is checked; otherwise leave the join to AQE."""
    return F.broadcast(df) if rows_within(df, limit) else df


def compute_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later expressions reuse without re-evaluation.

    Filters and projections above a plain projection are rewritten in terms of its expressions, so
    costly ones (parsing, regular expressions) would run once per use. A one-row generator keeps
    their values.
    """
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select("*", F.inline(F.array(row)))
