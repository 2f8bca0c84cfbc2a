"""Registered queries against DuckDB on the smallest tables; CHECK_ALL=1 runs every query."""

import math
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
QUICK = ("feat_entropy", "feat_intervals", "value_counts", "request_regex_parts", "series_cap",
         "blocklist_ops", "queue_normalise", "ts_normalise")
NAMES = sorted(entry.oracle_sql()) if os.environ.get("CHECK_ALL") else QUICK


def cell(value):
    return "NULL" if value is None or (isinstance(value, float) and math.isnan(value)) else repr(value)


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, sf_dir, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    df = entry.queries()[name](spark, sf_dir)
    result = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    got = sorted(tuple(cell(r[c]) for c in order) for r in df.collect())
    expected = sorted(tuple(cell(r[columns.index(c)]) for c in order) for r in result.fetchall())
    assert got == expected


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark, sf_dir):
    assert entry.entry(spark).count() > 0


def test_parts_of_several_files_are_batches(spark, monkeypatch):
    """A large part is written by several tasks; a batch still takes one part, also one of few rows or none in some files."""
    from checks import stream_queries
    from netshield.session import names_in, work_dir

    monkeypatch.setattr(stream_queries, "FILE_ROWS", 10)
    out, width = work_dir(spark, "test"), stream_queries.PART_SECONDS * 1_000_000
    sizes = (40, 1, 25, 2)
    rows = spark.createDataFrame([(k, stream_queries.START_US + k * width + n) for k, size in enumerate(sizes) for n in range(size)], "k long, us long")
    stream = stream_queries.in_parts(rows, F.col("us"), f"{out}/in")
    assert sum(name.startswith("part-") for name in names_in(spark, f"{out}/in")) == 4 * len(sizes)
    batches = {}

    def take(batch, batch_id):
        batches[batch_id] = sorted(r["k"] for r in batch.collect())

    stream_queries.finish(stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start())
    assert batches == {k: [k] * size for k, size in enumerate(sizes)}
