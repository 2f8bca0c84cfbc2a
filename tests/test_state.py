import random

import pytest
from pyspark.sql import functions as F

from netshield.options import Options
from netshield.session import exists, names_in, scratch, settle, work_dir
from netshield.streaming.series import SeriesStore
from netshield.streaming.state import StateTable
from netshield.streaming.tables import finish

SCHEMA = "ip string, ts timestamp, payload string"


def records(spark, rows):
    return spark.createDataFrame(rows, "ip string, s double, payload string").select(
        "ip", F.timestamp_micros((F.col("s") * 1e6).cast("long")).alias("ts"), "payload")


def held(df):
    return sorted(((r["ip"], r["us"] / 1e6, r["payload"]) for r in df.select("ip", F.unix_micros("ts").alias("us"), "payload").collect()), key=repr)


def test_versions_expiry_and_merging(spark):
    table = StateTable(work_dir(spark, "test"), SCHEMA, merge_above=3, versions=2)
    assert table.latest(spark) == -1 and table.read(spark, -1).count() == 0
    for k in range(12):
        table.commit(records(spark, [("a", 10.0 * k + d, str(d)) for d in range(10)]), k, int((10 * k - 35) * 1e6))
        assert table.latest(spark) == k
        rows = held(table.read(spark, k, int((10 * k - 35) * 1e6)))
        assert rows == sorted((("a", float(s), str(s % 10)) for s in range(max(0, 10 * k - 35), 10 * k + 10)), key=repr)
        assert len(table.entries(spark, k)) <= 4
        assert len(names_in(spark, f"{table.path}/data")) <= 8 and len(names_in(spark, f"{table.path}/manifest")) <= 2
    assert table.entries(spark, 5) == []


def test_a_repeated_commit_changes_nothing(spark):
    table = StateTable(work_dir(spark, "test"), SCHEMA, merge_above=2)
    for k in range(6):
        for _ in range(1 + k % 3):
            table.commit(records(spark, [("a", float(k), "x")]), k)
    assert held(table.read(spark, 5)) == [("a", float(k), "x") for k in range(6)]
    table.replace(records(spark, []), 6)
    assert table.read(spark, 6).count() == 0 and table.newest_us(spark, 6) is None
    table.commit(records(spark, [("b", 1.0, None)]).union(records(spark, [("c", None, "no time")])), 7)
    assert held(table.read(spark, 7)) == [("b", 1.0, None)]
    with pytest.raises(ValueError):
        StateTable("x", SCHEMA, versions=1)


def test_a_failed_batch_is_repeated(spark):
    """A batch that fails after its rows were written leaves the version before it in force."""
    table = StateTable(work_dir(spark, "test"), SCHEMA)
    table.commit(records(spark, [("a", 1.0, "x")]), 0)
    table._write(records(spark, [("a", 2.0, "half")]), "1-added")
    assert table.latest(spark) == 0 and held(table.read(spark, 0)) == [("a", 1.0, "x")]
    table.commit(records(spark, [("a", 2.0, "whole")]), 1)
    assert held(table.read(spark, 1)) == [("a", 1.0, "x"), ("a", 2.0, "whole")]


def test_scratch_is_deleted(spark):
    with scratch(spark):
        df = settle(spark.range(3), "scratch-test")
        path = df.inputFiles()[0].rsplit("/", 1)[0]
        assert df.count() == 3 and exists(spark, path)
    assert not exists(spark, path)


def test_scratch_of_other_threads_is_left(spark):
    """Two streams of a driver settle at the same time; the end of one's batch deletes nothing of the other's."""
    import threading

    opened, left, paths = threading.Event(), threading.Event(), {}

    def other():
        with scratch(spark):
            opened.set()
            left.wait(60)

    thread = threading.Thread(target=other)
    thread.start()
    opened.wait(60)
    with scratch(spark):
        paths["own"] = settle(spark.range(2), "own").inputFiles()[0].rsplit("/", 1)[0]
        left.set()
        thread.join()
        assert exists(spark, paths["own"])
    assert not exists(spark, paths["own"])


def test_series_over_batches(spark):
    """Pushes in any batch are one record; old ones go; a failed batch and a restart lose and repeat nothing."""
    rng, opts = random.Random(3), Options(series_max_age_seconds=100)
    out = work_dir(spark, "test")
    pushed, batches = [], []
    for k in range(6):
        new = [(rng.choice("abc"), float(rng.randrange(60 * k, 60 * k + 60)), rng.choice(["x", "y", None])) for _ in range(40)]
        batches.append(new + rng.sample(pushed, min(len(pushed), 10)) + new[:5])
        pushed += new
        records(spark, batches[-1]).coalesce(1).write.mode("append").parquet(f"{out}/in")
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{out}/in")

    class Failing(SeriesStore):
        def handle(self, batch, batch_id):
            super().handle(batch, batch_id)
            if batch_id == 2:
                raise RuntimeError("after all was written")

    with pytest.raises(Exception, match="after all was written"):
        finish(Failing(f"{out}/store", opts, merge_above=2).start(stream(), f"{out}/checkpoint", once=True))
    store = SeriesStore(f"{out}/store", opts, merge_above=2)
    assert store.table.latest(spark) == 2
    finish(store.start(stream(), f"{out}/checkpoint", once=True))
    assert store.table.latest(spark) == 5
    newest = max(s for _, s, _ in pushed)
    want = sorted({r for r in pushed if r[1] > newest - 100}, key=repr)
    assert held(store.series(spark)) == want
