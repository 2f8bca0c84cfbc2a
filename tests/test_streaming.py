import random

import brute
from pyspark.sql import functions as F

from netshield.operators.blocklist import first_detections
from netshield.operators.features import minute_features, value_counts, with_window
from netshield.options import Options
from netshield.plans import detection
from netshield.session import names_in, work_dir
from netshield.sources import synthetic
from netshield.sources.geo import ranges_from_addresses
from netshield.sources.prefixes import parse_prefix_lines
from netshield.sources.syslog import RAW_SCHEMA
from netshield.streaming.blocklist import stream_blocks
from netshield.streaming.detection import DetectionLoop
from netshield.streaming.features import ClosedWindows, pending_counters, stream_value_counts
from netshield.streaming.ingest import start_ingest
from netshield.streaming.tables import finish, forget, spread
from test_detection import SCORER, traffic
from test_features import random_rows


def feed(batches, handle):
    for batch_id, batch in enumerate(batches):
        handle(batch, batch_id)


def split(spark, rows, cuts):
    """Batches in arrival order, cut at the given second offsets."""
    rows = sorted(rows, key=lambda r: r[2])
    origin, out = rows[0][2], []
    for low, high in zip([-1, *cuts], [*cuts, 10**9]):
        part = [r for r in rows if low < (r[2] - origin) / 1e6 <= high]
        out.append(brute.access_logs(spark, part))
    return out


def test_closed_windows_equal_batch(spark):
    rows = random_rows(5, 150, span=400_000_000)
    batches = split(spark, rows, [70, 200, 330])
    windows = ClosedWindows(work_dir(spark, "test"), delay_seconds=0)
    feed(batches, windows.handle)
    windows.handle(batches[-1], len(batches) - 1)  # a retried batch repeats itself
    pending = windows.open_windows(spark, batches[0].schema)
    closed = spark.read.schema(pending.schema).parquet(f"{windows.out}/features")
    assert closed.count() > 0 and pending.count() > 0
    got = brute.by_key(closed.select(*pending.columns).unionByName(pending), "ip", "win")
    expected = brute.by_key(minute_features(brute.access_logs(spark, rows)), "ip", "win")
    assert set(got) == set(expected)
    for key, row in expected.items():
        brute.assert_same(got[key], {k: v for k, v in row.items() if k not in ("ip", "win", "timestamp")}, key)


def test_late_rows_and_retention(spark):
    rows = random_rows(6, 60, span=400_000_000)
    batches = split(spark, rows, [200, 390])
    windows = ClosedWindows(work_dir(spark, "test"), delay_seconds=0)
    late = batches[0].limit(7)
    feed([batches[0], batches[1], late.unionByName(batches[2])], windows.handle)
    found = spark.read.parquet(f"{windows.out}/late")
    assert found.where("batch_id = 2").count() >= 7
    stored = spark.read.parquet(f"{windows.out}/rows")
    progress = spark.read.parquet(f"{windows.out}/progress").where("batch_id < 2").agg(F.max("closed_us")).first()[0]
    assert stored.where(F.col("win_us") < progress).count() == 0 and stored.count() > 0
    forget(spark, f"{windows.out}/rows", "win_us", 2**62, -1)
    forget(spark, f"{windows.out}/missing", "win_us", 2**62, -1)


def test_detection_loop_equals_batch(spark):
    opts = Options()
    loop = DetectionLoop(work_dir(spark, "test"), SCORER, opts=opts)
    feed(split(spark, traffic(), [90, 130, 190]), loop.handle)
    got = spark.read.parquet(f"{loop.out}/blocks")
    whole = detection.new_blocks(detection.detect(brute.access_logs(spark, traffic()), SCORER, opts=opts), opts)
    assert {(r["ip"], r["added_at"]) for r in got.collect()} == {
        (r["ip"], r["added_at"]) for r in whole.collect()}
    documents = spark.read.parquet(f"{loop.out}/gelf")
    assert documents.count() == spark.read.parquet(f"{loop.out}/alerts").count() > 0
    assert documents.where("gelf like '%\"tag\":\"alert\"%'").count() == documents.count()


def test_stream_value_counts_equal_batch(spark):
    out, rows = work_dir(spark, "test"), random_rows(9, 120, span=300_000_000)
    logs = brute.access_logs(spark, rows)
    logs.coalesce(1).write.parquet(f"{out}/in")
    table = stream_value_counts(spark.readStream.schema(logs.schema).parquet(f"{out}/in"))
    query = (table.writeStream.format("parquet").option("path", f"{out}/counts")
             .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start())
    finish(query, 120)
    newest = max(r[2] for r in rows) - 100_000_000
    batch = value_counts(with_window(logs), ["ip", "win"]).where(
        F.unix_micros("win") + 60_000_000 <= newest)
    columns = ["ip", "win", "field", "value", "n"]
    got = {tuple(r) for r in spark.read.parquet(f"{out}/counts").select(*columns).collect()}
    assert got and got == {tuple(r) for r in batch.select(*columns).collect()}


def test_stream_blocks_equal_batch(spark):
    rng = random.Random(2)
    out, opts = work_dir(spark, "test"), Options(block_seconds=60)
    times = sorted(rng.randrange(0, 900) for _ in range(120))
    for i, low in enumerate(range(0, 900, 300)):
        part = [(rng.choice("ab"), t) for t in times if low <= t < low + 300]
        spark.createDataFrame(part, "ip string, s long").select(
            "ip", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode("append").parquet(f"{out}/in")
    stream = spark.readStream.schema("ip string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{out}/in")
    query = (stream_blocks(stream, opts).writeStream.format("parquet").option("path", f"{out}/blocks")
             .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start())
    finish(query, 120)
    seen = spark.read.parquet(f"{out}/in").select("ip", F.unix_micros("ts").alias("us"))
    expected = {(r["ip"], r["us"]) for r in first_detections(seen, opts).collect()}
    got = spark.read.parquet(f"{out}/blocks").select("ip", F.unix_micros("added_at")).collect()
    assert {tuple(r) for r in got} == expected


def test_pending_counters_are_open_windows_only(spark):
    """A closed window that the stream lost isn't filled up from the batch log."""
    rows = random_rows(11, 120, span=400_000_000)
    logs = brute.access_logs(spark, rows)
    newest = max(r[2] for r in rows) - 100_000_000
    windows = with_window(logs).select("ip", F.unix_micros("win")).distinct().collect()
    got = {tuple(r) for r in pending_counters(logs).select("ip", F.unix_micros("win")).collect()}
    assert got == {tuple(r) for r in windows if r[1] + 60_000_000 > newest}
    assert 0 < len(got) < len(windows)


def test_ingest_deals_the_rows_of_one_file(spark):
    """All rows in one row group don't stay one task's; the bytes of what can't be used are kept."""
    out, n = work_dir(spark, "test"), 600
    made = synthetic.traffic(synthetic.numbered(spark, n), F.timestamp_seconds(F.lit(1733034840)))
    broken = F.when(F.crc32("data") % 10 == 0, F.lit(b"no header")).otherwise(F.col("data"))
    made.withColumn("data", broken).coalesce(1).write.parquet(f"{out}/raw")
    prefixes, _ = parse_prefix_lines(spark.createDataFrame([("vpn", "6.6.6.6")], "name string, line string"))
    geo = ranges_from_addresses(spark.createDataFrame(
        [("6.6.6.0", "6.6.6.255", "DE", "HE", "Frankfurt")],
        "ip_from string, ip_to string, country string, region string, city string"))
    stream = spark.readStream.schema(RAW_SCHEMA).parquet(f"{out}/raw")
    opts = Options(task_rows=50)
    finish(start_ingest(stream, prefixes, geo, f"{out}/tables", f"{out}/checkpoint", once=True, opts=opts))
    files = [name for name in names_in(spark, f"{out}/tables/logs/batch_id=0") if name.startswith("part-")]
    assert len(files) > 1
    raw = spark.read.schema(RAW_SCHEMA).parquet(f"{out}/raw")
    assert raw.rdd.getNumPartitions() == 1
    sizes = spread(raw, opts).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 12 and max(r["count"] for r in sizes) <= 60
    bad = raw.where(F.col("data") == F.lit(b"no header")).count()
    kept = spark.read.parquet(f"{out}/tables/quarantine")
    assert 0 < bad == kept.where(F.col("data") == F.lit(b"no header")).count() == kept.count()
    for table in ("logs", "rows", "gelf"):
        assert spark.read.parquet(f"{out}/tables/{table}").count() == n - bad
