from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from checks.common import ntz, plain_types, with_logs
from checks.detect_queries import OPTIONS, SUPPRESS_OPTIONS, ORACLES as DETECT, scorer, shown_alerts, shown_documents
from checks.feature_queries import ORACLES as FEATURE, feature_sql, shown
from checks.ingest_queries import PARSED, raw
from checks.series_queries import ORACLES as SERIES
from checks.network_queries import _ADDRESSES, _BEST, _PREFIXES, _RANGES, STATIC_SQL, geo_dimension, prefix_load, resolutions
from netshield.constants import FEATURES
from netshield.operators import enrich as en
from netshield.operators.lookup import geo_buckets, prefix_buckets
from netshield.operators.blockops import LISTED, apply_commands
from netshield.options import Options
from netshield.session import names_in, work_dir
from netshield.sources.syslog import RAW_SCHEMA
from netshield.sources.testdata import access_logs, logs
from netshield.streaming.blocklist import ALERT_SCHEMA, stream_blocks
from netshield.streaming.blockops import LiveBlocklist
from netshield.streaming.detection import DetectionLoop
from netshield.streaming.features import ClosedWindows, pending_counters, stream_counters
from netshield.streaming.ingest import start_ingest
from netshield.streaming.reports import StandingReport
from netshield.streaming.series import SeriesStore
from netshield.streaming.tables import finish

_COUNTERS = ("request_count", "request_rate", "get_ratio", "bytes_mean", "bytes_std", "bytes_skew",
             "time_kurt", "error_rate", "session_length")


def log_stream(spark, sf_dir):
    """The events table as a stream, in access-log form."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return access_logs(source)


def stream_features(spark, sf_dir):
    out = work_dir(spark, "closed-windows")
    stream = log_stream(spark, sf_dir)
    windows = ClosedWindows(f"{out}/tables")
    finish(windows.start(stream, f"{out}/checkpoint", once=True))
    pending = windows.open_windows(spark, stream.schema)
    done = spark.read.schema(pending.schema).parquet(f"{out}/tables/features")
    return done.select(*pending.columns).unionByName(pending).select(
        "ip", ntz("win"), ntz("timestamp"), *[shown(n) for n in FEATURES])


def stream_window_counters(spark, sf_dir):
    """Native watermarked aggregation, with the windows that the watermark has not passed at the end."""
    out = work_dir(spark, "counters")
    table = stream_counters(log_stream(spark, sf_dir))
    query = (table.writeStream.format("parquet").option("path", f"{out}/table")
             .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start())
    finish(query)
    done = spark.read.schema(table.schema).parquet(f"{out}/table")
    pending = pending_counters(logs(spark, sf_dir))
    return done.unionByName(pending.select(*done.columns)).select("ip", ntz("win"), *[shown(n) for n in _COUNTERS])


def stream_blocklist(spark, sf_dir):
    out = work_dir(spark, "blocks")
    failed = log_stream(spark, sf_dir).where(F.col("status") >= 500)
    blocks = stream_blocks(failed, SUPPRESS_OPTIONS)
    query = (blocks.writeStream.format("parquet").option("path", f"{out}/table").outputMode("append")
             .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start())
    finish(query)
    done = spark.read.schema(ALERT_SCHEMA).parquet(f"{out}/table")
    return done.select("ip", F.unix_micros("added_at").alias("us"))


def stream_sink(spark, sf_dir):
    """Raw messages through the ingest stream; the detector rows it wrote."""
    out = work_dir(spark, "ingest")
    messages = raw(spark, sf_dir).select("client_address", "data", "recv_ts")
    messages.write.option("maxRecordsPerFile", Options().task_rows).parquet(f"{out}/raw")
    stream = spark.readStream.schema(RAW_SCHEMA).parquet(f"{out}/raw")
    prefixes, geo = prefix_buckets(prefix_load(spark, sf_dir)), geo_buckets(geo_dimension(spark, sf_dir))
    # One batch takes the whole table, so its time grows with it.
    finish(start_ingest(stream, prefixes, geo, f"{out}/tables", f"{out}/checkpoint", once=True), timeout_seconds=7200)
    rows = spark.read.parquet(f"{out}/tables/rows")
    return plain_types(rows.drop("seq", "batch_id"))


def stream_alerts(spark, sf_dir):
    out = work_dir(spark, "detection")
    loop = DetectionLoop(f"{out}/tables", scorer(), opts=OPTIONS)
    finish(loop.start(log_stream(spark, sf_dir), f"{out}/checkpoint", once=True))
    return plain_types(spark.read.parquet(f"{out}/tables/blocks").drop("batch_id"))


#: Seconds of log in a file, so that a stream takes several batches.
PART_SECONDS = 90
START_US = 1_704_067_200_000_000


#: Rows in a file of a part, about.
FILE_ROWS = 1_000_000


def in_parts(df, us, path):
    """Write rows in files of one part of time each, in order; a part is streamed in a batch.

    All parts have as many files, written by as many tasks, as the largest one needs. A part of few rows is
    filled up with empty files, so that every batch takes exactly its part.
    """
    part = F.floor((us - START_US) / (PART_SECONDS * 1_000_000))
    rows = df.withColumn("part", part)
    sizes = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()
    files = max((-(-size["n"] // FILE_ROWS) for size in sizes), default=1)
    for done, size in enumerate(sizes, 1):
        here = rows.where(F.col("part") == size["part"]).drop("part")
        here.repartition(files).write.mode("append").parquet(path)
        written = sum(name.startswith("part-") for name in names_in(df.sparkSession, path))
        for _ in range(files * done - written):
            here.limit(0).coalesce(1).write.mode("append").parquet(path)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


SERIES_OPTIONS = Options(series_max_age_seconds=100)


def pushed(spark, sf_dir):
    """Records of the log as pushed to their series: each with the part after it, too."""
    records = logs(spark, sf_dir).select("ip", "ts", F.concat_ws(" ", "status", "request").alias("payload"))
    again = records.withColumn("pushed_us", F.unix_micros("ts") + PART_SECONDS * 1_000_000)
    return records.withColumn("pushed_us", F.unix_micros("ts")).unionByName(again)


def live_series(spark, sf_dir):
    out = work_dir(spark, "series")
    stream = in_parts(pushed(spark, sf_dir), F.col("pushed_us"), f"{out}/in")
    store = SeriesStore(f"{out}/tables", SERIES_OPTIONS)
    finish(store.start(stream, f"{out}/checkpoint", once=True))
    return store


def stream_dedup(spark, sf_dir):
    """The live series after pushes of which every one comes again in the next batch."""
    return plain_types(live_series(spark, sf_dir).series(spark))


def stream_retention(spark, sf_dir):
    """What the versioned table still holds, folder ends included: nothing that a purge would delete."""
    store = live_series(spark, sf_dir)
    version = store.table.latest(spark)
    stored = store.table.read(spark, version)
    horizon = store.table.newest_us(spark, version) - SERIES_OPTIONS.series_max_age_seconds * 1_000_000
    live = store.series(spark).groupBy("ip").agg(
        F.count(F.lit(1)).alias("records"), F.min(F.unix_micros("ts")).alias("oldest_us"), F.max(F.unix_micros("ts")).alias("newest_us"))
    # whole parts before the horizon are gone from the files, too
    oldest = stored.agg(F.min(F.unix_micros("ts"))).first()[0]
    return live.withColumn("files_purged", F.lit(oldest > horizon - PART_SECONDS * 1_000_000))


def stream_restart(spark, sf_dir):
    """Blocks of a detection stream of several batches that fails once after a batch's work and starts again."""
    out = work_dir(spark, "restart")
    stream = in_parts(logs(spark, sf_dir), F.unix_micros("ts"), f"{out}/in")

    class Failing(DetectionLoop):
        def handle(self, batch, batch_id):
            super().handle(batch, batch_id)
            if batch_id == 1:
                raise RuntimeError("lost after the batch was written")

    try:
        finish(Failing(f"{out}/tables", scorer(), opts=OPTIONS).start(stream, f"{out}/checkpoint", once=True))
        raise AssertionError("the batch should have failed")
    except StreamingQueryException as error:
        if "lost after the batch was written" not in str(error):
            raise
    finish(DetectionLoop(f"{out}/tables", scorer(), opts=OPTIONS).start(stream, f"{out}/checkpoint", once=True))
    return plain_types(spark.read.parquet(f"{out}/tables/blocks").drop("batch_id"))


def stream_rollup(spark, sf_dir):
    """The traffic report after batches in mixed order: every batch brings rows of steps that earlier ones reported."""
    out = work_dir(spark, "report")
    rows = en.enrich(logs(spark, sf_dir), prefix_load(spark, sf_dir), geo_dimension(spark, sf_dir)).select(
        "seq", "ts", "status", "bytes_sent", "country", "city")
    mixed = F.pmod(F.unix_micros("ts") * 7 + F.col("seq") % 3 * PART_SECONDS * 1_000_000, F.lit(5 * PART_SECONDS * 1_000_000))
    stream = in_parts(rows, START_US + mixed, f"{out}/in")
    report = StandingReport(f"{out}/tables", merge_above=2)
    finish(report.start(stream, f"{out}/checkpoint", once=True))
    return plain_types(report.report(spark).withColumn("bytes", F.col("bytes").cast("bigint")))


def detection_tables(spark, sf_dir):
    """Folder of the tables that the detection loop writes in several batches."""
    out = work_dir(spark, "alert-rows")
    stream = in_parts(logs(spark, sf_dir), F.unix_micros("ts"), f"{out}/in")
    loop = DetectionLoop(f"{out}/tables", scorer(), resolutions(spark, sf_dir), geo_dimension(spark, sf_dir), OPTIONS)
    finish(loop.start(stream, f"{out}/checkpoint", once=True))
    return f"{out}/tables"


def stream_alert_rows(spark, sf_dir):
    """The alert table of a detection stream, all columns that the batch job's counterpart compares."""
    return shown_alerts(spark.read.parquet(f"{detection_tables(spark, sf_dir)}/alerts"))


def stream_gelf(spark, sf_dir):
    """The log-store documents that a detection stream writes."""
    return shown_documents(spark.read.parquet(f"{detection_tables(spark, sf_dir)}/gelf"))


COMMAND_OPTIONS = Options(block_seconds=40)


def block_commands(spark, sf_dir):
    """Commands made of the log: failures add, redirects remove, deep paths ask, and the whole list is purged and cleared."""
    op = (F.when(F.col("seq") % 997 == 5, "clear").when(F.col("seq") % 61 == 3, "purge").when(F.col("status") >= 500, "add")
          .when(F.col("status") == 301, "remove").when(F.col("seq") % 3 == 0, "contains"))
    table = logs(spark, sf_dir).select("seq", op.alias("op"), "ip", "ts").where("op IS NOT NULL")
    return table.withColumn("ip", F.when(~F.col("op").isin("clear", "purge"), F.col("ip")))


def stream_block_ops(spark, sf_dir):
    out = work_dir(spark, "block-ops")
    stream = in_parts(block_commands(spark, sf_dir), F.unix_micros("ts"), f"{out}/in")
    live = LiveBlocklist(f"{out}/tables", opts=COMMAND_OPTIONS)
    finish(live.start(stream, f"{out}/checkpoint", once=True))
    answers = spark.read.parquet(f"{out}/tables/answers").drop("batch_id")
    left = live.entries(spark).select("seq", "ip", "ts", F.lit(None).cast("boolean").alias("is_blocked"))
    return plain_types(answers.select("seq", "ip", "ts", "is_blocked").unionByName(left))


def block_ops_log(spark, sf_dir):
    """The same commands in one pass."""
    none = spark.createDataFrame([], LISTED)
    answers, left = apply_commands(block_commands(spark, sf_dir), none, COMMAND_OPTIONS)
    left = left.select("seq", "ip", "ts", F.lit(None).cast("boolean").alias("is_blocked"))
    return plain_types(answers.unionByName(left))


QUERIES = {
    "stream_dedup": stream_dedup,
    "stream_retention": stream_retention,
    "stream_restart": stream_restart,
    "stream_rollup": stream_rollup,
    "stream_alert_rows": stream_alert_rows,
    "stream_gelf": stream_gelf,
    "stream_block_ops": stream_block_ops,
    "block_ops_log": block_ops_log,
    "stream_features": stream_features,
    "stream_window_counters": stream_window_counters,
    "stream_blocklist": stream_blocklist,
    "stream_sink": stream_sink,
    "stream_alerts": stream_alerts,
}

ORACLES = {
    "stream_features": FEATURE["feat_all"],
    "stream_window_counters": feature_sql(_COUNTERS),
    "stream_blocklist": DETECT["alert_suppression"],
    "stream_sink": with_logs(f"""{PARSED}, {_ADDRESSES}, {_PREFIXES}, {_BEST}
SELECT typed.* FROM typed LEFT JOIN best USING (ip)
WHERE request_length IS NOT NULL AND status IS NOT NULL AND bytes_sent IS NOT NULL
  AND request_time IS NOT NULL AND NOT {STATIC_SQL.format(r='request')} AND coalesce(net.s, 0) = 0"""),
    "stream_alerts": DETECT["block_output"],
}

_SERIES = """
, records AS (SELECT DISTINCT ip, ts, us, status || ' ' || request AS payload FROM logs),
live AS (SELECT * FROM records WHERE us > (SELECT max(us) FROM logs) - 100000000)
"""
ORACLES["stream_dedup"] = with_logs(f"{_SERIES} SELECT ip, ts, payload FROM live")
ORACLES["stream_retention"] = with_logs(f"""{_SERIES}
SELECT ip, count(*) AS records, min(us) AS oldest_us, max(us) AS newest_us, true AS files_purged FROM live GROUP BY ip""")
ORACLES["stream_rollup"] = SERIES["traffic_rollup"]
ORACLES["stream_restart"] = DETECT["block_output"]
ORACLES["stream_alert_rows"], ORACLES["stream_gelf"] = DETECT["detect_alerts"], DETECT["gelf_alerts"]
# What holds for an address at an instant, from the latest earlier command of each kind.
ORACLES["block_ops_log"] = ORACLES["stream_block_ops"] = with_logs("""
, commands AS (
  SELECT seq, ip, ts, us, CASE WHEN seq % 997 = 5 THEN 'clear' WHEN seq % 61 = 3 THEN 'purge' WHEN status >= 500 THEN 'add'
    WHEN status = 301 THEN 'remove' WHEN seq % 3 = 0 THEN 'contains' END AS op FROM logs),
moments AS (
  SELECT seq, ip, ts, us, op = 'contains' AS asked FROM commands WHERE op = 'contains'
  UNION ALL
  SELECT NULL, ip, NULL, 9223372036854775807, false FROM commands WHERE op = 'add' GROUP BY ip),
latest AS (
  SELECT m.seq, m.ip, m.ts, m.asked, m.us,
    max((c.us, c.seq)) FILTER (c.op = 'add' AND c.ip = m.ip) AS added,
    max((c.us, c.seq)) FILTER (c.op = 'clear' OR c.op = 'remove' AND c.ip = m.ip) AS gone,
    max((c.us, c.seq)) FILTER (c.op = 'purge') AS purged
  FROM moments m JOIN commands c ON c.op <> 'contains' AND (c.op IN ('clear', 'purge') OR c.ip = m.ip)
    AND (c.us < m.us OR c.us = m.us AND c.seq < m.seq)
  GROUP BY ALL),
held AS (
  SELECT m.seq, m.ip, m.ts, m.asked, added, added IS NOT NULL AND (gone IS NULL OR gone < added)
    AND (purged IS NULL OR purged < added OR added[1] > purged[1] - 40000000) AS listed
  FROM moments m LEFT JOIN latest l ON l.ip = m.ip AND l.us = m.us AND l.seq IS NOT DISTINCT FROM m.seq)
SELECT seq, ip, ts, coalesce(listed, false) AS is_blocked FROM held WHERE asked
UNION ALL SELECT added[2], ip, make_timestamp(added[1]), NULL FROM held WHERE NOT asked AND listed""")
