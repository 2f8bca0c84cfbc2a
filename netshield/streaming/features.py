"""Features on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from netshield.operators.features import counters, minute_features, value_counts, with_window
from netshield.options import Options
from netshield.streaming.tables import forget, read_table, run, write_batch

_PROGRESS = StructType([StructField("closed_us", LongType())])


def _windowed(stream: DataFrame, opts: Options) -> DataFrame:
    timed = stream.withWatermark("ts", opts.watermark)
    return timed.withColumns({
        "us": F.unix_micros("ts"), "win": F.window("ts", f"{opts.window_seconds} seconds")})


def stream_counters(stream: DataFrame, opts: Options = Options()) -> DataFrame:
    """The algebraic features of each (ip, window), emitted when the watermark passes the window."""
    table = counters(_windowed(stream, opts), ["ip", "win"], opts)
    return table.withColumn("win", F.col("win.start"))


def pending_counters(rows: DataFrame, opts: Options = Options()) -> DataFrame:
    """The features of ``stream_counters`` for the windows of ``rows`` that end after the final watermark.

    For the end of an input, whose last windows no later row closes. Windows that the watermark has
    passed are left to the stream, whether it emitted them or not.
    """
    final = rows.agg((F.max("ts") - F.expr(f"interval {opts.watermark}")).alias("watermark"))
    end = F.unix_micros("win") + opts.window_seconds * 1_000_000
    timed = with_window(rows, opts).join(F.broadcast(final), end > F.unix_micros("watermark")).drop("watermark")
    return counters(timed, ["ip", "win"], opts)


def stream_value_counts(stream: DataFrame, opts: Options = Options()) -> DataFrame:
    """Value counts per (ip, window) for entropies, emitted with the watermark."""
    return value_counts(_windowed(stream, opts), ["ip", "win"]).withColumn("win", F.col("win.start"))


class ClosedWindows:
    """All 36 features of each window once the watermark has passed it.

    Gaps and bursts need a window's requests in order, which streaming aggregations cannot see. So
    rows go to a table partitioned by window, and each batch computes the windows that it closes with
    the batch operators. State is two tables of per-batch folders, so a retried batch repeats itself.
    Rows that arrive after their window was closed go to the table ``late``, whose batches count
    them. Rows of closed windows are deleted one batch after their features were written.
    """

    def __init__(self, out: str, delay_seconds: int | None = None, opts: Options = Options()):
        self.out, self.opts = out, opts
        delay = opts.series_max_age_seconds if delay_seconds is None else delay_seconds
        self.delay_us = delay * 1_000_000

    def _closed_before(self, spark, batch_id: int) -> int:
        """End of the last window closed by earlier batches."""
        if batch_id == 0:
            return 0
        progress = read_table(spark, f"{self.out}/progress", _PROGRESS)
        row = progress.where(F.col("batch_id") < batch_id).agg(F.max("closed_us")).first()
        return row[0] or 0

    def handle(self, batch: DataFrame, batch_id: int) -> None:
        spark, window_us = batch.sparkSession, self.opts.window_us
        before = self._closed_before(spark, batch_id)
        start = F.expr(f"us div {window_us} * {window_us}")
        rows = batch.withColumn("us", F.unix_micros("ts")).withColumn("win_us", start)
        in_time = rows.where(F.col("win_us") + window_us > before)
        write_batch(in_time.drop("us"), f"{self.out}/rows", batch_id, "win_us")
        write_batch(rows.where(F.col("win_us") + window_us <= before).drop("us"), f"{self.out}/late", batch_id)
        newest = rows.agg(F.max("us")).first()[0] or 0
        closed = max(before, (newest - self.delay_us) // window_us * window_us)
        self._emit(spark, batch.schema, before, closed, batch_id)
        write_batch(spark.range(1).select(F.lit(closed).cast("long").alias("closed_us")),
                    f"{self.out}/progress", batch_id)
        forget(spark, f"{self.out}/rows", "win_us", before, batch_id)

    def _rows(self, spark, schema) -> DataFrame:
        return read_table(spark, f"{self.out}/rows", StructType([*schema.fields, StructField("win_us", LongType())]))

    def _emit(self, spark, schema, after: int, until: int, batch_id: int) -> None:
        ready = self._rows(spark, schema).where(
            (F.col("win_us") >= after) & (F.col("win_us") < until) & (F.col("batch_id") <= batch_id))
        write_batch(minute_features(ready, self.opts), f"{self.out}/features", batch_id)

    def open_windows(self, spark, schema) -> DataFrame:
        """Features so far of the windows that no batch has closed yet."""
        progress = read_table(spark, f"{self.out}/progress", _PROGRESS)
        closed = progress.agg(F.max("closed_us").alias("closed_us"))
        rows = self._rows(spark, schema).join(F.broadcast(closed), F.col("win_us") >= F.col("closed_us"))
        return minute_features(rows, self.opts)

    def start(self, stream: DataFrame, checkpoint: str, once: bool = False) -> StreamingQuery:
        return run(stream, self.handle, checkpoint, once, self.opts)
