"""The live series of every address on a stream of pushed records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from netshield.operators.series import KEY, dedup
from netshield.options import Options
from netshield.session import scratch
from netshield.streaming.state import StateTable
from netshield.streaming.tables import run

_SCHEMA = "ip string, ts timestamp, payload string"


class SeriesStore:
    """Records ``(ip, ts, payload)`` of the last ``series_max_age_seconds``, equal ones once.

    A record that is pushed again in a later batch changes nothing; one with a later time is another
    record. Age counts from the newest time seen so far. Records that are too old when they come are
    listed in ``late``, which keeps the lists of as many batches as the state keeps versions.
    """

    def __init__(self, out: str, opts: Options = Options(), **state):
        self.out, self.opts = out, opts
        self.table = StateTable(f"{out}/series", _SCHEMA, **state)
        self.late = StateTable(f"{out}/late", _SCHEMA, **state)

    def handle(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        with scratch(spark):
            records = batch.select(*KEY)
            times = records.agg(F.min(F.unix_micros("ts")).alias("low"), F.max(F.unix_micros("ts")).alias("high")).first()
            newest = [us for us in (self.table.newest_us(spark, batch_id - 1), times["high"]) if us is not None]
            horizon = max(newest, default=0) - self.opts.series_max_age_seconds * 1_000_000
            fresh = F.unix_micros("ts") > horizon
            known = self.table.read(spark, batch_id - 1, max(horizon, times["low"] or horizon)).alias("known")
            same = reduce(lambda a, b: a & b, [F.col(f"new.{c}").eqNullSafe(F.col(f"known.{c}")) for c in KEY])
            added = dedup(records.where(fresh)).alias("new").join(known, same, "left_anti")
            self.table.commit(added, batch_id, horizon + 1)
            self.late.commit(records.where(~fresh), batch_id, horizon - self.opts.series_max_age_seconds * 1_000_000)

    def series(self, spark: SparkSession) -> DataFrame:
        """The live records after the newest complete batch."""
        version = self.table.latest(spark)
        newest = self.table.newest_us(spark, version)
        since = None if newest is None else newest - self.opts.series_max_age_seconds * 1_000_000 + 1
        return self.table.read(spark, version, since)

    def start(self, stream: DataFrame, checkpoint: str, once: bool = False) -> StreamingQuery:
        return run(stream, self.handle, checkpoint, once, self.opts)
