"""The live detection loop: evaluate new ticks on each batch of detector rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from netshield.operators.blocklist import drop_blocked, forget_blocked
from netshield.operators.gelf import gelf_documents
from netshield.operators.scoring import Scorer
from netshield.options import Options
from netshield.plans.detection import detect, new_blocks
from netshield.plans.ingestion import alert_messages
from netshield.session import scratch
from netshield.streaming.state import StateTable
from netshield.streaming.tables import run, write_batch

_BLOCKS = "ip string, added_at timestamp, expires_at timestamp"
_PROGRESS = "tick_us bigint, at timestamp"


class DetectionLoop:
    """Alerts and blocklist entries from a stream of eligible typed rows.

    Rows of blocked addresses are not collected. Three versioned tables hold the state: recent rows, of
    which a batch reads only what its new ticks reach back to, blocks that may still hold back rows,
    and the last evaluated tick. Older rows and blocks go from them, and what a batch settles on its way
    goes with it. Rows no newer than the last evaluated tick can't be evaluated at their time any
    more; they still count in later windows and are listed in the table ``late``. Outputs are one
    folder a batch: ``alerts``, ``blocks``, ``late``, and the alerts as log-store documents in ``gelf``.
    """

    def __init__(self, out: str, scorer: Scorer, hostnames: DataFrame | None = None,
                 geo: DataFrame | None = None, opts: Options = Options()):
        self.out, self.scorer, self.opts = out, scorer, opts
        self.hostnames, self.geo = hostnames, geo

    def _state(self, schema: StructType) -> tuple[StateTable, StateTable, StateTable]:
        return (StateTable(f"{self.out}/state/rows", schema), StateTable(f"{self.out}/state/blocks", _BLOCKS, "expires_at"),
                StateTable(f"{self.out}/state/progress", _PROGRESS, "at"))

    def handle(self, batch: DataFrame, batch_id: int) -> None:
        with scratch(batch.sparkSession):
            self._evaluate(batch, batch_id)

    def _evaluate(self, batch: DataFrame, batch_id: int) -> None:
        spark, opts = batch.sparkSession, self.opts
        held, listed, progress = self._state(batch.schema)
        last = progress.read(spark, batch_id - 1).first()
        before = last["tick_us"] if last else 0
        oldest = before - 2 * opts.window_us
        blocks = listed.read(spark, batch_id - 1)
        newest = batch.agg(F.max(F.unix_micros("ts"))).first()[0]
        step = opts.tick_seconds * 1_000_000
        write_batch(batch.where(F.unix_micros("ts") <= before), f"{self.out}/late", batch_id)
        until = before if newest is None else max(before, newest // step * step)
        held.commit(drop_blocked(batch, blocks, opts=opts), batch_id, oldest)
        recent = forget_blocked(held.read(spark, batch_id, oldest), blocks, opts=opts)
        alerts = detect(recent, self.scorer, self.hostnames, self.geo, opts, after_us=before, until_us=until)
        write_batch(alerts, f"{self.out}/alerts", batch_id)
        written = spark.read.schema(alerts.schema).parquet(f"{self.out}/alerts/batch_id={batch_id}")
        started = new_blocks(written, opts)
        write_batch(started, f"{self.out}/blocks", batch_id)
        listed.commit(started, batch_id, oldest)  # a block that ended before all rows of use holds back none
        documents = gelf_documents(alert_messages(written, "alerts", "alerts"),
                                   F.unix_timestamp(F.current_timestamp()))
        write_batch(documents, f"{self.out}/gelf", batch_id)
        progress.replace(spark.range(1).select(
            F.lit(until).cast("long").alias("tick_us"), F.timestamp_micros(F.lit(until)).alias("at")), batch_id)

    def start(self, stream: DataFrame, checkpoint: str, once: bool = False) -> StreamingQuery:
        return run(stream, self.handle, checkpoint, once, self.opts)
