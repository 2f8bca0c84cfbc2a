"""The live blocklist under a stream of commands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from netshield.operators.blockops import LISTED, apply_commands
from netshield.options import Options
from netshield.session import scratch, settle
from netshield.streaming.state import StateTable
from netshield.streaming.tables import run, write_batch


class LiveBlocklist:
    """Applies commands batch by batch; ``{out}/answers`` holds what ``contains`` commands found.

    ``listed`` gives the entries at the start, as ``(ip, ts, seq)``. The list is a versioned table, so a
    batch that is run again starts from the same list. Batches should follow each other in time: a
    command that comes late is answered by the list's entries that are older than it.
    """

    def __init__(self, out: str, listed: DataFrame | None = None, opts: Options = Options()):
        self.out, self.listed, self.opts = out, listed, opts
        self.table = StateTable(f"{out}/listed", LISTED)

    def handle(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        with scratch(spark):
            known = self.table.read(spark, batch_id - 1)
            if batch_id == 0 and self.listed is not None:
                known = self.listed.select("ip", "ts", F.col("seq").cast("bigint").alias("seq"))
            commands = settle(batch.select("seq", "op", "ip", "ts"), "commands")
            answers, after = apply_commands(commands, known, self.opts)
            write_batch(answers, f"{self.out}/answers", batch_id)
            self.table.replace(after, batch_id)

    def entries(self, spark: SparkSession) -> DataFrame:
        return self.table.read(spark, self.table.latest(spark))

    def start(self, stream: DataFrame, checkpoint: str, once: bool = False) -> StreamingQuery:
        return run(stream, self.handle, checkpoint, once, self.opts)
