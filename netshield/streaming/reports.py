"""The traffic report of a stream of enriched logs, kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from netshield.operators.rollups import CELLS, combine_cells, traffic_cells, traffic_of_cells
from netshield.options import Options
from netshield.streaming.state import StateTable
from netshield.streaming.tables import run


class StandingReport:
    """Requests, errors and bytes per step of time and place, with subtotals, of all batches so far.

    A batch adds one cell for each step and place among its rows, whatever their times, so requests that
    come late correct their own step. Subtotals are taken from the cells when the report is read. The
    table keeps every step: it grows with steps times places, not with requests. Rows without a time
    are left out, as in the batch report.
    """

    def __init__(self, out: str, every: str = "1 minute", opts: Options = Options(), **state):
        self.every, self.opts = every, opts
        self.cells = StateTable(f"{out}/cells", CELLS, time="win", combine=combine_cells, **state)

    def handle(self, batch: DataFrame, batch_id: int) -> None:
        self.cells.commit(traffic_cells(batch, self.every), batch_id)

    def report(self, spark: SparkSession) -> DataFrame:
        """The report after the newest complete batch."""
        return traffic_of_cells(self.cells.read(spark, self.cells.latest(spark)))

    def start(self, stream: DataFrame, checkpoint: str, once: bool = False) -> StreamingQuery:
        return run(stream, self.handle, checkpoint, once, self.opts)
