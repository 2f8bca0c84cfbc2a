"""Continuous ingestion: raw messages → log table, detector rows, log-store documents, quarantine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from netshield.operators.gelf import gelf_documents
from netshield.operators.lookup import geo_buckets, prefix_buckets
from netshield.options import Options
from netshield.plans.ingestion import detector_rows, gelf_messages, ingest_parsed
from netshield.session import scratch, settle
from netshield.sources.syslog import parse_messages
from netshield.streaming.tables import run, spread, write_batch


def start_ingest(raw: DataFrame, prefixes: DataFrame, geo: DataFrame, out: str, checkpoint: str,
                 time_field: str | None = None, once: bool = False,
                 opts: Options = Options()) -> StreamingQuery:
    """Run the ingest job on a stream of raw messages.

    The lookup tables are built once and serve every batch.
    A batch is dealt evenly to tasks and parsed once, for usable and other messages, and enriched once into
    ``{out}/logs``; the other outputs read that table.
    """

    prefixes, geo = prefix_buckets(prefixes), geo_buckets(geo)

    def handle(batch: DataFrame, batch_id: int) -> None:
        with scratch(batch.sparkSession):
            write(batch, batch_id)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        parsed = parse_messages(spread(batch, opts))
        # usable messages don't need their bytes any more
        messages = settle(parsed.withColumn("data", F.when(F.col("reason").isNotNull(), F.col("data"))), "messages")
        logs, bad = ingest_parsed(messages, prefixes, geo, time_field, opts)
        write_batch(logs, f"{out}/logs", batch_id)
        write_batch(bad, f"{out}/quarantine", batch_id)
        written = spark.read.schema(logs.schema).parquet(f"{out}/logs/batch_id={batch_id}")
        write_batch(detector_rows(written), f"{out}/rows", batch_id)
        documents = gelf_documents(gelf_messages(written, opts.log_tag, "logs", "logs"),
                                   F.unix_timestamp(F.current_timestamp()))
        write_batch(documents, f"{out}/gelf", batch_id)

    return run(raw, handle, checkpoint, once, opts)
