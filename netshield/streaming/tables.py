"""Per-batch tables: every micro-batch owns one folder and rewrites it when retried."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamReader, StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from netshield.options import Options


def write_batch(df: DataFrame, table: str, batch_id: int, *partitions: str) -> None:
    """Store a batch's rows; running the batch again replaces them."""
    df.write.mode("overwrite").partitionBy(*partitions).parquet(f"{table}/batch_id={batch_id}")


def spread(batch: DataFrame, opts: Options = Options()) -> DataFrame:
    """Deal a batch's rows evenly to a task for every ``task_rows`` of them; a batch within that stays as it is.

    A source deals by files, their row groups or queue partitions, so that one task may get all rows.
    """
    tasks = -(-batch.count() // opts.task_rows)
    return batch.repartition(tasks) if tasks > 1 else batch


def read_table(spark: SparkSession, table: str, schema: StructType) -> DataFrame:
    """All batches so far; ``batch_id`` and partition columns prune folders."""
    stored = StructType([*schema.fields, StructField("batch_id", LongType())])
    return spark.read.schema(stored).parquet(table)


def forget(spark: SparkSession, table: str, partition: str, before: int, keep_batch: int) -> None:
    """Delete the folders ``partition=value`` with values under ``before``, and emptied batches.

    The folders of batch ``keep_batch`` stay. Deleting again what is gone does nothing, so a retried
    batch repeats it.
    """
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(table)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(root):
        return
    for batch in store.listStatus(root):
        if not batch.isDirectory() or batch.getPath().getName() == f"batch_id={keep_batch}":
            continue
        left = 0
        for part in store.listStatus(batch.getPath()):
            name, _, value = part.getPath().getName().partition("=")
            if name == partition and value.lstrip("-").isdigit() and int(value) < before:
                store.delete(part.getPath(), True)
            elif part.isDirectory():
                left += 1
        if not left:
            store.delete(batch.getPath(), True)


def run(stream: DataFrame, handle, checkpoint: str, once: bool = False,
        opts: Options = Options()) -> StreamingQuery:
    """Start a query that hands each micro-batch to ``handle(batch, batch_id)``.

    The source's own options bound a batch; the trigger bounds its age. A failed batch is retried
    from the checkpoint.
    """
    trigger = {"availableNow": True} if once else {"processingTime": opts.flush_interval}
    return (stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
            .trigger(**trigger).start())


def kafka_source(spark: SparkSession, servers: str, topic: str, per_batch: int) -> DataStreamReader:
    """Reader for a topic of messages; needs Spark's Kafka package on the class path."""
    return (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
            .option("subscribe", topic).option("maxOffsetsPerTrigger", per_batch))


def finish(query: StreamingQuery, timeout_seconds: int = 600) -> None:
    """Wait for a bounded query; stop it and fail when it does not end in time."""
    if not query.awaitTermination(timeout_seconds):
        query.stop()
        raise TimeoutError(f"stream {query.id} did not finish")
