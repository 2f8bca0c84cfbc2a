"""Versioned tables of state that a stream carries from one micro-batch to the next.

A version is a manifest: the folders that hold the table's rows after a batch, with the range of
times in each. A batch writes its rows to a folder of its own and then its manifest, made of its
predecessor's; a batch that is run again starts from the same predecessor and overwrites both, so that
nothing is added twice. Folders whose rows have all expired leave the manifest, many small ones are
merged into one, and what no kept version names is deleted. A batch reads as many manifests as
versions are kept, and lists no folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from netshield.session import delete, exists, names_in

_ENTRY = "folder string, low_us bigint, high_us bigint, rows bigint"


class StateTable:
    """A table of rows with a time, of which a batch reads version ``batch_id - 1`` and commits ``batch_id``.

    ``time`` names the timestamp column by which rows expire. ``merge_above`` folders are merged into
    one. ``versions`` manifests are kept; two is the least that allows a batch to be repeated.

    With ``combine``, which makes one row of rows that belong together, the table is of partial results:
    merging combines them, and takes small folders before large ones, so that a row is rewritten as
    often as the logarithm of the table's size. Readers combine what different folders hold.
    """

    def __init__(self, path: str, schema: StructType | str, time: str = "ts", merge_above: int = 8, versions: int = 3,
                 combine: Callable[[DataFrame], DataFrame] | None = None):
        if versions < 2:
            raise ValueError("a repeated batch needs its predecessor's version")
        self.path, self.schema, self.time = path.rstrip("/"), schema, time
        self.merge_above, self.versions, self.combine = merge_above, versions, combine

    def _manifest(self, version: int) -> str:
        return f"{self.path}/manifest/version={version}"

    def entries(self, spark: SparkSession, version: int) -> list[Row]:
        """The folders of a version; none before the first one and for versions that aren't kept."""
        if version < 0 or not exists(spark, f"{self._manifest(version)}/_SUCCESS"):
            return []
        return spark.read.schema(_ENTRY).parquet(self._manifest(version)).orderBy("low_us", "folder").collect()

    def latest(self, spark: SparkSession) -> int:
        """The newest complete version, or -1."""
        found = [int(name.partition("=")[2]) for name in names_in(spark, f"{self.path}/manifest") if name.startswith("version=")]
        return max((v for v in found if exists(spark, f"{self._manifest(v)}/_SUCCESS")), default=-1)

    def read(self, spark: SparkSession, version: int, since_us: int | None = None) -> DataFrame:
        """The rows of a version, from ``since_us`` on."""
        return self._read(spark, self.entries(spark, version), since_us)

    def _read(self, spark: SparkSession, entries: list[Row], since_us: int | None) -> DataFrame:
        folders = [f"{self.path}/data/{e['folder']}" for e in entries if since_us is None or e["high_us"] >= since_us]
        if not folders:
            return spark.createDataFrame([], self.schema)
        rows = spark.read.schema(self.schema).parquet(*folders)
        return rows if since_us is None else rows.where(F.unix_micros(self.time) >= since_us)

    def newest_us(self, spark: SparkSession, version: int) -> int | None:
        return max((e["high_us"] for e in self.entries(spark, version)), default=None)

    def _write(self, rows: DataFrame, folder: str) -> list[Row]:
        spark, path = rows.sparkSession, f"{self.path}/data/{folder}"
        us = F.unix_micros(self.time)
        rows.where(us.isNotNull()).write.mode("overwrite").parquet(path)
        found = spark.read.schema(self.schema).parquet(path).agg(F.min(us).alias("low"), F.max(us).alias("high"), F.count(F.lit(1)).alias("n")).first()
        if not found["n"]:
            delete(spark, path)  # no version will name it
            return []
        return [Row(folder=folder, low_us=found["low"], high_us=found["high"], rows=found["n"])]

    def commit(self, added: DataFrame, version: int, keep_from_us: int | None = None) -> None:
        """Add rows to the predecessor's and let those before ``keep_from_us`` go.

        Single expired rows stay until their folder has no others or is merged; readers give
        ``since_us``. Rows without a time are left out.
        """
        spark = added.sparkSession
        kept = [e for e in self.entries(spark, version - 1) if keep_from_us is None or e["high_us"] >= keep_from_us]
        kept += self._write(added, f"{version}-added")
        if len(kept) > self.merge_above:
            merged, kept = self._to_merge(kept)
            rows = self._read(spark, merged, keep_from_us)
            kept = kept + self._write(self.combine(rows) if self.combine else rows, f"{version}-merged")
            if any(e["folder"] == f"{version}-added" for e in merged):
                delete(spark, f"{self.path}/data/{version}-added")  # no version names it
        self._publish(spark, version, kept)

    def _to_merge(self, entries: list[Row]) -> tuple[list[Row], list[Row]]:
        """The folders to merge and the others: two of the smallest, and on while one isn't much larger than those before it."""
        if not self.combine:
            return entries, []
        by_size = sorted(entries, key=lambda e: (e["rows"], e["folder"]))
        n = 2
        while n < len(by_size) and by_size[n]["rows"] <= 2 * sum(e["rows"] for e in by_size[:n]):
            n += 1
        return by_size[:n], by_size[n:]

    def replace(self, rows: DataFrame, version: int) -> None:
        """Make ``rows`` all that the version holds."""
        self._publish(rows.sparkSession, version, self._write(rows, f"{version}-all"))

    def _publish(self, spark: SparkSession, version: int, entries: list[Row]) -> None:
        table = spark.createDataFrame([tuple(e) for e in entries], _ENTRY)
        table.coalesce(1).write.mode("overwrite").parquet(self._manifest(version))
        old = version - self.versions
        if old < 0:
            return
        gone = {e["folder"] for e in self.entries(spark, old)}
        for later in range(old + 1, version + 1):
            gone -= {e["folder"] for e in self.entries(spark, later)}
        for folder in sorted(gone):
            delete(spark, f"{self.path}/data/{folder}")
        delete(spark, self._manifest(old))
