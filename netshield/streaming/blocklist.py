"""Blocking state on a stream of detections."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from netshield.options import Options

ALERT_SCHEMA = "ip string, added_at timestamp, expires_at timestamp"


def _blocker(block_us: int) -> StatefulProcessor:
    class Blocker(StatefulProcessor):
        """Per address: the start of its current block. Emits one row per new block."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self._handle = handle
            self._added = handle.getValueState("added", "us long")

        def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame],
                            timerValues: Any) -> Iterator[pd.DataFrame]:
            instants = sorted({int(us) for batch in rows for us in batch["us"]})
            added = self._added.get()[0] if self._added.exists() else None
            started = []
            for us in instants:
                if added is None or us - added >= block_us:
                    added = us
                    started.append(us)
            if not started:
                return
            self._added.update((added,))
            for timer in self._handle.listTimers():
                self._handle.deleteTimer(timer)
            self._handle.registerTimer((added + block_us) // 1000 + 1)
            times = pd.to_datetime(pd.Series(started, dtype="int64"), unit="us")
            yield pd.DataFrame({"ip": key[0], "added_at": times,
                                "expires_at": times + pd.Timedelta(block_us, "us")})

        def handleExpiredTimer(self, key: Any, timerValues: Any,
                               expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
            self._added.clear()
            return iter(())

        def close(self) -> None:
            pass

    return Blocker()


def stream_blocks(detections: DataFrame, opts: Options = Options()) -> DataFrame:
    """Detections ``(ip, ts)`` → new blocklist entries; repeats during a block are suppressed.

    A block's age is compared on every detection; the event-time timer only frees old state. Keyed
    state with timers needs Spark's RocksDB state store, which is selected for the session.
    """
    detections.sparkSession.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    timed = detections.select("ip", "ts", F.unix_micros("ts").alias("us")).withWatermark(
        "ts", opts.watermark)
    return timed.groupBy("ip").transformWithStateInPandas(
        statefulProcessor=_blocker(opts.block_seconds * 1_000_000), outputStructType=ALERT_SCHEMA,
        outputMode="Append", timeMode="EventTime")
