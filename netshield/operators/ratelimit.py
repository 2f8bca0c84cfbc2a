"""Sliding-log rate limiting: a request passes while fewer than N passed in the last second."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netshield.session import settle

_SECOND = 1_000_000
_PART_SECONDS = 8
_OUT = "ip string, us long, allowed long, remaining long, reset_us long"


def _walk(limit: int):
    """Carry the log of passed requests over instants sorted by (ip, part, us)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        owner, passed, held = None, deque(), 0
        for batch in batches:
            size = len(batch)
            allowed, remaining, reset = (np.zeros(size, dtype=np.int64) for _ in range(3))
            columns = (batch[c].to_numpy() for c in ("ip", "part", "us", "c"))
            for i, (ip, part, us, count) in enumerate(zip(*columns)):
                if (ip, part) != owner:
                    owner, held = (ip, part), 0
                    passed.clear()
                while passed and us - passed[0][0] > _SECOND:
                    held -= passed.popleft()[1]
                take = min(int(count), limit - held)
                if take:
                    passed.append((us, take))
                    held += take
                allowed[i], remaining[i] = take, limit - held
                reset[i] = max(0, passed[0][0] + _SECOND - us) if passed else 0
            out = pd.DataFrame({"ip": batch["ip"], "us": batch["us"], "allowed": allowed,
                                "remaining": remaining, "reset_us": reset})
            yield out[~batch["seed"].to_numpy()]

    return run


def decide_instants(requests: DataFrame, limit: int) -> DataFrame:
    """Per distinct ``(ip, us)``: how many of its requests pass, and the log's state after it.

    Requests of one instant are counted map-side. The log then depends on what passed before, so an
    address is cut into parts wherever its state is known: after a silent second it is empty, and
    where the two seconds before a cut hold at most ``limit`` requests, all of the last second
    passed and seeds the new part; cuts are tried every ``_PART_SECONDS``. Only stretches that stay above half the limit are walked
    in one piece, streamed in order with at most ``limit`` log entries in memory.
    """
    second = F.expr(f"us div {_SECOND}")
    instants = settle(
        requests.groupBy("ip", "us").agg(F.count(F.lit(1)).alias("c")).withColumn("sec", second), "instants")
    by_ip = Window.partitionBy("ip").orderBy("sec")
    silent = F.coalesce(F.col("first_us") - F.lag("last_us").over(by_ip) > _SECOND, F.lit(True))
    # a cut repeats the second before it as a seed, so it's made where a part has grown to some seconds
    eighth = F.expr(f"sec div {_PART_SECONDS}")
    calm = (F.lag(eighth).over(by_ip) < eighth) & (
        F.coalesce(F.sum("n").over(by_ip.rangeBetween(-2, -1)), F.lit(0)) <= limit)
    seconds = (
        instants.groupBy("ip", "sec")
        .agg(F.sum("c").alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))
        .withColumns({"silent": silent, "calm": calm})
        .withColumn("part", F.sum((F.col("silent") | F.col("calm")).cast("int")).over(by_ip))
    )
    seconds = settle(seconds, "seconds")
    own = instants.join(seconds.select("ip", "sec", "part"), ["ip", "sec"]).withColumn("seed", F.lit(False))
    seeded = seconds.where(F.col("calm") & ~F.col("silent")).select(
        "ip", (F.col("sec") - 1).alias("sec"), "part")
    seeds = instants.join(seeded, ["ip", "sec"]).withColumn("seed", F.lit(True))
    ordered = (
        own.unionByName(seeds).repartition("ip", "part").sortWithinPartitions("ip", "part", "us"))
    return ordered.select("ip", "part", "us", "c", "seed").mapInPandas(_walk(limit), _OUT)


def rate_limit(requests: DataFrame, limit: int) -> DataFrame:
    """Adds ``allowed``, ``remaining`` and ``reset_us`` to requests ``(ip, us, seq)``.

    ``remaining`` and ``reset_us`` are the tokens left and the time to the next free one right
    after the request. Requests of one instant are served in ``seq`` order.
    """
    turn = F.row_number().over(Window.partitionBy("ip", "us").orderBy("seq"))
    decided = requests.withColumn("turn", turn).join(
        decide_instants(requests, limit).withColumnRenamed("allowed", "taken"), ["ip", "us"])
    return decided.select(
        *requests.columns,
        (F.col("turn") <= F.col("taken")).alias("allowed"),
        (F.col("remaining") + F.col("taken") - F.least("turn", "taken")).alias("remaining"),
        "reset_us")


def tokens_at(requests: DataFrame, times: DataFrame, limit: int) -> DataFrame:
    """``ip, us, remaining, reset_us`` at the distinct given times ``(ip, us)``.

    ``remaining`` is the limit less what passed in the last second, both ends included, of the
    requests up to then; ``reset_us`` the time until the oldest of those leaves (0 without any).
    Every time becomes two marks among the instants, at its second's end and start, and each
    address's second is summed on its own.
    """
    passed = decide_instants(requests, limit).where("allowed > 0").select(
        "ip", "us", F.lit(1).alias("place"), F.col("allowed").alias("c"), F.lit(None).cast("long").alias("at"))
    asked = times.select("ip", "us").distinct()
    marks = [asked.select("ip", (F.col("us") - back).alias("us"), F.lit(place).alias("place"),
                          F.lit(0).cast("long").alias("c"), F.col("us").alias("at"))
             for back, place in ((0, 2), (_SECOND, 0))]
    events = passed.unionByName(marks[0]).unionByName(marks[1]).withColumn("sec", F.expr(f"us div {_SECOND}"))
    before = Window.partitionBy("ip", "sec").orderBy("us", "place")
    after = before.rowsBetween(1, Window.unboundedFollowing)
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    is_end = F.col("place") == 2
    first = F.when(F.col("c") > 0, F.col("us"))
    summed = events.select(
        "ip", "at", "place", *[F.when(is_end, f(c).over(before)).otherwise(f(c).over(after)).alias(name)
                               for name, f, c in (("n", F.sum, F.col("c")), ("oldest", F.min, first))],
    ).where("at is not null")
    return summed.groupBy("ip", F.col("at").alias("us")).agg(
        (limit - F.sum(F.coalesce("n", F.lit(0)))).alias("remaining"),
        F.greatest(F.coalesce(F.min("oldest") + _SECOND - F.first("at"), F.lit(0)), F.lit(0)).alias("reset_us"))
