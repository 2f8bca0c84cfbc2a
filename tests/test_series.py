import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from netshield.operators import blocklist as bl
from netshield.operators import series as sr
from netshield.operators.ratelimit import rate_limit
from netshield.options import Options


def at(second):
    return F.timestamp_seconds(F.lit(second))


def table(spark, rows):
    return spark.createDataFrame(rows, "ip string, s long, payload string").select(
        "ip", F.timestamp_seconds("s").alias("ts"), "payload")


def shown(df):
    return [(r["ip"], int(r["ts"].timestamp()), r["payload"]) for r in df.collect()]


ROWS = [("a", 10, "x"), ("a", 10, "w"), ("b", 20, "y"), ("a", 30, "z"), ("a", 10, "x"), ("2001::1", 40, "q")]


def test_order_and_ranges(spark):
    series = sr.dedup(table(spark, ROWS))
    assert series.count() == 5
    assert shown(sr.first_n(series, 2)) == [("a", 10, "w"), ("a", 10, "x")]
    assert shown(sr.last_n(series, 2)) == [("a", 30, "z"), ("2001::1", 40, "q")]
    assert shown(sr.by_ip(series, "a", at(10), at(29))) == [("a", 10, "w"), ("a", 10, "x")]
    assert {r[1] for r in shown(sr.last_seconds(series, 10, at(40)))} == {30, 40}
    assert [r[0] for r in shown(sr.show_all(series))] == ["2001::1", "a", "a", "a", "b"]


def test_removal(spark):
    series = sr.dedup(table(spark, ROWS))
    purged = sr.purge_old(series, at(120), Options(series_max_age_seconds=100))
    assert {r[1] for r in shown(purged)} == {30, 40}
    alerts = spark.createDataFrame([("a",)], "ip string").withColumn("alert_ts", at(10))
    left = sr.delete_ips(series, alerts)
    assert len(shown(left)) == 3
    assert {r["ip"]: r["deleted"] for r in sr.deleted_count(series, left).collect()} == {
        "a": 2, "b": 0, "2001::1": 0}
    assert len(shown(sr.delete_records(series, table(spark, ROWS[:2])))) == 3
    with pytest.raises(Exception, match="record without ip"):
        sr.delete_records(series, table(spark, [(None, 1, "x")])).collect()
    assert sr.flush_all(series).count() == 0


def test_batch_push_stamps_and_cleans(spark):
    series = sr.dedup(table(spark, ROWS))
    pushed = sr.batch_push(series, spark.createDataFrame([("a", "n"), ("a", "n")], "ip string, payload string"),
                           at(115), Options(series_max_age_seconds=100))
    assert sorted(shown(pushed)) == [("2001::1", 40, "q"), ("a", 30, "z"), ("a", 115, "n"), ("b", 20, "y")]


@pytest.mark.parametrize("newest", [1, 7, 40, 1000])
def test_cap(spark, newest):
    rng = random.Random(newest)
    rows = list({(rng.choice("ab"), rng.randrange(300), f"p{rng.randrange(9)}") for _ in range(300)})
    got = sorted(shown(sr.cap_per_ip(table(spark, rows), newest, pane_seconds=50)))
    expected = []
    for ip in "ab":
        expected += sorted(r for r in rows if r[0] == ip)[-newest:]
    assert got == sorted(expected)


def test_blocklist_life(spark):
    opts = Options(block_seconds=60)
    empty = bl.with_expiry(spark.createDataFrame([], "ip string, added_at timestamp"), opts)
    entry = spark.createDataFrame([("a",)], "ip string")
    listed = bl.add(empty, entry.withColumn("added_at", at(100)), opts)
    listed = bl.add(listed, entry.withColumn("added_at", at(130)), opts)
    assert [int(r["expires_at"].timestamp()) for r in listed.collect()] == [190]
    assert bl.purge_old(listed, at(189)).count() == 1 and bl.purge_old(listed, at(190)).count() == 0
    rows = spark.createDataFrame([("a", s) for s in (129, 130, 189, 190)], "ip string, s long").select(
        "ip", F.timestamp_seconds("s").alias("ts"))
    assert [int(r["ts"].timestamp()) for r in bl.drop_blocked(rows, listed).orderBy("ts").collect()] == [129, 190]
    assert bl.remove(listed, entry).count() == 0 and bl.clear(listed).count() == 0


@pytest.mark.parametrize("limit, rate", [(1, 0.8), (3, 2), (3, 12), (10, 6), (40, 15)])
def test_rate_limit_walk(spark, limit, rate):
    rng = random.Random(limit * 100 + rate)
    rows, seq = [], 0
    for ip in ("a", "b"):
        us = 59_000_000
        while us < 200_000_000:
            us += int(rng.expovariate(rate) * 1e6) // 1000 * 1000
            for _ in range(rng.choice([1, 1, 1, 3])):
                rows.append((seq, ip, us))
                seq += 1
    df = spark.createDataFrame(rows, "seq long, ip string, us long")
    got = {r["seq"]: (r["allowed"], r["remaining"], r["reset_us"]) for r in rate_limit(df, limit).collect()}
    logs = {"a": deque(), "b": deque()}
    for seq, ip, us in sorted(rows, key=lambda r: (r[2], r[0])):
        log = logs[ip]
        while log and us - log[0] > 1_000_000:
            log.popleft()
        allowed = len(log) < limit
        if allowed:
            log.append(us)
        reset = max(0, log[0] + 1_000_000 - us) if log else 0
        assert got[seq] == (allowed, limit - len(log), reset), (seq, ip, us)
