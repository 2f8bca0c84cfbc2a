import random

import brute
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from netshield.constants import FEATURES
from netshield.operators.features import minute_features
from netshield.operators.running import running_features, trailing_buffer
from netshield.options import Options

M = 60_000_000


def edge_rows():
    r = [
        (1, "one", 5 * M, "GET /a HTTP/1.1", 200, 10, 0.1),
        (2, "two", 5 * M, "GET /a HTTP/1.1", 200, 10, 0.1),
        (3, "two", 5 * M + 100_000, "POST /b HTTP/2.0", 404, 30, 0.3),
        (4, "same", 5 * M, "GET /a HTTP/1.1", 200, 10, 0.1),
        (5, "same", 5 * M, "GET /a HTTP/1.1", 200, 10, 0.1),
        (6, "same", 5 * M, "GET /a HTTP/1.1", 200, 10, 0.1),
        (7, "odd", 5 * M, "nonsense", 600, 1, 0.0),
        (8, "odd", 5 * M + 100_001, "GET /x", 500, 5, 0.2),
        (9, "odd", 5 * M + 300_000, "HEAD  /x   HTTP/3", 599, 7, 0.5),
        (10, "odd", 5 * M + 300_000, "", 200, 7, 0.5),
        (11, "edge", 6 * M - 1, "GET /a HTTP/1.1", 200, 1, 0.1),
        (12, "edge", 6 * M, "GET /b HTTP/1.1", 200, 2, 0.2),
        (13, "2001:db8::1", 6 * M, "GET /b HTTP/1.1", 200, 2, 0.2),
        (14, "ties", 5 * M, "GET /1 HTTP/1.1", 200, 2, 0.2),
        (15, "ties", 5 * M + 900_000, "GET /2 HTTP/1.1", 200, 4, 0.2),
        (16, "ties", 5 * M + 900_000, "GET /3 HTTP/1.1", 200, 8, 0.2),
        (17, "ties", 5 * M + 950_000, "GET /3 HTTP/1.1", 200, 9, 0.2),
        (18, "ties", 5 * M + 2_900_000, "GET /3 HTTP/1.1", 200, 9, 0.2),
    ]
    return r


def random_rows(seed, count, span=40_000_000, ips=3):
    rng = random.Random(seed)
    out = []
    for seq in range(count):
        request = rng.choice(["GET /%d HTTP/1.1", "POST /%d HTTP/2.0", "HEAD /%d", "bad%d"]) % rng.randint(0, 4)
        us = 7 * M + rng.randrange(0, span // 50_000) * 50_000
        out.append((seq, f"ip{rng.randrange(ips)}", us, request, rng.choice([200, 301, 404, 503]),
                    rng.choice([0, 10, 500, 10**9]), rng.random()))
    return out


def check_minutes(spark, rows):
    table = minute_features(brute.access_logs(spark, rows))
    found = brute.by_key(table.withColumn("minute", F.expr(f"unix_micros(win) div {M}")), "ip", "minute")
    expected = brute.minutes(rows)
    assert set(found) == set(expected)
    for key, group in expected.items():
        brute.assert_same(found[key], brute.features(group), key)
        assert brute.to_us(found[key]["timestamp"]) == max(r[2] for r in group)


def test_edge_groups(spark):
    check_minutes(spark, edge_rows())


def test_columns_in_model_order(spark):
    table = minute_features(brute.access_logs(spark, edge_rows()))
    assert table.columns == ["ip", "win", "timestamp", *FEATURES]
    assert len(FEATURES) == 36


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10_000))
def test_random_groups(spark, seed):
    check_minutes(spark, random_rows(seed, 120))


@pytest.mark.parametrize("depth, chunk", [(5, 7), (4, 1000), (8, 8)])
def test_running_equals_recomputation(spark, depth, chunk):
    rows = edge_rows() + [(100 + r[0], *r[1:]) for r in random_rows(depth, 90)]
    table = running_features(brute.access_logs(spark, rows), Options(buffer_rows=depth), chunk)
    found = brute.by_key(table, "seq")
    assert len(found) == len(rows)
    for group in brute.minutes(rows).values():
        ordered = sorted(group, key=lambda r: (r[2], r[0]))
        for i, row in enumerate(ordered):
            frame = ordered[max(0, i + 1 - depth):i + 1]
            brute.assert_same(found[(row[0],)], brute.features(frame), row)


def test_running_over_the_default_buffer(spark):
    rows = [(i, "hot", 7 * M + i * 20_000, f"GET /{i % 30} HTTP/1.1", 200, i % 7, 0.5) for i in range(1400)]
    table = running_features(brute.access_logs(spark, rows)).where("seq in (998, 999, 1000, 1399)")
    for (seq,), row in brute.by_key(table, "seq").items():
        brute.assert_same(row, brute.features(rows[max(0, seq - 999):seq + 1]), seq)


def test_trailing_buffer(spark):
    rows = random_rows(3, 80, span=200_000_000, ips=2)
    found = brute.by_key(trailing_buffer(brute.access_logs(spark, rows), Options(buffer_rows=9)), "seq")
    for row in rows:
        held = [r for r in rows if r[1] == row[1] and row[2] - M <= r[2] and (r[2], r[0]) <= (row[2], row[0])]
        assert found[(row[0],)]["buffer_rows"] == min(9, len(held))


def test_trailing_buffer_has_no_frame_over_a_window(spark):
    """A frame over a window's instants would sum all of them again for every row."""
    table = trailing_buffer(brute.access_logs(spark, random_rows(4, 3)))
    assert "RangeFrame" not in table._jdf.queryExecution().toString()


def test_trailing_buffer_of_many_instants(spark):
    """Instants less than a slice apart, some repeated, and rows without address or time."""
    rng = random.Random(8)
    second = 1_000_000
    rows = [(k, "a", rng.choice((0, 59, 60, 61)) * second + rng.randrange(0, 2 * second, 10_000), "GET /", 200, 1, 1.0) for k in range(900)]
    rows += [(-k, None, k * second, "GET /", 200, 1, 1.0) for k in (1, 2)] + [(2000, "a", None, "GET /", 200, 1, 1.0)]
    found = trailing_buffer(brute.access_logs(spark, rows), Options(buffer_rows=700)).collect()
    expected = {r[0]: min(700, sum(q[2] >= r[2] - M and (q[2], q[0]) <= (r[2], r[0]) for q in rows[:900])) for r in rows[:900]}
    assert {r["seq"]: r["buffer_rows"] for r in found} == expected


def test_running_tasks_are_dealt_by_rows(spark):
    table = running_features(brute.access_logs(spark, random_rows(6, 90)), Options(buffer_rows=5), 10, task_rows=9)
    plan = table._jdf.queryExecution().toString()
    assert ", 10), REPARTITION_BY_NUM" in plan
