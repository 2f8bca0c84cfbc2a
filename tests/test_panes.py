import random

import brute
import pytest
from pyspark.sql import functions as F

from netshield.operators.features import gap_features, gap_slices, grouped_features, merged_runs
from netshield.operators.panes import merged_features, over_ticks, pane_counts, pane_us, panes
from netshield.operators.ticks import scored_windows, tick_features, tick_rows
from netshield.options import Options
from test_detection import scored_naively
from test_features import random_rows

M = 60_000_000
T0 = 1_704_067_200_000_000


def edge_rows():
    """Requests on pane borders, one microsecond beside them, and at the ends of minutes."""
    rng, rows = random.Random(4), []
    for ip in "abc":
        for s in range(0, 150, 5):
            for us in rng.sample([-1, 0, 0, 1, 40_000, 99_999, 100_000, 100_001], 4):
                rows.append((len(rows), ip, T0 + max(0, s * 1_000_000 + us), f"GET /{len(rows) % 3} HTTP/1.1",
                             200 if len(rows) % 4 else 500, len(rows) % 7, 0.25))
    return rows


def test_width_divides_all():
    assert pane_us(Options()) == 5_000_000
    assert pane_us(Options(tick_seconds=4, window_seconds=30, block_seconds=90)) == 2_000_000


@pytest.mark.parametrize("opts", [Options(), Options(tick_seconds=15), Options(tick_seconds=7, lookback_seconds=9)])
def test_borders(spark, opts):
    rows = edge_rows()
    held = panes(brute.access_logs(spark, rows), opts)
    found = brute.by_key(tick_features(held, scored_windows(held.states, opts), opts), "ip", "tick")
    expected = scored_naively(rows, opts)
    assert set(found) == set(expected)
    for key in random.Random(3).sample(sorted(expected), min(40, len(expected))):
        brute.assert_same(found[key], brute.features(expected[key]), key)


def test_one_busy_pane(spark):
    """Thousands of requests of one address in one pane leave one state, and few rows behind a tick."""
    rows = [(i, "hot", T0 + 1 + i * 700, "GET / HTTP/1.1", 200, 5, 0.1) for i in range(6000)]
    held = panes(brute.access_logs(spark, rows))
    assert held.states.count() == 1 and held.values.count() == 3
    ticked = over_ticks(held.states)
    assert ticked.count() == 12 and pane_counts(brute.access_logs(spark, rows)).first()["n"] == 6000
    found = brute.by_key(merged_features(ticked, over_ticks(held.values), ["ip", "tick", "win"]), "ip", "tick")
    want = brute.features(rows)
    for key, row in found.items():
        brute.assert_same(row, want, key)


@pytest.mark.parametrize("cuts", [1, 3, 40])
def test_runs_merge_in_any_cut(spark, cuts):
    """Gap features don't depend on how the requests of a group are cut into runs."""
    rng = random.Random(cuts)
    rows = [(i, "a" if i % 3 else "b", T0 + rng.randrange(0, 8_000_000), "GET / HTTP/1.1", 200, 1, 0.1) for i in range(150)]
    logs = brute.access_logs(spark, rows).withColumn("us", F.unix_micros("ts"))
    part = F.expr(f"(us - {T0}) div {8_000_000 // cuts}")
    runs = merged_runs(gap_slices(logs.withColumn("part", part), ["ip", "part"]), ["ip", "part"], "slice", False)
    found = gap_features(merged_runs(runs, ["ip"], "part", True), ["ip"])
    for row in found.collect():
        want = brute.features([r for r in rows if r[1] == row["ip"]])
        brute.assert_same(row.asDict(), {k: want[k] for k in row.asDict() if k != "ip"}, row["ip"])


def test_equal_values_have_no_spread(spark):
    rows = [(i, "a", T0 + i * 1_300_000, "GET / HTTP/1.1", 200, 7, 0.1) for i in range(40)]
    held = panes(brute.access_logs(spark, rows))
    for row in tick_features(held, scored_windows(held.states)).collect():
        assert row["bytes_std"] == row["time_std"] == row["time_skew"] == row["time_kurt"] == 0.0


def test_missing_numbers(spark):
    """Against the features of the requests behind each evaluation."""
    rows = random_rows(12, 60, span=100_000_000)
    logs = brute.access_logs(spark, rows).withColumns({
        "bytes_sent": F.when(F.col("seq") % 4 != 0, F.col("bytes_sent")), "request_time": F.when(F.col("seq") % 5 != 0, F.col("request_time"))})
    held = panes(logs)
    groups = scored_windows(held.states)
    found = brute.by_key(tick_features(held, groups), "ip", "tick")
    expected = brute.by_key(grouped_features(tick_rows(logs).join(groups, ["ip", "tick", "win"], "left_semi"), ["ip", "tick", "win"]), "ip", "tick")
    assert found and set(found) == set(expected)
    for key, row in expected.items():
        brute.assert_same(found[key], {k: v for k, v in row.items() if k not in ("ip", "tick", "win", "timestamp")}, key)


def test_empty_log(spark):
    held = panes(brute.access_logs(spark, []))
    assert tick_features(held, scored_windows(held.states)).count() == 0
