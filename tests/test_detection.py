import random

import brute
import pytest
from pyspark.sql import functions as F

from netshield.constants import FEATURES
from netshield.operators import scoring
from netshield.operators.features import minute_features
from netshield.operators.panes import panes
from netshield.operators.ticks import scored_windows, tick_features
from netshield.options import Options
from netshield.plans import detection
from netshield.plans.replay import read_replay, replay_report

M = 60_000_000
SCORER = scoring.logistic_scorer({"request_rate": 4.0}, -6.0)


def traffic():
    """A quiet address, one that attacks from 100 s to 160 s, one that attacks twice."""
    rng = random.Random(11)
    rows = []
    for i in range(25):
        rows.append(("quiet", rng.randrange(30, 280)))
    for i in range(400):
        rows.append(("loud", 100 + i * 0.15))
    for start in (20, 200):
        rows += [("twice", start + i * 0.2) for i in range(250)]
    return [(i, ip, int(1_704_067_200_000_000 + s * 1e6), f"GET /{i % 5} HTTP/1.1", 200 if i % 3 else 404,
             i % 50, 0.1) for i, (ip, s) in enumerate(rows)]


def scored_naively(rows, opts):
    """Rows scored for each (ip, tick), straight from the evaluation rule."""
    step = opts.tick_seconds * 1_000_000
    out = {}
    for ip in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == ip]
        first, last = min(r[2] for r in own), max(r[2] for r in own)
        for tick in range(first // step * step, last + M + step, step):
            held = [r for r in own if tick - M <= r[2] <= tick]
            recent = [r for r in held if r[2] >= tick - opts.lookback_seconds * 1_000_000]
            if len(held) >= opts.min_records and recent:
                minute = max(r[2] // M for r in held)
                out[(ip, tick)] = [r for r in held if r[2] // M == minute]
    return out


def test_ticks_follow_the_rule(spark):
    rows, opts = traffic(), Options()
    held = panes(brute.access_logs(spark, rows), opts)
    table = tick_features(held, scored_windows(held.states, opts), opts)
    found = brute.by_key(table, "ip", "tick")
    expected = scored_naively(rows, opts)
    assert set(found) == set(expected)
    for key in random.Random(1).sample(sorted(expected), 25):
        brute.assert_same(found[key], brute.features(expected[key]), key)


def test_many_groups_take_the_join_path(spark):
    rows = traffic()
    held = panes(brute.access_logs(spark, rows))
    groups = scored_windows(held.states)
    some, few = (tick_features(held, groups, Options(broadcast_rows=n)) for n in (100_000, 1))
    assert some.count() == few.count() == groups.count()


def alert_times(rows, opts):
    """Alerts by replaying ticks: an alert empties its address's series until the block ends."""
    out, block = [], opts.block_seconds * 1_000_000
    for ip in {r[1] for r in rows}:
        held = [r for r in rows if r[1] == ip]
        resumed = 0
        while True:
            kept = [r for r in held if r[2] >= resumed]
            ticks = [tick for (_, tick), group in scored_naively(kept, opts).items() if len(group) >= 120]
            if not ticks:
                break
            out.append((ip, min(ticks)))
            resumed = min(ticks) + block
    return sorted(out)


@pytest.mark.parametrize("block", [1800, 60])
def test_alerts(spark, block):
    opts = Options(block_seconds=block)
    logs = brute.access_logs(spark, traffic())
    alerts = detection.detect(logs, SCORER, opts=opts).collect()
    assert sorted((a["ip"], brute.to_us(a["alert_ts"])) for a in alerts) == alert_times(traffic(), opts)
    naive = scored_naively(traffic(), opts)
    loud = next(a for a in alerts if a["ip"] == "loud")
    assert loud["req_count"] == len(naive[("loud", brute.to_us(loud["alert_ts"]))])
    assert loud["message"].startswith(f"ip: loud, req_count: {loud['req_count']}, rps: {loud['rps']}, ")
    assert 0 <= loud["problem"] <= 100 and loud["problem"] + loud["normal"] in (100, 101)
    assert loud["country"] == "NA" and loud["ptr"] is None
    assert list(loud["last_feature"].asDict()) == list(FEATURES)
    blocks = detection.new_blocks(detection.detect(logs, SCORER, opts=opts), opts)
    assert {r["ip"] for r in blocks.collect()} == {"loud", "twice"}


def test_tree_model_round_trip(spark, tmp_path):
    table = minute_features(brute.access_logs(spark, traffic())).withColumn(
        "label", (F.col("request_count") > 50).cast("double"))
    model = scoring.train_gbt(table, "label", iterations=3, depth=2)
    model.write().overwrite().save(str(tmp_path / "model"))
    scored = scoring.load_gbt(str(tmp_path / "model"))(table)
    rows = scored.select("p", "label").collect()
    assert rows and all((r["p"] > 0.5) == (r["label"] == 1.0) for r in rows)


def test_booster_needs_its_library(spark):
    with pytest.raises(RuntimeError, match="lightgbm"):
        scoring.booster_scorer(spark, "model.txt", "metadata.json")


def test_replay(spark, tmp_path):
    path = tmp_path / "replay.csv"
    lines = ["ip,timestamp,request,status,bytes_sent,request_time"]
    lines += [f"1.1.1.1,2024-01-01 00:00:{i // 4:02d}.{i % 4 * 25:02d}0,GET /{i} HTTP/1.1,200,{i},0.1"
              for i in range(200)]
    path.write_text("\n".join(lines) + "\n")
    logs = read_replay(spark, str(path))
    assert logs.count() == 200 and logs.agg(F.max("seq")).first()[0] == 200
    report = replay_report(logs, SCORER, Options(threshold=0.9)).orderBy("line").collect()
    assert [r["detections"] for r in report] == list(range(1, len(report) + 1))
    # p >= 0.9 once request_rate * 4 - 6 >= ln 9, from the 123rd request of the minute on.
    assert [r["line"] for r in report] == list(range(123, 201))
