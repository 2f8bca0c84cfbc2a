from __future__ import annotations

from pyspark.sql import functions as F

from checks.common import ntz, plain_types, with_logs
from checks.feature_queries import feature_ctes, shown, shown_sql
from checks.network_queries import geo_dimension, resolutions
from netshield.constants import FEATURES
from netshield.operators import blocklist as bl
from netshield.operators import scoring
from netshield.operators.features import minute_features
from netshield.operators.gelf import gelf_documents
from netshield.operators.panes import panes
from netshield.operators.preview import preview_rows, previews
from netshield.operators.rollups import detection_counts
from netshield.operators.running import running_features, trailing_buffer
from netshield.operators.ticks import scored_windows, tick_features, tick_rows
from netshield.options import Options
from netshield.plans import detection
from netshield.plans.ingestion import alert_messages
from netshield.plans.replay import read_replay
from netshield.plans.replay import replay_report as report
from netshield.session import work_dir
from netshield.sources.testdata import logs

# Fixed coefficients of the test model: busy, repetitive, failing clients score high.
WEIGHTS = {"request_rate": 1.5, "error_rate": 2.0, "path_entropy": -0.5, "burst_rate": 1.0}
BIAS = -2.0
OPTIONS = Options(min_rps=1.0)
SCORE_SQL = ("1 / (1 + exp(-(-2.0 + request_rate * 1.5 + error_rate * 2.0 + path_entropy * -0.5"
             " + burst_rate * 1.0)))")
PREVIEW_LIMIT = 4000


#: Digits of a mean time at ticks. At ten, means of 64 or 128 requests end in a five behind the last one
#: shown, and the order of summation decides; at twelve, the comparison is tighter and no such ties occur.
_MEAN_DIGITS = 12


def scorer():
    return scoring.logistic_scorer(WEIGHTS, BIAS)


def feat_running(spark, sf_dir):
    table = running_features(logs(spark, sf_dir))
    return table.select("ip", ntz("win"), "seq", ntz("timestamp"), *[shown(n) for n in FEATURES])


def buffer_sizes(spark, sf_dir):
    return trailing_buffer(logs(spark, sf_dir)).select("seq", "ip", "buffer_rows")


def sliding_ticks(spark, sf_dir):
    held = panes(logs(spark, sf_dir))
    table = tick_features(held, scored_windows(held.states))
    return table.select("ip", "tick", ntz("win"), ntz("timestamp"), *[
        F.round(n, _MEAN_DIGITS).alias(n) if n == "time_mean" else shown(n) for n in FEATURES])


def score_logistic(spark, sf_dir):
    table = minute_features(logs(spark, sf_dir))
    scored = scoring.decide(scorer()(table), OPTIONS)
    return scored.select("ip", ntz("win"), F.round("p", 6).alias("p"), "is_ddos",
                         F.round("normal_probability", 6).alias("normal"))


def split_results(spark, sf_dir):
    scored = scorer()(minute_features(logs(spark, sf_dir)))
    normal, problem = detection.split_results(scored, OPTIONS)
    tagged = [df.select("ip", ntz("win"), F.lit(kind).alias("result"))
              for df, kind in ((normal, "normal"), (problem, "problem"))]
    return tagged[0].unionByName(tagged[1])


def alerts(spark, sf_dir):
    return detection.detect(logs(spark, sf_dir), scorer(), resolutions(spark, sf_dir),
                            geo_dimension(spark, sf_dir), OPTIONS)


def detect_alerts(spark, sf_dir):
    return shown_alerts(alerts(spark, sf_dir))


def shown_alerts(found):
    shown_columns = ["ip", "req_count", "rps", "req_rate", "err_rate", "problem", "normal", "message",
                     "ptr", "domain", "priority", "tag", "ip_data_rows_total", "country", "city"]
    return found.select(
        ntz("alert_ts"), ntz("timestamp"), *shown_columns,
        F.round("last_feature.path_entropy", 6).alias("path_entropy"),
        F.col("ip2location.region").alias("region"))


ROUND_OPTIONS = Options(min_rps=1.0, block_seconds=60)


def detect_rounds(spark, sf_dir):
    """Alerts with a block of one minute, so that addresses are detected again and again."""
    found = detection.detect(logs(spark, sf_dir), scorer(), opts=ROUND_OPTIONS)
    return found.select(ntz("alert_ts"), "ip", "req_count", "rps", "err_rate", "ip_data_rows_total",
                        *[F.round(f"last_feature.{n}", 6).alias(n) for n in ("path_entropy", "bytes_std", "burst_rate", "interval_kurt")])


def gelf_alerts(spark, sf_dir):
    """Alerts as log-store documents."""
    return shown_documents(gelf_documents(alert_messages(alerts(spark, sf_dir), "alerts", "alerts"), F.lit(0.0)))


def shown_documents(documents):
    def part(key):
        return F.get_json_object("gelf", f"$['{key}']")

    return documents.select(
        part("host").alias("host"), part("short_message").alias("short_message"), part("tag").alias("tag"),
        part("timestamp").cast("double").alias("timestamp"), part("_ip").alias("ip"), part("_domain").alias("domain"),
        part("_req_count").cast("bigint").alias("req_count"), part("_country").alias("country"),
        part("_source_queue").alias("source_queue"))


def detections_report(spark, sf_dir):
    return plain_types(detection_counts(alerts(spark, sf_dir)))


def score_history(spark, sf_dir):
    return detection.score_history(logs(spark, sf_dir), scorer(), OPTIONS).select(
        "ip", ntz("win"), F.round("p", 6).alias("p"), "is_ddos")


def block_output(spark, sf_dir):
    found = detection.detect(logs(spark, sf_dir), scorer(), opts=OPTIONS)
    return plain_types(detection.new_blocks(found, OPTIONS))


def _tick_groups(spark, sf_dir):
    """Requests behind the evaluations at whole minutes."""
    rows = tick_rows(logs(spark, sf_dir), Options(tick_seconds=60))
    return rows


def alert_preview(spark, sf_dir):
    kept = preview_rows(_tick_groups(spark, sf_dir), ["ip", "tick"], max_bytes=PREVIEW_LIMIT)
    return kept.select("ip", "tick", "pos", "row_json", "rows_total", "stride")


def preview_texts(spark, sf_dir):
    table = previews(_tick_groups(spark, sf_dir), ["ip", "tick"], max_bytes=PREVIEW_LIMIT)
    return table.select("ip", "tick", "ip_data", "ip_data_rows_total", "ip_data_rows_preview")


SUPPRESS_OPTIONS = Options(block_seconds=60)


def alert_suppression(spark, sf_dir):
    """Server errors as detections, one minute of block each."""
    failed = logs(spark, sf_dir).where(F.col("status") >= 500)
    found = bl.first_detections(failed.select("ip", F.unix_micros("ts").alias("us")), SUPPRESS_OPTIONS)
    return found


def blocklist_ops(spark, sf_dir):
    """Add twice (refresh), remove, purge and membership, one row per address and step."""
    data = logs(spark, sf_dir)
    opts = Options(block_seconds=120)
    end = F.lit("2024-01-01 00:05:00").cast("timestamp")
    first = data.where(F.col("status") == 404).groupBy("ip").agg(F.min("ts").alias("added_at"))
    again = data.where(F.col("status") == 500).groupBy("ip").agg(F.max("ts").alias("added_at"))
    listed = bl.add(bl.with_expiry(first, opts), again, opts)
    removed = bl.remove(listed, data.where(F.col("ip").contains(":")).select("ip").distinct())
    active = bl.purge_old(removed, end)
    known = bl.contains(data.select("ip").distinct(), active).select(
        "ip", F.lit("contains").alias("step"), "is_blocked")
    counts = [df.select("ip", F.lit(step).alias("step"), F.lit(True).alias("is_blocked"))
              for df, step in ((listed, "listed"), (removed, "removed"), (active, "active"),
                               (bl.clear(active), "cleared"))]
    for df in counts:
        known = known.unionByName(df)
    return known


def score_gbt(spark, sf_dir):
    """A tree model fitted on the features, labelled by the address that attacks."""
    table = minute_features(logs(spark, sf_dir)).withColumn(
        "label", (F.col("ip") == "100.100.100.100").cast("double"))
    model = scoring.train_gbt(table, "label", iterations=5, depth=3)
    scored = scoring.decide(scoring.gbt_scorer(model)(table.drop("label")), OPTIONS)
    return scored.select("ip", ntz("win"), "p", "is_ddos")


def model_round_trip(spark, sf_dir):
    """Facts that hold for any fit: every row scored in range, the attacker's higher, also once loaded."""
    table = minute_features(logs(spark, sf_dir)).withColumn(
        "label", (F.col("ip") == "100.100.100.100").cast("double"))
    model = scoring.train_gbt(table, "label", iterations=5, depth=3)
    path = work_dir(spark, "model")
    model.save(path)
    both = scoring.load_gbt(path)(scoring.gbt_scorer(model)(table).withColumnRenamed("p", "fitted"))
    attack = F.col("label") == 1
    return both.agg(
        F.count(F.lit(1)).alias("scored"), F.min(F.col("p").between(0, 1)).alias("in_range"),
        (F.avg(F.when(attack, F.col("p"))) > F.avg(F.when(~attack, F.col("p")))).alias("separated"),
        F.min(F.col("p") == F.col("fitted")).alias("same_when_loaded"))


def replay_csv(spark, sf_dir):
    """The log written as CSV and read for a replay."""
    path = work_dir(spark, "replay")
    logs(spark, sf_dir).select("ip", F.col("ts").alias("timestamp"), "request", "status", "bytes_sent", "request_time").write.option(
        "header", True).option("timestampFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path)
    return plain_types(read_replay(spark, path))


def replay_report(spark, sf_dir):
    return plain_types(report(logs(spark, sf_dir), scorer(), OPTIONS))


TICKED = """, ticked AS (
  SELECT * REPLACE (ip || '@' || tick AS ip), ip AS addr, tick FROM (
    SELECT *, unnest(generate_series((us + 4999999) // 5000000 * 5000000,
      (us + 60000000) // 5000000 * 5000000, 5000000)) AS tick FROM logs)
),
groups AS (
  SELECT addr, tick, minute, count(*) AS n, max(us) AS last_us FROM ticked GROUP BY ALL
),
latest AS (
  SELECT addr, tick, max(minute) AS minute FROM groups GROUP BY addr, tick
  HAVING sum(n) >= 3 AND max(last_us) >= tick - 30000000
)
"""
_SPLIT = "string_split(ip, '@')[1] AS addr, string_split(ip, '@')[2]::BIGINT AS tick"
_ALL = ", ".join(map(shown_sql, FEATURES))
_TICK_ALL = ", ".join(f"round({n}, {_MEAN_DIGITS}) AS {n}" if n == "time_mean" else shown_sql(n) for n in FEATURES)

_RUNNING = """, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY ip, minute ORDER BY us, seq) AS pos FROM logs),
running AS (
  SELECT b.* REPLACE (a.ip || '@' || a.seq AS ip)
  FROM ranked a JOIN ranked b ON a.ip = b.ip AND a.minute = b.minute
    AND b.pos BETWEEN a.pos - 999 AND a.pos)
"""

_RESOLVED = """, answers AS (
  SELECT ip, ts AS resolved_at, max(CASE WHEN status < 300 THEN 'host-' || (seq % 50) END) AS ptr
  FROM logs WHERE request LIKE 'GET%' OR status = 301 GROUP BY ALL)
"""

_ALERTS = f"""
, scored AS (
  SELECT f.*, {_SPLIT}, {SCORE_SQL} AS p FROM feats f),
hits AS (
  SELECT s.* FROM scored s JOIN latest l ON s.addr = l.addr AND s.tick = l.tick
    AND s.win = make_timestamp(l.minute * 60000000)
  WHERE p >= 0.7 AND request_rate >= 1.0),
firsts AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY addr ORDER BY tick) = 1)
"""

QUERIES = {
    "feat_running": feat_running,
    "buffer_sizes": buffer_sizes,
    "sliding_ticks": sliding_ticks,
    "score_logistic": score_logistic,
    "split_results": split_results,
    "detect_alerts": detect_alerts,
    "detect_rounds": detect_rounds,
    "gelf_alerts": gelf_alerts,
    "detections_report": detections_report,
    "score_history": score_history,
    "block_output": block_output,
    "alert_preview": alert_preview,
    "preview_texts": preview_texts,
    "alert_suppression": alert_suppression,
    "blocklist_ops": blocklist_ops,
    "score_gbt": score_gbt,
    "replay_report": replay_report,
    "replay_csv": replay_csv,
    "model_round_trip": model_round_trip,
}

_PREVIEW = f""", spread AS (
  SELECT *, unnest(generate_series((us + 59999999) // 60000000 * 60000000,
    (us + 60000000) // 60000000 * 60000000, 60000000)) AS tick FROM logs),
shaped AS (
  SELECT ip, tick, us, seq, '{{"timestamp":' || us || ',"status":' || status || ',"bytes_sent":' || bytes_sent
    || ',"request_time":' || request_time::DECIMAL(18,6) || ',"request_length":' || request_length
    || ',"request_preview":"' || replace(request[:200], '/', '/') || '","ua_preview":"'
    || user_agent[:200] || '"}}' AS row_json FROM spread),
strided AS (
  SELECT *, row_number() OVER (PARTITION BY ip, tick ORDER BY us, seq) AS pos,
    count(*) OVER (PARTITION BY ip, tick) AS rows_total,
    (sum(strlen(row_json)) OVER (PARTITION BY ip, tick)
      + count(*) OVER (PARTITION BY ip, tick) + 1)::BIGINT AS size FROM shaped),
kept AS (
  SELECT ip, tick, pos, row_json, rows_total,
    CASE WHEN size <= {PREVIEW_LIMIT} THEN 1 ELSE greatest(2, size // {PREVIEW_LIMIT} + 1) END AS stride
  FROM strided)
"""

ORACLES = {
    "feat_running": with_logs(f"""{_RUNNING}{feature_ctes("running")}
SELECT string_split(ip, '@')[1] AS ip, win, string_split(ip, '@')[2]::BIGINT AS seq, timestamp, {_ALL}
FROM feats"""),
    "buffer_sizes": with_logs("""
SELECT a.seq, a.ip, least(1000, count(*)) AS buffer_rows
FROM logs a JOIN logs b ON a.ip = b.ip AND b.us >= a.us - 60000000
  AND (b.us < a.us OR (b.us = a.us AND b.seq <= a.seq)) GROUP BY a.seq, a.ip"""),
    "sliding_ticks": with_logs(f"""{TICKED}{feature_ctes("ticked")}
SELECT f.addr AS ip, f.tick, f.win, f.* EXCLUDE (ip, addr, tick, win)
FROM (SELECT ip, {_SPLIT}, win, timestamp, {_TICK_ALL} FROM feats) f
JOIN latest l ON f.addr = l.addr AND f.tick = l.tick AND f.win = make_timestamp(l.minute * 60000000)"""),
    "score_logistic": with_logs(f"""{feature_ctes()}
SELECT ip, win, round(p, 6) AS p, p >= 0.7 AS is_ddos, round(1 - p, 6) AS normal
FROM (SELECT ip, win, {SCORE_SQL} AS p FROM feats)"""),
    "score_history": with_logs(f"""{feature_ctes()}
SELECT ip, win, round(p, 6) AS p, p >= 0.7 AS is_ddos
FROM (SELECT ip, win, {SCORE_SQL} AS p FROM feats)
QUALIFY row_number() OVER (PARTITION BY ip ORDER BY win DESC) = 1"""),
    "split_results": with_logs(f"""{feature_ctes()}
SELECT ip, win, CASE WHEN {SCORE_SQL} >= 0.7 AND request_rate >= 1.0 THEN 'problem' ELSE 'normal' END
  AS result FROM feats"""),
    "block_output": with_logs(f"""{TICKED}{feature_ctes("ticked")}{_ALERTS}
SELECT addr AS ip, make_timestamp(tick) AS added_at,
  make_timestamp(tick) + INTERVAL 1800 SECOND AS expires_at FROM firsts"""),
    "alert_preview": with_logs(f"{_PREVIEW} SELECT * FROM kept WHERE (pos - 1) % stride = 0"),
    "preview_texts": with_logs(f"""{_PREVIEW}
SELECT ip, tick, '[' || string_agg(row_json, ',' ORDER BY pos) || ']' AS ip_data,
  max(rows_total) AS ip_data_rows_total, count(*) AS ip_data_rows_preview
FROM kept WHERE (pos - 1) % stride = 0 GROUP BY ip, tick"""),
    "alert_suppression": with_logs("""
, found AS (SELECT DISTINCT ip, us FROM logs WHERE status >= 500),
chain AS (
  WITH RECURSIVE step(ip, us) AS (
    SELECT ip, min(us) FROM found GROUP BY ip
    UNION ALL
    SELECT s.ip, min(f.us) FROM step s JOIN found f ON f.ip = s.ip AND f.us >= s.us + 60000000
    GROUP BY s.ip, s.us)
  SELECT * FROM step)
SELECT ip, us FROM chain"""),
    "blocklist_ops": with_logs("""
, added AS (
  SELECT ip, max(t) AS added_at FROM (
    SELECT ip, min(ts) AS t FROM logs WHERE status = 404 GROUP BY ip
    UNION ALL SELECT ip, max(ts) FROM logs WHERE status = 500 GROUP BY ip) GROUP BY ip),
removed AS (SELECT * FROM added WHERE NOT contains(ip, ':')),
active AS (SELECT * FROM removed WHERE added_at + INTERVAL 120 SECOND > TIMESTAMP '2024-01-01 00:05:00')
SELECT ip, 'contains' AS step, ip IN (SELECT ip FROM active) AS is_blocked FROM (SELECT DISTINCT ip FROM logs)
UNION ALL SELECT ip, 'listed', true FROM added UNION ALL SELECT ip, 'removed', true FROM removed
UNION ALL SELECT ip, 'active', true FROM active"""),
}


ORACLES["replay_report"] = with_logs(f"""{_RUNNING}{feature_ctes("running")},
hits AS (
  SELECT string_split(ip, '@')[2]::BIGINT AS line, {SCORE_SQL} AS p FROM feats)
SELECT line, l.ts, l.status, l.ip, round_even(p * 100, 0)::INTEGER AS ddos_percent,
  round_even((1 - p) * 100, 0)::INTEGER AS normal_percent,
  row_number() OVER (ORDER BY l.us, line) AS detections
FROM hits JOIN logs l ON l.seq = line WHERE p >= 0.7""")


def _detect_oracle():
    from checks.network_queries import _ADDRESSES, _RANGES

    return with_logs(f"""{TICKED}{feature_ctes("ticked")}{_ALERTS}{_RESOLVED}, {_ADDRESSES}, {_RANGES},
figures AS (
  SELECT addr AS ip, tick, make_timestamp(tick) AS alert_ts, timestamp, request_count AS req_count,
    round_even(requests_per_second, 2) AS rps, round_even(request_rate, 2) AS req_rate,
    round_even(error_rate, 2) AS err_rate, round_even(p * 100, 0)::INTEGER AS problem,
    round_even((1 - p) * 100, 0)::INTEGER AS normal, round(path_entropy, 6) AS path_entropy
  FROM firsts),
first_rows AS (
  SELECT addr, tick, arg_min(domain, (us, seq)) AS domain, count(*) AS ip_data_rows_total
  FROM ticked GROUP BY addr, tick)
SELECT f.alert_ts, f.timestamp, f.ip, req_count, rps, req_rate, err_rate, problem, normal,
  concat('ip: ', f.ip, ', req_count: ', req_count, ', rps: ', rps, ', req_rate: ', req_rate,
    ', err_rate: ', err_rate, ', problem: ', problem, ', normal: ', normal, ', speed: 0.0') AS message,
  CASE WHEN a.resolved_at > f.alert_ts - INTERVAL 300 SECOND THEN a.ptr END AS ptr,
  r.domain, 1::INTEGER AS priority, 'alert' AS tag, ip_data_rows_total,
  coalesce(country, 'NA') AS country, coalesce(city, 'NA') AS city, path_entropy, region
FROM figures f JOIN first_rows r ON r.addr = f.ip AND r.tick = f.tick
ASOF LEFT JOIN answers a ON a.ip = f.ip AND f.alert_ts >= a.resolved_at
LEFT JOIN located l ON l.ip = f.ip""")


ORACLES["detect_alerts"] = _detect_oracle()
# Every evaluation for every instant at which its series may have resumed; a chain picks those that occur.
ORACLES["detect_rounds"] = with_logs(f""", ticked AS (
  SELECT * REPLACE (ip || '@' || tick || '@' || cut AS ip), ip AS addr FROM (
    SELECT *, unnest(generate_series(tick - 60000000, tick, 5000000)) AS cut FROM (
      SELECT *, unnest(generate_series((us + 4999999) // 5000000 * 5000000,
        (us + 60000000) // 5000000 * 5000000, 5000000)) AS tick FROM logs)) WHERE us >= cut
),
groups AS (
  SELECT addr, tick, cut, minute, count(*) AS n, max(us) AS last_us FROM ticked GROUP BY ALL
),
latest AS (
  SELECT addr, tick, cut, max(minute) AS minute, sum(n) AS total FROM groups GROUP BY addr, tick, cut
  HAVING sum(n) >= 3 AND max(last_us) >= tick - 30000000
)
{feature_ctes("ticked")}, scored AS (
  SELECT f.*, string_split(ip, '@')[1] AS addr, string_split(ip, '@')[2]::BIGINT AS tick,
    string_split(ip, '@')[3]::BIGINT AS cut, {SCORE_SQL} AS p FROM feats f),
hits AS (
  SELECT s.* EXCLUDE (ip), l.total FROM scored s JOIN latest l ON s.addr = l.addr AND s.tick = l.tick AND s.cut = l.cut
    AND s.win = make_timestamp(l.minute * 60000000)
  WHERE p >= 0.7 AND request_rate >= 1.0),
chain AS (
  WITH RECURSIVE step(addr, tick, cut) AS (
    SELECT addr, min(tick), min(tick) - 60000000 FROM hits WHERE cut = tick - 60000000 GROUP BY addr
    UNION ALL
    SELECT s.addr, min(h.tick), greatest(s.tick + 60000000, min(h.tick) - 60000000)
    FROM step s JOIN hits h ON h.addr = s.addr AND h.tick >= s.tick + 60000000
      AND h.cut = greatest(s.tick + 60000000, h.tick - 60000000)
    GROUP BY s.addr, s.tick)
  SELECT * FROM step)
SELECT make_timestamp(h.tick) AS alert_ts, h.addr AS ip, request_count AS req_count, round_even(requests_per_second, 2) AS rps,
  round_even(error_rate, 2) AS err_rate, total::BIGINT AS ip_data_rows_total, round(path_entropy, 6) AS path_entropy,
  round(bytes_std, 6) AS bytes_std, round(burst_rate, 6) AS burst_rate, round(interval_kurt, 6) AS interval_kurt
FROM chain c JOIN hits h ON h.addr = c.addr AND h.tick = c.tick AND h.cut = c.cut""")
ORACLES["gelf_alerts"] = f"""
SELECT 'unknown' AS host, message AS short_message, tag, epoch(timestamp)::DOUBLE AS timestamp, ip, domain,
  req_count::BIGINT AS req_count, country, 'alerts' AS source_queue FROM ({ORACLES["detect_alerts"]}) found"""
ORACLES["detections_report"] = f"""
SELECT date_trunc('minute', alert_ts) AS win, country, count(*) AS alerts, max(problem) AS highest
FROM ({ORACLES["detect_alerts"]}) found GROUP BY 1, 2"""
ORACLES["replay_csv"] = with_logs("""
SELECT ip, ts, request, status, bytes_sent, request_time,
  row_number() OVER (ORDER BY us, ip, request) AS seq FROM logs""")
ORACLES["model_round_trip"] = with_logs("""
SELECT count(*) AS scored, true AS in_range, true AS separated, true AS same_when_loaded
FROM (SELECT DISTINCT ip, minute FROM logs)""")
