from __future__ import annotations

from pyspark.sql import functions as F

from checks.common import ntz, plain_types, with_logs
from checks.ingest_queries import PARSED, messages
from checks.network_queries import (
    _ADDRESSES, _BEST, _PREFIXES, _RANGES, geo_dimension, prefix_load,
)
from netshield.operators import enrich as en
from netshield.operators import ratelimit, rollups
from netshield.operators import series as sr
from netshield.options import Options
from netshield.sources import synthetic, syslog
from netshield.sources.testdata import events, logs

NOW = "2024-01-01 00:05:30"
IP = "2607:6bc0:0:1::5"
LIMIT = 3
CAP_PANE_SECONDS = 30


def now():
    return F.lit(NOW).cast("timestamp")


def series(spark, sf_dir):
    return logs(spark, sf_dir).select("ip", "ts", F.concat_ws("|", "request", "seq").alias("payload"))


def repeated(spark, sf_dir):
    """Times cut to the second, so that equal records occur."""
    return logs(spark, sf_dir).select(
        "ip", F.date_trunc("second", "ts").alias("ts"), F.col("request").alias("payload"))


def _show(operation):
    return lambda spark, sf_dir: plain_types(operation(series(spark, sf_dir)))


def series_delete_ip(spark, sf_dir):
    data = series(spark, sf_dir)
    alerts = logs(spark, sf_dir).where(F.col("status") == 500).groupBy("ip").agg(
        F.min("ts").alias("alert_ts"))
    return sr.deleted_count(data, sr.delete_ips(data, alerts))


def series_delete_records(spark, sf_dir):
    data = series(spark, sf_dir)
    fetched = sr.last_seconds(data, 60, now())
    return plain_types(sr.delete_records(data, fetched))


def batch_push(spark, sf_dir):
    """Failed requests pushed again in one batch."""
    failed = logs(spark, sf_dir).where(F.col("status") >= 400).select(
        "ip", F.concat_ws("|", "request", "seq").alias("payload"))
    return plain_types(sr.batch_push(series(spark, sf_dir), failed, now()))


def series_flush(spark, sf_dir):
    """The series of some addresses flushed, beside the others."""
    data, some = series(spark, sf_dir), F.col("ip").like("203.%")
    return plain_types(sr.flush_all(data.where(some)).unionByName(data.where(~some)))


def limited(spark, sf_dir):
    requests = logs(spark, sf_dir).select("seq", "ip", F.unix_micros("ts").alias("us"))
    return ratelimit.rate_limit(requests, LIMIT)


def rate_limit(spark, sf_dir):
    return limited(spark, sf_dir).select("seq", "ip", "us", "allowed")


def rate_tokens(spark, sf_dir):
    return limited(spark, sf_dir).select("seq", "ip", "us", "remaining", "reset_us")


def tokens_at(spark, sf_dir):
    """Free requests some time after every fifth request."""
    requests = logs(spark, sf_dir).select("seq", "ip", F.unix_micros("ts").alias("us"))
    times = requests.where(F.col("seq") % 5 == 0).select("ip", (F.col("us") + F.col("seq") % 7 * 200_000).alias("us"))
    return ratelimit.tokens_at(requests, times, LIMIT)


def enriched(spark, sf_dir):
    return en.enrich(logs(spark, sf_dir), prefix_load(spark, sf_dir), geo_dimension(spark, sf_dir))


def traffic_rollup(spark, sf_dir):
    report = rollups.traffic(enriched(spark, sf_dir))
    return plain_types(report.withColumn("bytes", F.col("bytes").cast("bigint")))


def bots_report(spark, sf_dir):
    return plain_types(rollups.known_networks(enriched(spark, sf_dir)))


def search_report(spark, sf_dir):
    return plain_types(rollups.search_traffic(enriched(spark, sf_dir)))


def message_counters(spark, sf_dir):
    return rollups.message_counters(messages(spark, sf_dir))


def synthetic_logs(spark, sf_dir):
    """As many test requests as there are events, parsed back."""
    numbers = events(spark, sf_dir).select(F.col("event_id").alias("number"))
    raw = synthetic.traffic(numbers, F.lit("2024-12-01 06:34:00").cast("timestamp"))
    typed, _ = syslog.typed_logs(syslog.parsed_logs(syslog.parse_messages(raw)))
    return plain_types(typed)


_SERIES = ", series AS (SELECT ip, ts, request || '|' || seq AS payload FROM logs)"
_NOW = f"TIMESTAMP '{NOW}'"

_LIMITED = f""", numbered AS (
  SELECT seq, ip, us, row_number() OVER (PARTITION BY ip ORDER BY us, seq) AS rn FROM logs),
walk AS (
  WITH RECURSIVE step(seq, ip, us, rn, kept, allowed) AS (
    SELECT seq, ip, us, rn, [us], true FROM numbered WHERE rn = 1
    UNION ALL
    SELECT n.seq, n.ip, n.us, n.rn,
      CASE WHEN len(list_filter(s.kept, lambda k: n.us - k <= 1000000)) < {LIMIT}
        THEN list_append(list_filter(s.kept, lambda k: n.us - k <= 1000000), n.us)
        ELSE list_filter(s.kept, lambda k: n.us - k <= 1000000) END,
      len(list_filter(s.kept, lambda k: n.us - k <= 1000000)) < {LIMIT}
    FROM step s JOIN numbered n ON n.ip = s.ip AND n.rn = s.rn + 1)
  SELECT * FROM step)
"""

_ENRICHED = f""", {_ADDRESSES}, {_PREFIXES}, {_BEST}, {_RANGES},
enriched AS (
  SELECT logs.*, make_timestamp(minute * 60000000) AS win, coalesce(country, 'NA') AS country,
    coalesce(city, 'NA') AS city, net.n AS bot_name, net.c AS bot_category,
    coalesce(net.s, 0)::INTEGER AS bot_support
  FROM logs LEFT JOIN best USING (ip) LEFT JOIN located USING (ip))
"""

QUERIES = {
    "series_last_n": _show(lambda s: sr.last_n(s, 100)),
    "series_first_n": _show(lambda s: sr.first_n(s, 100)),
    "series_ip": _show(lambda s: sr.by_ip(s, IP)),
    "series_range": _show(lambda s: sr.by_ip(
        s, IP, F.lit("2024-01-01 00:01:00").cast("timestamp"), now())),
    "series_last_seconds": _show(lambda s: sr.last_seconds(s, 60, now())),
    "series_last_seconds_ip": _show(lambda s: sr.last_seconds(s, 60, now(), IP)),
    "series_cap": _show(lambda s: sr.cap_per_ip(s, 50, CAP_PANE_SECONDS)),
    "series_all": _show(sr.show_all),
    "series_dedup": lambda spark, sf_dir: plain_types(sr.dedup(repeated(spark, sf_dir))),
    "series_push": lambda spark, sf_dir: plain_types(
        sr.push(series(spark, sf_dir), repeated(spark, sf_dir))),
    "series_purge": _show(lambda s: sr.purge_old(s, now())),
    "series_delete_ip": series_delete_ip,
    "series_delete_records": series_delete_records,
    "series_flush": series_flush,
    "active_ips": lambda spark, sf_dir: sr.active_ips(sr.last_seconds(series(spark, sf_dir), 30, now())),
    "batch_push": batch_push,
    "rate_limit": rate_limit,
    "rate_tokens": rate_tokens,
    "tokens_at": tokens_at,
    "traffic_rollup": traffic_rollup,
    "bots_report": bots_report,
    "search_report": search_report,
    "message_counters": message_counters,
    "synthetic_logs": synthetic_logs,
}


def _series(body):
    return with_logs(f"{_SERIES} {body}")


ORACLES = {
    "series_last_n": _series("SELECT * FROM series ORDER BY ts DESC, payload DESC LIMIT 100"),
    "series_first_n": _series("SELECT * FROM series ORDER BY ts, payload LIMIT 100"),
    "series_ip": _series(f"SELECT * FROM series WHERE ip = '{IP}'"),
    "series_range": _series(
        f"SELECT * FROM series WHERE ip = '{IP}' AND ts BETWEEN TIMESTAMP '2024-01-01 00:01:00' AND {_NOW}"),
    "series_last_seconds": _series(
        f"SELECT * FROM series WHERE ts BETWEEN {_NOW} - INTERVAL 60 SECOND AND {_NOW}"),
    "series_last_seconds_ip": _series(
        f"SELECT * FROM series WHERE ip = '{IP}' AND ts BETWEEN {_NOW} - INTERVAL 60 SECOND AND {_NOW}"),
    "series_cap": _series("""SELECT * FROM series
QUALIFY row_number() OVER (PARTITION BY ip ORDER BY ts DESC, payload DESC) <= 50"""),
    "series_all": _series("SELECT * FROM series"),
    "series_dedup": with_logs("""
SELECT DISTINCT ip, date_trunc('second', ts) AS ts, request AS payload FROM logs"""),
    "series_push": _series("""
SELECT * FROM series UNION SELECT ip, date_trunc('second', ts), request FROM logs"""),
    "series_purge": _series(f"SELECT * FROM series WHERE ts > {_NOW} - INTERVAL 100 SECOND"),
    "series_delete_ip": with_logs("""
, alerts AS (SELECT ip, min(ts) AS alert_ts FROM logs WHERE status = 500 GROUP BY ip)
SELECT l.ip, count(*) FILTER (l.ts <= a.alert_ts) AS deleted
FROM logs l LEFT JOIN alerts a USING (ip) GROUP BY l.ip"""),
    "series_delete_records": _series(
        f"SELECT * FROM series WHERE NOT ts BETWEEN {_NOW} - INTERVAL 60 SECOND AND {_NOW}"),
    "series_flush": _series("SELECT * FROM series WHERE ip NOT LIKE '203.%'"),
    "active_ips": _series(
        f"SELECT DISTINCT ip FROM series WHERE ts BETWEEN {_NOW} - INTERVAL 30 SECOND AND {_NOW}"),
    "batch_push": with_logs(f"""
, series AS (SELECT ip, ts, request || '|' || seq AS payload FROM logs),
failed AS (SELECT ip, {_NOW} AS ts, request || '|' || seq AS payload FROM logs WHERE status >= 400)
SELECT * FROM series WHERE ip NOT IN (SELECT ip FROM failed) OR ts > {_NOW} - INTERVAL 100 SECOND
UNION SELECT * FROM failed"""),
    "rate_limit": with_logs(f"{_LIMITED} SELECT seq, ip, us, allowed FROM walk"),
    "rate_tokens": with_logs(f"""{_LIMITED}
SELECT seq, ip, us, ({LIMIT} - len(kept))::BIGINT AS remaining,
  greatest(0, kept[1] + 1000000 - us)::BIGINT AS reset_us FROM walk"""),
    "tokens_at": with_logs(f"""{_LIMITED},
asked AS (SELECT DISTINCT ip, us + seq % 7 * 200000 AS us FROM logs WHERE seq % 5 = 0)
SELECT a.ip, a.us, {LIMIT} - count(w.us) AS remaining, greatest(0, coalesce(min(w.us) + 1000000 - a.us, 0)) AS reset_us
FROM asked a LEFT JOIN walk w ON w.ip = a.ip AND w.allowed AND w.us BETWEEN a.us - 1000000 AND a.us
GROUP BY a.ip, a.us"""),
    "traffic_rollup": with_logs(f"""{_ENRICHED}
SELECT win, country, city, count(*) AS requests, count(*) FILTER (status >= 400) AS errors,
  sum(bytes_sent)::BIGINT AS bytes, grouping(win, country, city)::BIGINT AS level
FROM enriched GROUP BY ROLLUP (win, country, city)"""),
    "bots_report": with_logs(f"""{_ENRICHED}
SELECT win, bot_category, bot_name, bot_support, count(*) AS requests FROM enriched
WHERE bot_name IS NOT NULL GROUP BY ALL"""),
    "search_report": with_logs(f"""{_ENRICHED}
SELECT win, bot_name, string_split(request, ' ')[2] AS http_uri, count(*) AS requests,
  count(*) FILTER (status >= 400) AS errors FROM enriched
WHERE bot_category IN ('search', 'minor_search') GROUP BY ALL"""),
    "message_counters": with_logs(f"""{PARSED}
SELECT coalesce(reason, 'accepted') AS outcome, count(*) AS messages FROM reasoned GROUP BY 1"""),
}


def _draw(field, low, count):
    a = synthetic.DRAWS[field]
    return f"((event_id % {synthetic.PRIME}) * {a} + {a // 7}) % {synthetic.PRIME} % {count} + {low}"


def _choice(values, field):
    return f"([{', '.join(repr(v) for v in values)}])[{_draw(field, 1, len(values))}]"


ORACLES["synthetic_logs"] = f"""
SELECT '{synthetic.TEST_IP}' AS ip, TIMESTAMP '2024-12-01 06:34:00' + to_microseconds(event_id * 10000) AS ts,
  'example.com' AS domain,
  {_choice(synthetic.METHODS, "method")} || ' ' || {_choice(synthetic.PATHS, "path")} || '/' || event_id || ' HTTP/1.1' AS request,
  ({_draw("length", 200, 1000)})::BIGINT AS request_length, {_choice(synthetic.STATUSES, "status")}::INTEGER AS status,
  ({_draw("bytes", 500, 5000)})::BIGINT AS bytes_sent, ('0.' || ({_draw("time", 100, 999)}))::DOUBLE AS request_time,
  '{synthetic.AGENT}' AS user_agent
FROM events"""
