from __future__ import annotations

from pyspark.sql import functions as F

from checks.common import over_logs, plain_types, with_logs
from checks.network_queries import STATIC_SQL
from netshield.functions.request import is_static, match_request, split_request
from netshield.functions.timestamps import normalize_epoch
from netshield.operators.gelf import as_json, flatten, gelf_documents
from netshield.session import compute_once
from netshield.sources import queue as mq
from netshield.sources import syslog
from netshield.sources.testdata import logs

NOW = 1704153600.0

# One syslog line per log row, some damaged; the same SQL runs in both engines.
RAW = r"""
SELECT seq, '10.9.8.7' AS client_address, ts AS recv_ts,
  CASE seq % 101
    WHEN 0 THEN concat('no header here ', seq)
    WHEN 1 THEN concat(head, 'plain text')
    WHEN 2 THEN concat(head, '{"remote_addr": "', ip, '", oops}')
    WHEN 3 THEN concat(head, '{"request": "', request, '"}')
    WHEN 4 THEN concat(head, '{"remote_addr": "', ip, '", "request": null}')
    WHEN 5 THEN concat(head, '{"remote_addr": "', ip, '", "request": "GET /", "request_length": "x"}')
    WHEN 6 THEN repeat('x', 70000)
    WHEN 7 THEN concat(head, json, ' trailing')
    WHEN 8 THEN concat(head, json, ' }')
    WHEN 9 THEN concat(head, left(json, length(json) - 1), ', "country": "XX", "is_static": "yes", "client_address": "9.9.9.9"}')
    WHEN 10 THEN concat(head, '{"request": "GET /first HTTP/1.1", "remote_addr": "9.9.9.9", ', substr(json, 2))
    ELSE concat('  ', head, json, ' ') END AS line
FROM (
  SELECT *,
    concat('<', 13 + seq % 3, '>Dec  1 06:34:', 10 + seq % 50, ' ', domain, ' app: ') AS head,
    concat('{"domain": "', domain, '", "timestamp": "1.5", "remote_addr": "', ip, '", "request": "',
      request, '", "response_status": ', status, ', "body_bytes_sent": "', bytes_sent,
      '", "request_time": "', CAST(CAST(request_time AS DECIMAL(12,6)) AS VARCHAR(20)),
      '", "request_length": "', request_length, '", "http_user_agent": "', user_agent,
      '", "upstream_addr": "", "edge": {"pop": ', seq % 5, '}, "hostname": "',
      CASE WHEN seq % 2 = 0 THEN 'web-1' ELSE 'web-2' END, '"}') AS json
  FROM {logs}) AS shaped
"""


def raw(spark, sf_dir):
    lines = over_logs(spark, RAW, logs(spark, sf_dir))
    return lines.withColumn("data", F.col("line").cast("binary")).drop("line")


def messages(spark, sf_dir):
    return syslog.parse_messages(raw(spark, sf_dir))


def parse_syslog(spark, sf_dir):
    typed, _ = syslog.typed_logs(syslog.parsed_logs(messages(spark, sf_dir)))
    return plain_types(typed)


def parse_rejects(spark, sf_dir):
    _, rejected = syslog.typed_logs(syslog.parsed_logs(messages(spark, sf_dir)))
    return plain_types(rejected.select("ip", "ts", "request"))


def parse_quarantine(spark, sf_dir):
    bad = syslog.quarantine(messages(spark, sf_dir))
    return plain_types(bad.select("recv_ts", "reason", F.octet_length("data").alias("size")))


def log_record(spark, sf_dir):
    records = syslog.log_records(syslog.parsed_logs(messages(spark, sf_dir)), "access")
    return plain_types(records.select(
        "ts", "ip", "hostname", "message", "priority", "tag", "client_address", "domain",
        F.to_json("extras").alias("extras")))


def requests(spark, sf_dir):
    """Request lines of the log and of every page, the latter in several malformed shapes."""
    url, shape = F.col("url"), F.col("page_id") % 5
    line = (
        F.when(shape == 0, F.concat(F.lit("GET "), url, F.lit(" HTTP/1.1")))
        .when(shape == 1, F.concat(F.lit("GET "), url))
        .when(shape == 2, F.concat(F.lit("POST  "), url, F.lit(" HTTP/2.0")))
        .when(shape == 3, url)
        .otherwise("")
    )
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(
        (-F.col("page_id") - 1).alias("seq"), line.alias("request"))
    return logs(spark, sf_dir).select("seq", "request").unionByName(pages)


REQUESTS = """, requests AS (
  SELECT seq, request FROM logs UNION ALL
  SELECT -page_id - 1, CASE page_id % 5 WHEN 0 THEN 'GET ' || url || ' HTTP/1.1'
    WHEN 1 THEN 'GET ' || url WHEN 2 THEN 'POST  ' || url || ' HTTP/2.0'
    WHEN 3 THEN url ELSE '' END FROM pages)
"""


def static_flag(spark, sf_dir):
    return requests(spark, sf_dir).select("seq", is_static(F.col("request")).alias("is_static"))


def request_parts(spark, sf_dir):
    parts = split_request(F.col("request"))
    return requests(spark, sf_dir).select("seq", *[c.alias(n) for n, c in parts.items()])


def request_regex_parts(spark, sf_dir):
    parts = match_request(F.col("request"))
    return requests(spark, sf_dir).select("seq", *[c.alias(n) for n, c in parts.items()])


# Message bodies of every kind; the same SQL runs in both engines.
BODIES = r"""
SELECT seq, CASE WHEN seq % 2 = 0 THEN 'logs' ELSE 'alerts' END AS queue,
  CASE seq % 8
    WHEN 0 THEN concat('{"hostname": "', domain, '", "message": "', request, '", "status": ', status,
      ', "_hidden": 1, "tag": "t", "timestamp": "', stamp, '"}')
    WHEN 1 THEN concat('"', replace(concat('{"message": "m', seq, '", "timestamp": ', us / 1000000 {div}, '}'),
      '"', concat(chr(92), '"')), '"')
    WHEN 2 THEN concat('"text ', seq, '"')
    WHEN 3 THEN concat(seq, '.5')
    WHEN 4 THEN concat('[', seq, ', "a"]')
    WHEN 7 THEN concat('{"tag": "first", "status": 1, "tag": "t", "status": ', status, ', "timestamp": ',
      CASE WHEN seq % 2 = 0 THEN '1e300' ELSE '"nan"' END, ', "source_queue": "own"}')
    WHEN 5 THEN concat('{"status": ', status, ', "timestamp": {"$date": "', stamp, 'Z"}}')
    ELSE concat('{"broken": ', seq) END AS body
FROM (SELECT *, concat('2024-12-01T06:', 10 + seq % 50, ':00') AS stamp FROM {logs}) AS shaped
"""


def bodies(spark, sf_dir):
    data = logs(spark, sf_dir).withColumn("us", F.unix_micros("ts"))
    shaped = over_logs(spark, BODIES.replace("us / 1000000 {div}", "us div 1000000"), data)
    return mq.union_queues([
        (shaped.where(F.col("queue") == name), name, f"{name}-exchange") for name in ("logs", "alerts")])


def queue_normalise(spark, sf_dir):
    docs, _ = mq.normalize_messages(bodies(spark, sf_dir))
    text = [F.try_variant_get(F.col("doc")[k], "$", "string").alias(k) for k in ("hostname", "message")]
    status = F.coalesce(F.try_variant_get(F.col("doc")["status"], "$", "bigint"), F.lit(0))
    return docs.select("queue", "exchange", *text, status.alias("status"),
                       F.cardinality("doc").cast("bigint").alias("keys"))


def queue_rejects(spark, sf_dir):
    _, bad = mq.normalize_messages(bodies(spark, sf_dir))
    return bad


def gelf_docs(spark, sf_dir):
    docs, _ = mq.normalize_messages(bodies(spark, sf_dir))
    gelf = compute_once(gelf_documents(docs, F.lit(NOW)), parts=F.from_json("gelf", "map<string,string>"))

    def part(key):
        return F.col("parts")[key]

    return gelf.select(
        *[part(k).alias(k.strip("_")) for k in ("version", "host", "short_message", "facility", "tag",
                                                "_source_queue", "_source_exchange", "_status")],
        part("timestamp").cast("double").alias("timestamp"),
        part("_hidden").alias("hidden"),
        F.size("parts").cast("bigint").alias("keys"))


STAMPS = r"""
SELECT seq, CASE seq % 10
    WHEN 0 THEN CAST(NULL AS VARCHAR(80))
    WHEN 1 THEN concat(us / 1000000 {div}, '.25')
    WHEN 2 THEN concat('  ', us / 1000000 {div}, ' ')
    WHEN 3 THEN concat('2024-12-01T06:', 10 + seq % 50, ':00')
    WHEN 4 THEN concat('2024-12-01T06:', 10 + seq % 50, ':00+04:00')
    WHEN 5 THEN concat('{"$date": "2024-12-01T06:', 10 + seq % 50, ':30Z"}')
    WHEN 6 THEN concat('{"$date": ', us / 1000000 {div}, '}')
    WHEN 7 THEN 'nan'
    WHEN 8 THEN '-Infinity'
    ELSE 'junk' END AS value
FROM {logs}
"""


def ts_normalise(spark, sf_dir):
    data = logs(spark, sf_dir).withColumn("us", F.unix_micros("ts"))
    stamps = over_logs(spark, STAMPS.replace("us / 1000000 {div}", "us div 1000000"), data)
    return stamps.select("seq", normalize_epoch(F.col("value"), F.lit(NOW), 3).alias("epoch"))


def json_rows(spark, sf_dir):
    """Nested rows flattened one level and written as JSON text."""
    nested = logs(spark, sf_dir).select(
        "seq", "ip", F.struct("status", "bytes_sent", "ts").alias("response"),
        F.struct("domain", "user_agent").alias("client"), F.lit(None).cast("int").alias("nothing"))
    return as_json(flatten(nested))


_RAW_DUCK = RAW.replace("{logs}", "logs")
# The header and request patterns.
_HEADER = r"^<(\d+)>(\w+\s+\d+\s+\d+:\d+:\d+)\s+(\S+)\s+(.*)"
PARSED = rf""", raw AS ({_RAW_DUCK}),
sized AS (
  SELECT *, trim(line) AS t, length(line) > 65535 AS big FROM raw),
head AS (
  SELECT *, regexp_matches(t, '{_HEADER}') AS matched,
    regexp_extract(t, '{_HEADER}', 1) AS priority, regexp_extract(t, '{_HEADER}', 3) AS host,
    regexp_extract(t, '{_HEADER}', 4) AS message FROM sized),
js AS (
  SELECT *, nullif(regexp_extract(message, '\{{.*\}}', 0), '') AS j FROM head),
msg AS (
  SELECT *, CASE WHEN json_valid(j) THEN
    replace(j, '"request": "GET /first HTTP/1.1", "remote_addr": "9.9.9.9", ', '')::JSON END AS p FROM js),
reasoned AS (
  SELECT *, CASE WHEN big THEN 'oversize' WHEN NOT matched THEN 'no header'
    WHEN j IS NULL THEN 'no json' WHEN p IS NULL THEN 'bad json'
    WHEN (p->>'remote_addr') IS NULL THEN 'no remote_addr'
    WHEN (p->>'request') IS NULL THEN 'no request' END AS reason FROM msg),
typed AS (
  SELECT p->>'remote_addr' AS ip, recv_ts AS ts, p->>'domain' AS domain, p->>'request' AS request,
    TRY_CAST(p->>'request_length' AS BIGINT) AS request_length,
    TRY_CAST(p->>'response_status' AS INTEGER) AS status,
    TRY_CAST(p->>'body_bytes_sent' AS BIGINT) AS bytes_sent,
    TRY_CAST(p->>'request_time' AS DOUBLE) AS request_time, p->>'http_user_agent' AS user_agent
  FROM reasoned WHERE reason IS NULL)
"""
_COMPLETE = ("request_length IS NOT NULL AND status IS NOT NULL AND bytes_sent IS NOT NULL "
             "AND request_time IS NOT NULL")

_BODIES = f""", bodies AS ({BODIES.replace("us / 1000000 {div}", "us // 1000000").replace("{logs}", "logs")}),
outer_docs AS (
  SELECT *, queue || '-exchange' AS exchange, CASE WHEN json_valid(body) THEN
    replace(replace(body, '"tag": "first", "status": 1, ', ''), '1e300', '"1e300"')::JSON END AS j
  FROM bodies),
docs AS (
  SELECT *, CASE WHEN json_type(j) = 'OBJECT' THEN j
      WHEN json_type(j) = 'VARCHAR' AND json_valid(j->>'$') AND json_type((j->>'$')::JSON) = 'OBJECT'
        THEN (j->>'$')::JSON
      ELSE json_object('message', j) END AS d
  FROM outer_docs WHERE j IS NOT NULL)
"""

QUERIES = {
    "parse_syslog": parse_syslog,
    "parse_rejects": parse_rejects,
    "parse_quarantine": parse_quarantine,
    "log_record": log_record,
    "static_flag": static_flag,
    "request_parts": request_parts,
    "request_regex_parts": request_regex_parts,
    "queue_normalise": queue_normalise,
    "queue_rejects": queue_rejects,
    "gelf_docs": gelf_docs,
    "ts_normalise": ts_normalise,
    "json_rows": json_rows,
}

ORACLES = {
    "parse_syslog": with_logs(f"{PARSED} SELECT * FROM typed WHERE {_COMPLETE}"),
    "parse_rejects": with_logs(f"{PARSED} SELECT ip, ts, request FROM typed WHERE NOT ({_COMPLETE})"),
    "parse_quarantine": with_logs(f"""{PARSED}
SELECT recv_ts, reason, length(line)::INTEGER AS size FROM reasoned WHERE reason IS NOT NULL"""),
    "log_record": with_logs(f"""{PARSED}
SELECT recv_ts AS ts, p->>'remote_addr' AS ip,
  coalesce(p->>'hostname', host) AS hostname, message, priority, 'access' AS tag, client_address,
  p->>'domain' AS domain,
  CASE WHEN (p->'edge') IS NULL THEN '{{}}' ELSE '{{"edge":' || to_json(replace((p->'edge')::VARCHAR, ' ', ''))
    || CASE WHEN seq % 101 = 9 THEN ',"country":"XX","is_static":"yes"' ELSE '' END || '}}' END AS extras
FROM reasoned WHERE reason IS NULL"""),
    "static_flag": with_logs(f"{REQUESTS} SELECT seq, {STATIC_SQL.format(r='request')} AS is_static FROM requests"),
    "request_parts": with_logs(f"""{REQUESTS}
SELECT seq, string_split(nullif(request, ''), ' ')[1] AS http_method,
  string_split(nullif(request, ''), ' ')[2] AS http_uri,
  string_split(nullif(request, ''), ' ')[3] AS http_protocol FROM requests"""),
    "request_regex_parts": with_logs(REQUESTS + "SELECT seq, " + ", ".join(
        rf"nullif(regexp_extract(request, '(\S+)\s+(\S+)(?:\s+(\S+))?', {i}), '') AS {n}"
        for i, n in ((1, "method"), (2, "path"), (3, "version"))) + " FROM requests"),
    "queue_normalise": with_logs(f"""{_BODIES}
SELECT queue, exchange, d->>'hostname' AS hostname,
  CASE WHEN json_type(d->'message') = 'ARRAY' THEN replace((d->'message')::VARCHAR, ' ', '')
    ELSE d->>'message' END AS message,
  coalesce((d->>'status')::BIGINT, 0) AS status, len(json_keys(d))::BIGINT AS keys FROM docs"""),
    "queue_rejects": with_logs(f"{_BODIES} SELECT body, queue, exchange FROM outer_docs WHERE j IS NULL"),
    "gelf_docs": with_logs(f"""{_BODIES}
SELECT '1.1' AS version, coalesce(d->>'hostname', 'unknown') AS host,
  coalesce(CASE WHEN json_type(d->'message') = 'ARRAY' THEN replace((d->'message')::VARCHAR, ' ', '')
    ELSE d->>'message' END, '') AS short_message,
  'syslog-server' AS facility, coalesce(d->>'tag', '') AS tag, coalesce(d->>'source_queue', queue) AS source_queue,
  exchange AS source_exchange, d->>'status' AS status,
  coalesce(TRY_CAST(nullif(nullif(d->>'timestamp', '1e300'), 'nan') AS DOUBLE), epoch(TRY_CAST(d->>'timestamp' AS TIMESTAMP)),
    epoch(TRY_CAST(replace(d->'timestamp'->>'$."$date"', 'Z', '') AS TIMESTAMP)), {NOW})::DOUBLE
    AS timestamp,
  CAST(NULL AS VARCHAR) AS hidden,
  (8 + CASE WHEN (d->'status') IS NULL THEN 0 ELSE 1 END)::BIGINT AS keys
FROM docs"""),
    "ts_normalise": with_logs(f""",
stamps AS ({STAMPS.replace("us / 1000000 {div}", "us // 1000000").replace("{logs}", "logs")})
SELECT seq, CASE seq % 10 WHEN 1 THEN trim(value)::DOUBLE WHEN 2 THEN trim(value)::DOUBLE
  WHEN 3 THEN epoch(value::TIMESTAMP) - 3 * 3600 WHEN 4 THEN epoch(left(value, 19)::TIMESTAMP) - 4 * 3600
  WHEN 5 THEN epoch(substr(value, 12, 19)::TIMESTAMP) WHEN 6 THEN (value->>'$."$date"')::DOUBLE
  ELSE {NOW} END::DOUBLE AS epoch FROM stamps"""),
    "json_rows": with_logs("""
SELECT '{"seq":' || seq || ',"ip":"' || ip || '","status":' || status || ',"bytes_sent":' || bytes_sent
  || ',"ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00","domain":"' || domain
  || '","user_agent":"' || user_agent || '","nothing":null}' AS body FROM logs"""),
}
