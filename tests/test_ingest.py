import json

import pytest
from pyspark.sql import functions as F

from netshield.functions.timestamps import normalize_epoch
from netshield.operators.gelf import flatten, gelf_documents
from netshield.operators.preview import previews
from netshield.plans.ingestion import detector_rows, gelf_messages, ingest
from netshield.sources import queue as mq
from netshield.sources import synthetic, syslog
from netshield.sources.geo import ranges_from_addresses
from netshield.sources.prefixes import parse_prefix_lines

HEAD = "<13>Dec  1 06:34:00 web-1 app: "


def payload(**extra):
    base = {"domain": "example.com", "timestamp": "1733034840.123", "remote_addr": "1.2.3.4",
            "request": "GET /api HTTP/1.1", "response_status": "200", "body_bytes_sent": "10",
            "request_time": "0.1", "request_length": "5", "http_user_agent": "ua"}
    return json.dumps({k: v for k, v in (base | extra).items() if v != "drop"})


def raw(spark, lines):
    data = [("9.9.9.9", x if isinstance(x, bytes) else x.encode()) for x in lines]
    return spark.createDataFrame(data, "client_address string, data binary").withColumn(
        "recv_ts", F.timestamp_seconds(F.lit(1000)))


CASES = {
    "plain": (HEAD + payload(), None),
    "no header": ("hello " + payload(), "no header"),
    "no json": (HEAD + "text", "no json"),
    "broken": (HEAD + '{"remote_addr": 1,', "no json"),
    "broken braces": (HEAD + '{"remote_addr": x}', "bad json"),
    "trailing object": (HEAD + payload() + payload(), "bad json"),
    "array": (HEAD + "[1]", "no json"),
    "no address": (HEAD + payload(remote_addr="drop"), "no remote_addr"),
    "null request": (HEAD + payload(request=None), "no request"),
    "empty request": (HEAD + payload(request=""), None),
    "two lines": (HEAD + "first\n" + payload(), "no json"),
    "line after": (HEAD + payload() + "\nmore", None),
    "spaces": ("  \t" + HEAD + payload() + "\n", None),
    "oversize": (HEAD + payload(pad="x" * 70000), "oversize"),
    "nested": (HEAD + payload(edge={"pop": [1, 2]}), None),
    "unquoted": (HEAD + payload(response_status=404), None),
}


@pytest.mark.parametrize("name", CASES)
def test_quarantine_reason(spark, name):
    line, reason = CASES[name]
    assert [r["reason"] for r in syslog.parse_messages(raw(spark, [line])).collect()] == [reason]


def test_parsed_fields(spark):
    line = "<14>Dec  1 06:34:00 web-1 app: " + payload(edge={"pop": 1}, response_status=404)
    latin = (HEAD + payload(http_user_agent="caf#")).encode("latin-1").replace(b"#", b"\xe9")
    messages = syslog.parse_messages(raw(spark, [line, latin]))
    first, second = sorted(syslog.parsed_logs(messages).collect(), key=lambda r: -r["priority"])
    assert first["priority"] == 14 and first["hostname"] == "web-1"
    assert first["extras"] == {"edge": '{"pop":1}'} and first["response_status"] == "404"
    assert second["http_user_agent"] == "café"
    by_event = syslog.parsed_logs(messages, "timestamp").select(F.unix_micros("ts")).first()[0]
    assert by_event == 1733034840123000
    header = messages.where("priority = 14").first()
    assert header["header_time"] == "Dec  1 06:34:00" and header["message"].startswith("app: {")


def test_bad_numbers_are_set_aside(spark):
    logs = syslog.parsed_logs(syslog.parse_messages(raw(spark, [
        HEAD + payload(), HEAD + payload(body_bytes_sent="ten"), HEAD + payload(request_time=None)])))
    good, bad = syslog.typed_logs(logs)
    assert (good.count(), bad.count()) == (1, 2)


def test_ingest_keeps_static_and_bot_rows(spark):
    prefixes, _ = parse_prefix_lines(spark.createDataFrame(
        [("claude", "5.5.5.0/24"), ("vpn", "6.6.6.6")], "name string, line string"))
    geo = ranges_from_addresses(spark.createDataFrame(
        [("6.6.6.0", "6.6.6.255", "DE", "HE", "Frankfurt")],
        "ip_from string, ip_to string, country string, region string, city string"))
    lines = [HEAD + payload(remote_addr=ip, request=request) for ip, request in (
        ("1.1.1.1", "GET /a HTTP/1.1"), ("1.1.1.2", "GET /app.JS?v=1 HTTP/1.1"),
        ("5.5.5.5", "GET /a HTTP/1.1"), ("6.6.6.6", "GET /short"))]
    logs, bad = ingest(raw(spark, lines), prefixes, geo)
    assert bad.count() == 0
    rows = {r["ip"]: r for r in logs.collect()}
    assert rows["1.1.1.2"]["is_static"] and not rows["1.1.1.1"]["is_static"]
    assert rows["5.5.5.5"]["bot_name"] == "claude" and rows["5.5.5.5"]["bot_support"] == 1
    short = rows["6.6.6.6"]
    assert (short["city"], short["bot_category"], short["http_protocol"]) == ("Frankfurt", "anonymizer", None)
    assert not short["request_complete"]
    assert {r["ip"] for r in detector_rows(logs).collect()} == {"1.1.1.1", "6.6.6.6"}
    docs = gelf_documents(gelf_messages(logs, "access", "logs", "logs-x"), F.lit(0.0))
    texts = [json.loads(r["gelf"]) for r in docs.collect()]
    doc = next(d for d in texts if d["_remote_addr"] == "6.6.6.6")
    assert doc["version"] == "1.1" and doc["host"] == "web-1" and doc["timestamp"] == 1000
    assert doc["_bot_support"] == 0 and doc["_is_static"] is False and doc["_source_queue"] == "logs"
    assert doc["_ip2location"] == {"country": "DE", "region": "HE", "city": "Frankfurt"}
    assert doc["tag"] == "access" and "_message" not in doc and "_hostname" not in doc


def test_document_values_keep_their_types(spark):
    prefixes, _ = parse_prefix_lines(spark.createDataFrame([("claude", "5.5.5.0/24")], "name string, line string"))
    geo = ranges_from_addresses(spark.createDataFrame(
        [("6.6.6.0", "6.6.6.255", "DE", None, "Frankfurt")],
        "ip_from string, ip_to string, country string, region string, city string"))
    logs, _ = ingest(raw(spark, [HEAD + payload(remote_addr="6.6.6.6", edge={"pop": 1})]), prefixes, geo)
    more = logs.withColumns({"share": F.lit(10.0), "seen": F.col("ts"), "price": F.lit("1.50").cast("decimal(9,3)")})
    doc = gelf_messages(more, "access", "logs", "logs-x").first()["doc"]
    expected = {"bot_support": 0, "is_static": False, "domain": "example.com", "bot_name": None, "share": 10,
                "timestamp": 1000, "price": 1.5, "seen": "1970-01-01T00:16:40.000Z", "edge": '{"pop":1}',
                "ip2location": {"country": "DE", "region": None, "city": "Frankfurt"}}
    assert {k: doc[k].toPython() for k in expected} == expected and doc["bot_category"].toJson() == "null"


def test_queue_bodies(spark):
    bodies = ['{"message": "m", "n": 1.50, "hostname": null}', '"{\\"a\\": 1}"', '"text"', "12", "[1, 2]",
              "null", "true", '{"a": 1', "'x'", '{"a": 1} x', '"[1]"']
    df = spark.createDataFrame([(b,) for b in bodies], "body string")
    good, bad = mq.normalize_messages(mq.union_queues([(df, "q1", "x1"), (df.limit(1), "q2", "x2")]))
    docs = sorted(r[0] for r in good.where("queue = 'q1'").select(F.to_json("doc")).collect())
    assert docs == sorted(['{"hostname":null,"message":"m","n":1.5}', '{"a":1}', '{"message":"text"}',
                           '{"message":12}', '{"message":[1,2]}', '{"message":null}', '{"message":true}',
                           '{"message":"[1]"}'])
    assert {r["body"] for r in bad.collect()} == {'{"a": 1', "'x'", '{"a": 1} x'}
    assert good.where("queue = 'q2'").select("exchange").first()[0] == "x2"


def test_timestamps(spark):
    values = {None: 7.0, "1733034840.5": 1733034840.5, " 12 ": 12.0, "2024-12-01T06:34:00": 1733034840.0,
              "2024-12-01T06:34:00+04:00": 1733020440.0, "2024-12-01 06:34:00Z": 1733034840.0,
              '{"$date": "2024-12-01T06:34:00Z"}': 1733034840.0, '{"$date": 5}': 5.0,
              '{"$date": {"$date": "6"}}': 6.0, "junk": 7.0, "": 7.0, "2024-12-01": 1733011200.0}
    df = spark.createDataFrame([(v,) for v in values], "value string")
    got = {r[0]: r[1] for r in df.select("value", normalize_epoch(F.col("value"), F.lit(7))).collect()}
    assert got == values
    shifted = spark.createDataFrame([("2024-12-01T06:34:00",)], "value string").select(
        normalize_epoch(F.col("value"), F.lit(7), 4)).first()[0]
    assert shifted == 1733020440.0


def test_flatten(spark):
    df = spark.sql("SELECT 1 AS a, named_struct('b', 2, 'c', named_struct('d', 3)) AS s")
    assert flatten(df).columns == ["a", "b", "c"]


def test_preview_fits_budget(spark):
    rows = spark.range(300).selectExpr(
        "'x' AS ip", "id AS seq", "id * 250000 AS us", "200 AS status", "id AS bytes_sent",
        "0.5D AS request_time", "id AS request_length", "repeat('r', 500) AS request", "'ua' AS user_agent")
    row = previews(rows, ["ip"], max_bytes=10_000).first()
    kept = json.loads(row["ip_data"])
    size = 300 * len(json.dumps(kept[1], separators=(",", ":")))
    stride = [k["timestamp"] // 250_000 for k in kept][1]
    assert row["ip_data_rows_total"] == 300 and row["ip_data_rows_preview"] == len(kept)
    assert abs(stride - (size // 10_000 + 1)) <= 1 and len(kept[0]["request_preview"]) == 200
    whole = previews(rows.limit(3), ["ip"], max_bytes=10_000).first()
    assert whole["ip_data_rows_preview"] == 3


def test_synthetic_traffic_parses(spark):
    start = F.timestamp_seconds(F.lit(1733034840))
    made = synthetic.traffic(synthetic.numbered(spark, 500), start)
    typed, bad = syslog.typed_logs(syslog.parsed_logs(syslog.parse_messages(made)))
    assert typed.count() == 500 and bad.count() == 0
    assert {r[0] for r in typed.select("status").distinct().collect()} == {200, 301, 404, 500}
    assert {r[0] for r in typed.select("ip").distinct().collect()} == {synthetic.TEST_IP}
