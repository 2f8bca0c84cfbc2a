import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from netshield.functions.address import ip_hex, is_ipv4
from netshield.operators.blocklist import first_detections
from netshield.operators.hostnames import match_hostname, newest_hostnames, to_resolve
from netshield.operators.lookup import geo_buckets, match_both, match_geo, match_prefix, prefix_buckets
from netshield.options import Options
from netshield.sources import geo, prefixes as px

ADDRESSES = [
    "1.2.3.4", "255.255.255.255", "0.0.0.0", "01.2.3.4", "1.2.3", "1.2.3.4.5", "256.1.1.1", "1.2.3.4\n",
    "abc", "", None, "::", "::1", "1::", "2607:6bc0::", "fe80::1:2", "2001:DB8:0:0:8:800:200C:417A",
    "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4::5:6:7:8", "1:2:3:4:5:6:7:8:9", "1:::2", ":1", "1:",
    "12345::", "::ffff:1.2.3.4", "64:ff9b::192.0.2.33", "::1.2.3", "g::1", "1::2::3",
]


def expected_hex(text):
    try:
        address = ipaddress.ip_address(text)
    except ValueError:
        return None
    return format(int(address), "08X" if address.version == 4 else "032X")


def test_address_text(spark):
    rows = spark.createDataFrame([(a,) for a in ADDRESSES], "ip string")
    for ip, digits, v4 in rows.select("ip", ip_hex(F.col("ip")), is_ipv4(F.col("ip"))).collect():
        assert digits == (expected_hex(ip) if ip is not None else None), ip
        assert v4 == (digits is not None and len(digits) == 8), ip


def random_networks(rng):
    nets = ["0.0.0.0/0", "10.0.0.0/8", "10.1.0.0/16", "10.1.2.0/23", "10.1.2.3", "2001:db8::/32", "::/0"]
    for _ in range(150):
        plen = rng.choice([9, 13, 16, 20, 24, 25, 30, 32])
        nets.append(f"10.{rng.randrange(4)}.{rng.randrange(8)}.{rng.randrange(256)}/{plen}")
        nets.append(f"2001:db8:{rng.randrange(4):x}:{rng.randrange(4):x}::{rng.randrange(9):x}/"
                    f"{rng.choice([29, 40, 48, 64, 100, 128])}")
    return nets


@pytest.mark.parametrize("broadcast_rows", [100_000, 1])
def test_longest_match_against_ipaddress(spark, broadcast_rows):
    rng = random.Random(4)
    names = ["claude", "vpn", "googlebot", "datacenter"]
    lines = [(names[i % 4], n) for i, n in enumerate(random_networks(rng))]
    loaded, bad = px.parse_prefix_lines(spark.createDataFrame(lines, "name string, line string"))
    assert bad.count() == 0
    probes = [f"10.{rng.randrange(5)}.{rng.randrange(9)}.{rng.randrange(256)}" for _ in range(150)]
    probes += [f"2001:db8:{rng.randrange(5):x}:{rng.randrange(5):x}::{rng.randrange(12):x}" for _ in range(150)]
    probes += ["999.1.1.1", "abc", None, "", "8.8.8.8", "fe80::1"]
    df = spark.createDataFrame([(p,) for p in probes], "ip string")
    support = {"claude": 1, "googlebot": 1, "vpn": 0, "datacenter": 0}
    nets = [(ipaddress.ip_network(n, strict=False), name) for name, n in lines]
    rows = match_prefix(df, "ip", loaded, Options(broadcast_rows=broadcast_rows)).collect()
    assert len(rows) == len(probes)
    for row in rows:
        try:
            address = ipaddress.ip_address(row["ip"] or "")
            found = [(n.prefixlen, support[name], name) for n, name in nets
                     if n.version == address.version and address in n]
        except ValueError:
            found = []
        best = min(((-p, -s, name) for p, s, name in found), default=None)
        assert row["bot_name"] == (best[2] if best else None), row
        assert row["bot_support"] == (-best[1] if best else 0)


def test_prefix_files(spark, tmp_path):
    (tmp_path / "claude.ips").write_text("# note\n\n10.0.0.1/8\n10.0.0.1/8\n2607:6bc0::/48")
    (tmp_path / "fastly.ips").write_text("1.1.1.0/24\n")
    (tmp_path / "vpn.ips").write_text("9.9.9.9\n1.2.3.4/40\nwhat\n")
    (tmp_path / "other.txt").write_text("8.8.8.8\n")
    loaded, bad = px.read_prefix_lists(spark, str(tmp_path))
    got = {(r["name"], r["category"], r["support"], r["plen"], r["lo"]) for r in loaded.collect()}
    assert got == {("claude", "ai", 1, 8, "0A000000"), ("claude", "ai", 1, 48, "26076BC0" + "0" * 24),
                   ("vpn", "anonymizer", 0, 32, "09090909")}
    assert {r["line"] for r in bad.collect()} == {"1.2.3.4/40", "what"}
    px.save_prefixes(loaded, str(tmp_path / "saved"))
    assert px.load_prefixes(spark, str(tmp_path / "saved")).count() == 3


def test_geo_files(spark, tmp_path):
    v4, v6 = tmp_path / "v4.csv", tmp_path / "v6.csv"
    v4.write_text('"16777216","16777471","US","United States","California","Los Angeles"\n')
    low = int(ipaddress.ip_address("2607:6bc0::"))
    v6.write_text(f'"{low}","{low + 9}","DE","Germany","Hessen","Frankfurt"\n'
                  f'"{2**128 - 2}","{2**128 - 1}","ZZ","None","None","None"\n')
    ranges = geo.read_geo_v4(spark, str(v4)).unionByName(geo.read_geo_v6(spark, str(v6)))
    probes = spark.createDataFrame(
        [("1.0.0.255",), ("1.0.1.0",), ("2607:6bc0::9",), ("2607:6bc0::a",), ("x",),
         ("ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff",)], "ip string")
    found = {r["ip"]: r["city"] for r in match_geo(probes, "ip", ranges).collect()}
    assert found == {"1.0.0.255": "Los Angeles", "1.0.1.0": "NA", "2607:6bc0::9": "Frankfurt",
                     "2607:6bc0::a": "NA", "x": "NA", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff": "None"}


def test_hostnames_expire(spark):
    at = "timestamp_seconds({})".format
    resolved = spark.sql(f"""SELECT * FROM VALUES ('a', 'old', {at(1000)}), ('a', 'new', {at(1100)}),
        ('b', NULL, {at(1000)}) AS t(ip, hostname, resolved_at)""")
    asked = spark.sql(f"""SELECT * FROM VALUES ('a', {at(999)}), ('a', {at(1000)}), ('a', {at(1099)}),
        ('a', {at(1399)}), ('a', {at(1400)}), ('b', {at(1299)}), ('c', {at(1000)}) AS t(ip, ts)""")
    found = match_hostname(asked, "ip", "ts", resolved)
    got = {(r["ip"], int(r["ts"].timestamp())): (r["ptr"], r["ptr_known"]) for r in found.collect()}
    assert got == {("a", 999): (None, False), ("a", 1000): ("old", True), ("a", 1099): ("old", True),
                   ("a", 1399): ("new", True), ("a", 1400): (None, False), ("b", 1299): (None, True),
                   ("c", 1000): (None, False)}
    assert {r["ip"] for r in to_resolve(found, "ip").collect()} == {"a", "c"}
    assert {r["ip"]: r["hostname"] for r in newest_hostnames(resolved).collect()} == {"a": "new", "b": None}


@pytest.mark.parametrize("broadcast_rows", [0, 10**6])
@pytest.mark.parametrize("life", [1, 7, 300])
def test_hostnames_against_walking(spark, broadcast_rows, life):
    """A hot address with an answer nearly every instant, rare ones, ties, and rows that can't be asked."""
    rng = random.Random(life)
    hot = [("hot", None if rng.random() < 0.3 else f"h{rng.randint(0, 9)}", rng.randint(0, 40_000_000)) for _ in range(400)]
    rare = [(f"r{rng.randint(0, 5)}", f"n{k}", rng.randint(0, 3000) * 1_000_000) for k in range(40)]
    answers = hot + hot[:20] + [("hot", "z", hot[0][2])] + rare + [(None, "x", 5), ("hot", "no time", None)]
    asked = [("hot", rng.randint(-10, 50_000_000)) for _ in range(300)] + [(a[0], a[2] + d) for a in rare + hot[:40]
             for d in (-1, 0, life * 1_000_000 - 1, life * 1_000_000)]
    asked += [(f"r{rng.randint(0, 6)}", rng.randint(0, 3300) * 1_000_000) for _ in range(100)] + [(None, 5), (None, None), ("hot", None)]

    def us(rows, schema):
        df = spark.createDataFrame(rows, schema)
        return df.withColumn(df.columns[-1], F.timestamp_micros(df.columns[-1]))

    found = match_hostname(us([(n, *a) for n, a in enumerate(asked)], "n int, ip string, ts long"), "ip", "ts",
                           us(answers, "ip string, hostname string, resolved_at long"),
                           Options(hostname_timeout_seconds=life, broadcast_rows=broadcast_rows))
    assert found.columns == ["n", "ip", "ts", "ptr", "ptr_known"]
    got = {r["n"]: (r["ptr"], r["ptr_known"]) for r in found.collect()}
    for n, (ip, at) in enumerate(asked):
        usable = [] if ip is None or at is None else [(a[2], a[1]) for a in answers if a[0] == ip and a[2] is not None and a[2] <= at]
        newest = max((t for t, _ in usable), default=None)
        known = newest is not None and newest > at - life * 1_000_000
        names = [name for t, name in usable if t == newest and name is not None]
        assert got[n] == (max(names, default=None) if known else None, known), (ip, at)
    assert len(got) == len(asked)


def test_block_periods(spark):
    times = [0, 10, 1799, 1800, 1900, 3600, 3601, 9000]
    found = spark.createDataFrame([("x", t * 1_000_000) for t in times], "ip string, us long")
    got = sorted(r["us"] // 1_000_000 for r in first_detections(found).collect())
    assert got == [0, 1800, 3600, 9000]


def fold(instants, block_us):
    kept = []
    for us in sorted(set(instants)):
        if not kept or us - kept[-1] >= block_us:
            kept.append(us)
    return kept


def test_suppression_in_one_long_run(spark):
    """A hundred thousand instants without a pause, beside ties, nulls, negative times and a sparse address."""
    rng, block = random.Random(7), 60_000_000
    long = [k * 100_000 + rng.randrange(90_000) for k in range(100_000)]
    sparse = [rng.randrange(-10**10, 10**10) for _ in range(200)]
    exact = [k * block for k in range(-5, 20)]
    df = spark.createDataFrame([("long", us) for us in long] + [("sparse", us) for us in sparse * 2] + [("exact", us) for us in exact]
                               + [(None, 5), ("long", None)], "ip string, us long")
    got = {}
    for r in first_detections(df, Options(block_seconds=60)).collect():
        got.setdefault(r["ip"], []).append(r["us"])
    assert {ip: sorted(v) for ip, v in got.items()} == {
        "long": fold(long, block), "sparse": fold(sparse, block), "exact": fold(exact, block)}
    assert first_detections(df.limit(0)).count() == 0


def test_places_and_networks_in_one_lookup(spark):
    """Distinct addresses are looked up once, in both tables; rows keep their number, NULL addresses their row."""
    prefixes, _ = px.parse_prefix_lines(spark.createDataFrame(
        [("claude", "10.0.0.0/8"), ("vpn", "10.1.0.0/16"), ("vpn", "2001:db8::/32")], "name string, line string"))
    ranges = geo.ranges_from_addresses(spark.createDataFrame(
        [("10.1.0.0", "10.1.0.9", "DE", "Hessen", "Frankfurt")], "ip_from string, ip_to string, country string, region string, city string"))
    tables = geo_buckets(ranges), prefix_buckets(prefixes)
    probes = ["10.1.0.4", "10.1.0.4", "10.1.0.10", "10.2.0.1", "2001:db8::1", "x", "", None, None, "8.8.8.8"]
    df = spark.createDataFrame([(p,) for p in probes], "ip string")
    few, many, large = (match_both(df, "ip", *tables, Options(broadcast_rows=n)) for n in (100, 4, 1))

    def shown(found):
        return sorted(map(str, found.select("ip", "country", "city", "bot_name", "bot_category", "bot_support").collect()))

    assert shown(few) == shown(many) == shown(large)
    by_ip = {r["ip"]: (r["city"], r["bot_name"]) for r in few.collect()}
    assert by_ip["10.1.0.4"] == ("Frankfurt", "vpn") and by_ip["10.2.0.1"] == ("NA", "claude") and by_ip[None] == ("NA", None)


def test_rows_of_few_addresses_meet_one_join(spark):
    """The rows of a log probe no buckets: what their addresses found is joined to them."""
    prefixes, _ = px.parse_prefix_lines(spark.createDataFrame([("claude", "10.0.0.0/8")], "name string, line string"))
    df = spark.range(1000).selectExpr("concat('10.0.0.', id % 3) AS ip")
    plan = match_prefix(df, "ip", prefix_buckets(prefixes))._jdf.queryExecution().optimizedPlan()
    assert plan.toString().startswith("Project") and plan.children().head().children().head().toString().find("Join") < 0


def test_equal_ranges_are_one_entry(spark):
    """Host bits make different lines the same prefix; a bucket holds it once, for the first list by rank."""
    lines = [(name, f"203.0.{k}.7/16") for name in ("vpn", "claude", "googlebot") for k in range(40)]
    prefixes, _ = px.parse_prefix_lines(spark.createDataFrame(lines, "name string, line string"))
    assert prefixes.count() == 120
    entries = [e for r in prefix_buckets(prefixes).collect() for e in r["entries"]]
    assert [e["payload"]["name"] for e in entries] == ["claude"]
