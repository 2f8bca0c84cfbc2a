from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from checks.common import plain_types, with_logs
from netshield.operators import blocklist as bl
from netshield.operators import enrich as en
from netshield.operators.hostnames import match_hostname, to_resolve
from netshield.operators.lookup import match_geo, match_prefix
from netshield.functions.address import hex_family, ip_hex, is_ipv4
from netshield.options import Options
from netshield.sources import prefixes as px
from netshield.sources.geo import ranges_from_addresses
from netshield.session import work_dir
from netshield.sources.testdata import logs

PTR_OPTIONS = Options(hostname_timeout_seconds=20)
BLOCK_OPTIONS = Options(block_seconds=60)

# Lines of real list files (nested, both families) and text derived from a table, in SQL that both
# engines run.
PREFIX_LINES = """
SELECT name, line FROM (VALUES
  ('facebookbot', '31.13.64.0/18'), ('googlebot', '31.13.64.0/19'), ('linkedin', '31.13.64.0/24'),
  ('datacenter', '1.116.0.0/15'), ('vpn', '2.56.150.0/24'), ('claude', '2607:6bc0::/48'),
  ('internal', '10.0.0.0/8'), ('chatgpt', '10.0.0.0/8'), ('googlebot', '203.0.113.8/29')) AS fixed(name, line)
UNION ALL
SELECT CASE s_suppkey % 6 WHEN 0 THEN 'googlebot' WHEN 1 THEN 'datacenter' WHEN 2 THEN 'vpn'
         WHEN 3 THEN 'claude' WHEN 4 THEN 'internal' ELSE 'fastly' END AS name,
  CASE WHEN s_suppkey % 50 = 0 THEN '999.1.1.1/8'
       WHEN s_suppkey % 5 = 0 THEN concat('203.0.113.', s_suppkey % 20)
       WHEN s_suppkey % 5 = 1 THEN concat('203.0.', s_suppkey % 256, '.7/', 16 + s_suppkey % 9)
       WHEN s_suppkey % 5 = 2 THEN concat('2607:6bc0:', s_suppkey % 10, '::/', 40 + s_suppkey % 9)
       WHEN s_suppkey % 5 = 3 THEN concat('# list ', s_suppkey)
       ELSE concat('  10.', s_suppkey % 4, '.0.0/12 ') END AS line
FROM supplier
"""

# Addresses of every shape, one per customer, in SQL that both engines run.
PROBES = """
SELECT c_custkey AS id,
  CASE c_custkey % 9
    WHEN 0 THEN concat('203.0.113.', c_custkey % 256)
    WHEN 1 THEN concat('10.', c_custkey % 32, '.7.9')
    WHEN 2 THEN concat('2607:6bc0:', c_custkey % 12, '::', c_custkey % 7)
    WHEN 3 THEN concat('31.13.', 60 + c_custkey % 80, '.4')
    WHEN 4 THEN concat('203.0.', c_custkey % 300, '.1')
    WHEN 5 THEN 'not-an-ip'
    WHEN 6 THEN concat('1.', 110 + c_custkey % 12, '.0.255')
    WHEN 7 THEN '2607:6bc0:0:0:0:0:0:1'
    ELSE CAST(NULL AS VARCHAR(40)) END AS ip
FROM customer
"""

GEO_RANGES = """
SELECT ip_from, ip_to, country, region, city FROM (VALUES
  ('1.112.0.0', '1.119.255.255', 'CN', 'Beijing', 'Beijing'),
  ('2.56.0.0', '2.56.255.255', 'DE', 'Hessen', 'Frankfurt'),
  ('31.13.64.0', '31.13.127.255', 'IE', 'Dublin', 'Dublin'),
  ('203.0.113.0', '203.0.113.9', 'AU', 'Victoria', 'Melbourne'),
  ('2607:6bc0::', '2607:6bc0:ffff:ffff:ffff:ffff:ffff:ffff', 'US', 'California', 'San Francisco')
) AS fixed(ip_from, ip_to, country, region, city)
UNION ALL
SELECT concat('10.', (p_partkey - p_partkey % 256) / 256 % 256 {int}, '.', p_partkey % 256, '.0'),
  concat('10.', (p_partkey - p_partkey % 256) / 256 % 256 {int}, '.', p_partkey % 256, '.199'),
  concat('C', p_partkey % 7), concat('R', p_partkey % 11), concat('T', p_partkey % 13)
FROM part
"""
GEO_SPARK = GEO_RANGES.replace("(p_partkey - p_partkey % 256) / 256 % 256 {int}",
                               "p_partkey div 256 % 256")
# Parts repeat a range once keys pass 65,536; the least place of a range stays.
GEO_DUCK = """
SELECT ip_from, ip_to, place.country AS country, place.region AS region, place.city AS city FROM (
  SELECT ip_from, ip_to, min({'country': country, 'region': region, 'city': city}) AS place
  FROM (RANGES) GROUP BY ip_from, ip_to)
""".replace("RANGES", GEO_RANGES.replace("(p_partkey - p_partkey % 256) / 256 % 256 {int}",
                                         "p_partkey // 256 % 256"))


def _sql(spark, sf_dir, text, *tables):
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
    for name in tables:
        text = text.replace(f"FROM {name}", f"FROM {{{name}}}")
    return spark.sql(text, **frames)


def prefix_dimension(spark, sf_dir):
    return px.parse_prefix_lines(_sql(spark, sf_dir, PREFIX_LINES, "supplier"))


def geo_dimension(spark, sf_dir):
    return ranges_from_addresses(_sql(spark, sf_dir, GEO_SPARK, "part"))


def addresses(spark, sf_dir):
    seen = logs(spark, sf_dir).select(F.col("seq").alias("id"), "ip")
    return seen.unionByName(_sql(spark, sf_dir, PROBES, "customer"))


def prefix_load(spark, sf_dir):
    return prefix_dimension(spark, sf_dir)[0]


def prefix_rejects(spark, sf_dir):
    return prefix_dimension(spark, sf_dir)[1]


def prefix_files(spark, sf_dir):
    """The lists written as files, read by name, saved and loaded again."""
    lines = _sql(spark, sf_dir, PREFIX_LINES, "supplier")
    base = work_dir(spark, "lists")
    paths = spark._jvm.org.apache.hadoop.fs
    store = paths.Path(base).getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(paths.Path(f"{base}/lists"))
    for name in [r["name"] for r in lines.select("name").distinct().collect()]:  # a few list names
        lines.where(F.col("name") == name).select("line").coalesce(1).write.text(f"{base}/parts/{name}")
        part = next(f.getPath() for f in store.listStatus(paths.Path(f"{base}/parts/{name}"))
                    if f.getPath().getName().startswith("part-"))
        store.rename(part, paths.Path(f"{base}/lists/{name}.ips"))
    prefixes, _ = px.read_prefix_lists(spark, f"{base}/lists")
    px.save_prefixes(prefixes, f"{base}/saved")
    return px.load_prefixes(spark, f"{base}/saved")


def bot_lpm(spark, sf_dir):
    return match_prefix(addresses(spark, sf_dir), "ip", prefix_load(spark, sf_dir))


def bot_lpm_distinct(spark, sf_dir):
    """The same lookup by the path for tables too large to broadcast."""
    return match_prefix(addresses(spark, sf_dir), "ip", prefix_load(spark, sf_dir),
                        Options(broadcast_rows=1))


def geo_range(spark, sf_dir):
    found = match_geo(addresses(spark, sf_dir), "ip", geo_dimension(spark, sf_dir))
    return found.select("id", "ip", "country", F.col("ip2location.region").alias("region"), "city")


def ip_family(spark, sf_dir):
    ip = F.col("ip")
    return addresses(spark, sf_dir).select(
        "id", "ip", is_ipv4(ip).alias("is_v4"), F.coalesce(hex_family(ip_hex(ip)), F.lit(0)).alias("fam"))


def isp_classes(spark, sf_dir):
    return en.classify_isp(_sql(spark, sf_dir, ISPS, "supplier"))


def resolutions(spark, sf_dir):
    """Page views and redirects as resolver answers; only successful ones carry a name."""
    answers = logs(spark, sf_dir).where(F.col("request").startswith("GET") | (F.col("status") == 301))
    name = F.when(F.col("status") < 300, F.concat(F.lit("host-"), (F.col("seq") % 50).cast("string")))
    return answers.select("ip", name.alias("hostname"), F.col("ts").alias("resolved_at"))


def ptr_asof(spark, sf_dir):
    asked = logs(spark, sf_dir).select("seq", "ip", "ts")
    found = match_hostname(asked, "ip", "ts", resolutions(spark, sf_dir), PTR_OPTIONS)
    return plain_types(found)


def ptr_slices(spark, sf_dir):
    """The same with answers that are taken for too many to broadcast."""
    asked = logs(spark, sf_dir).select("seq", "ip", "ts")
    return plain_types(match_hostname(asked, "ip", "ts", resolutions(spark, sf_dir), replace(PTR_OPTIONS, broadcast_rows=0)))


def ptr_to_resolve(spark, sf_dir):
    asked = logs(spark, sf_dir).select("seq", "ip", "ts")
    return to_resolve(match_hostname(asked, "ip", "ts", resolutions(spark, sf_dir), PTR_OPTIONS), "ip")


def blocklist(spark, sf_dir):
    """Every address with a server error, blocked from the first such time."""
    failed = logs(spark, sf_dir).where(F.col("status") >= 500)
    entries = failed.groupBy("ip").agg(F.min("ts").alias("added_at"))
    return bl.with_expiry(entries, BLOCK_OPTIONS)


def eligible_logs(spark, sf_dir):
    enriched = en.enrich(logs(spark, sf_dir), prefix_load(spark, sf_dir), geo_dimension(spark, sf_dir))
    kept = en.eligible(enriched, blocklist(spark, sf_dir), opts=BLOCK_OPTIONS)
    return plain_types(kept.select("seq", "ip", "ts", "http_method", "http_uri", "http_protocol",
                                   "is_static", "country", "city", "bot_name", "bot_category",
                                   "bot_support"))


ISPS = """
SELECT s_suppkey,
  concat(CASE s_suppkey % 8 WHEN 0 THEN 'AMAZON Data Services' WHEN 1 THEN 'Hetzner Online'
    WHEN 2 THEN 'TorProject relay' WHEN 3 THEN 'NordVPN' WHEN 4 THEN 'Linode VPS'
    WHEN 5 THEN 'City Telecom' WHEN 6 THEN 'Private Internet Access' ELSE 'Cloud store' END,
    ' ', s_name) AS isp
FROM supplier
"""

_HEXTETS = """list_transform(
      CASE WHEN contains({a}, '::') THEN list_concat(list_concat(
        list_filter(string_split(string_split({a}, '::')[1], ':'), lambda x: x <> ''),
        list_transform(range(8 - len(list_filter(string_split({a}, ':'), lambda x: x <> ''))),
                       lambda x: '0')),
        list_filter(string_split(string_split({a}, '::')[2], ':'), lambda x: x <> ''))
      ELSE string_split({a}, ':') END,
      lambda x: lpad(bin(('0x' || x)::INTEGER), 16, '0'))"""


def bits_sql(a):
    return f"""CASE WHEN contains({a}, ':') THEN array_to_string({_HEXTETS.format(a=a)}, '')
    WHEN regexp_full_match({a}, '\\d+\\.\\d+\\.\\d+\\.\\d+')
      AND list_max(list_transform(string_split({a}, '.'), lambda x: x::INTEGER)) <= 255
    THEN array_to_string(list_transform(string_split({a}, '.'),
      lambda x: lpad(bin(x::INTEGER), 8, '0')), '') END"""


def _hex_sql(bits):
    return (f"array_to_string(list_transform(range(length({bits}) // 4), lambda i: "
            f"substr('0123456789ABCDEF', 1 + 8 * substr({bits}, i * 4 + 1, 1)::INTEGER"
            f" + 4 * substr({bits}, i * 4 + 2, 1)::INTEGER + 2 * substr({bits}, i * 4 + 3, 1)::INTEGER"
            f" + substr({bits}, i * 4 + 4, 1)::INTEGER, 1)), '')")


_NETWORKS = """
networks(name, category, support) AS (VALUES
  ('facebookbot', 'social', 1), ('linkedin', 'social', 1), ('googlebot', 'search', 1),
  ('claude', 'ai', 1), ('chatgpt', 'ai', 1), ('internal', 'lan', 1),
  ('datacenter', 'datacenter', 0), ('vpn', 'anonymizer', 0))
"""

_PREFIXES = f"""
lines AS ({PREFIX_LINES}),
{_NETWORKS},
cut AS (
  SELECT DISTINCT name, trim(line) AS line, category, support
  FROM lines JOIN networks USING (name) WHERE trim(line) NOT LIKE '#%' AND trim(line) <> ''),
bits AS (
  SELECT *, {bits_sql("string_split(line, '/')[1]")} AS b FROM cut),
prefixes AS (
  SELECT *, CASE WHEN length(b) = 32 THEN 4 ELSE 6 END AS fam,
    coalesce(CAST(string_split(line, '/')[2] AS INTEGER), length(b))::INTEGER AS plen
  FROM bits WHERE b IS NOT NULL)
"""

_ADDRESSES = f"""
addresses AS (SELECT seq AS id, ip FROM logs UNION ALL SELECT id, ip FROM ({PROBES})),
ips AS (SELECT ip, {bits_sql('ip')} AS b FROM (SELECT DISTINCT ip FROM addresses WHERE ip IS NOT NULL))
"""

_BEST = """
best AS (
  SELECT i.ip, first(struct_pack(n := name, c := category, s := support)
    ORDER BY plen DESC, support DESC, category <> 'lan', name) AS net
  FROM ips i JOIN prefixes p ON length(i.b) = length(p.b) AND starts_with(i.b, left(p.b, plen))
  GROUP BY i.ip)
"""

_RANGES = f"""
geo AS (SELECT *, {bits_sql('ip_from')} AS lo, {bits_sql('ip_to')} AS hi FROM ({GEO_DUCK}) g),
located AS (
  SELECT i.ip, g.country, g.region, g.city
  FROM ips i JOIN geo g ON length(i.b) = length(g.lo) AND i.b BETWEEN g.lo AND g.hi)
"""

_RESOLVED = """
, resolved AS (
  SELECT ip, ts AS resolved_at,
    max(CASE WHEN status < 300 THEN 'host-' || (seq % 50) END) AS ptr
  FROM logs WHERE request LIKE 'GET%' OR status = 301 GROUP BY ALL),
asked AS (
  SELECT l.seq, l.ip, l.ts,
    CASE WHEN r.resolved_at > l.ts - INTERVAL 20 SECOND THEN r.ptr END AS ptr,
    coalesce(r.resolved_at > l.ts - INTERVAL 20 SECOND, false) AS ptr_known
  FROM logs l ASOF LEFT JOIN resolved r ON l.ip = r.ip AND l.ts >= r.resolved_at)
"""

_LPM = with_logs(f""", {_ADDRESSES}, {_PREFIXES}, {_BEST}
SELECT id, ip, net.n AS bot_name, net.c AS bot_category, coalesce(net.s, 0)::INTEGER AS bot_support
FROM addresses LEFT JOIN best USING (ip)""")

STATIC_SQL = ("regexp_matches(lower({r}), '[.](jpg|jpeg|png|gif|svg|ico|webp|css|js|jsx|ts|tsx|ttf|woff"
              "|woff2|eot|pdf|doc|docx|xls|xlsx|mp3|mp4|wav|avi|mov|txt|csv|xml|json)')")

QUERIES = {
    "prefix_load": prefix_load,
    "prefix_rejects": prefix_rejects,
    "prefix_files": prefix_files,
    "bot_lpm": bot_lpm,
    "bot_lpm_distinct": bot_lpm_distinct,
    "geo_range": geo_range,
    "ip_family": ip_family,
    "isp_classes": isp_classes,
    "ptr_asof": ptr_asof,
    "ptr_slices": ptr_slices,
    "ptr_to_resolve": ptr_to_resolve,
    "eligible_logs": eligible_logs,
}

ORACLES = {
    "prefix_load": f"""WITH {_PREFIXES}
SELECT fam::INTEGER AS fam, plen, {_hex_sql("rpad(left(b, plen), length(b)::INTEGER, '0')")} AS lo,
  {_hex_sql("rpad(left(b, plen), length(b)::INTEGER, '1')")} AS hi,
  name, category, support::INTEGER AS support FROM prefixes""",
    "prefix_rejects": f"WITH {_PREFIXES} SELECT name, line FROM bits WHERE b IS NULL",
    "bot_lpm": _LPM,
    "bot_lpm_distinct": _LPM,
    "geo_range": with_logs(f""", {_ADDRESSES}, {_RANGES}
SELECT id, ip, coalesce(country, 'NA') AS country, region, coalesce(city, 'NA') AS city
FROM addresses LEFT JOIN located USING (ip)"""),
    "ip_family": with_logs(f""", {_ADDRESSES}
SELECT id, ip, coalesce(length(b) = 32, false) AS is_v4,
  (CASE length(b) WHEN 32 THEN 4 WHEN 128 THEN 6 ELSE 0 END)::INTEGER AS fam
FROM addresses LEFT JOIN ips USING (ip)"""),
    "isp_classes": f"""WITH isps AS ({ISPS})
SELECT s_suppkey, isp,
  regexp_matches(lower(isp), 'host|datacenter|data center|amazon|google|microsoft|azure|aws|cloud|digitalocean|linode|vultr') AS is_hosting,
  regexp_matches(lower(isp), 'tor|exit node') AS is_tor,
  regexp_matches(lower(isp), 'vpn|virtual private network|private internet access|cyberghost|tunnelbear|mullvad') AS is_vpn,
  regexp_matches(lower(isp), 'vps|virtual private server|vultr|linode|digitalocean|scaleway|ovh|hetzner') AS is_vps
FROM isps""",
    "ptr_asof": with_logs(f"{_RESOLVED} SELECT * FROM asked"),
    "ptr_slices": with_logs(f"{_RESOLVED} SELECT * FROM asked"),
    "ptr_to_resolve": with_logs(f"{_RESOLVED} SELECT DISTINCT ip FROM asked WHERE NOT ptr_known"),
    "eligible_logs": with_logs(f""", {_ADDRESSES}, {_PREFIXES}, {_BEST}, {_RANGES},
blocked AS (SELECT ip, min(ts) AS added_at FROM logs WHERE status >= 500 GROUP BY ip)
SELECT seq, ip, ts, string_split(request, ' ')[1] AS http_method,
  string_split(request, ' ')[2] AS http_uri, string_split(request, ' ')[3] AS http_protocol,
  false AS is_static, coalesce(country, 'NA') AS country, coalesce(city, 'NA') AS city,
  net.n AS bot_name, net.c AS bot_category, coalesce(net.s, 0)::INTEGER AS bot_support
FROM logs LEFT JOIN best USING (ip) LEFT JOIN located USING (ip)
WHERE NOT {STATIC_SQL.format(r='request')} AND coalesce(net.s, 0) = 0
  AND NOT EXISTS (SELECT 1 FROM blocked b WHERE b.ip = logs.ip AND b.added_at <= logs.ts
                  AND b.added_at > logs.ts - INTERVAL 60 SECOND)"""),
}
ORACLES["prefix_files"] = ORACLES["prefix_load"]
