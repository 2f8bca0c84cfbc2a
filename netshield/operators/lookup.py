"""Address lookup in prefix lists and ranges.

Every prefix or range has one home bucket: the longest of five fixed leading widths that all its
addresses share. An address probes its five buckets by equi-join, so nothing is exploded on either
side, a probe row matches at most one dimension row per width, and no aggregation or shuffle of the
probe side follows. A bucket is a short sorted array (an IPv4 bucket holds at most 511 prefixes).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netshield.functions.address import ip_hex
from netshield.options import Options
from netshield.session import compute_once, rows_within, settle

# Leading hex digits that define a bucket: (IPv4, IPv6), from widest to narrowest.
_WIDTHS = ((0, 0), (2, 4), (4, 8), (6, 12), (8, 16))


def _bucket(digits: Column, level: int) -> Column:
    v4, v6 = _WIDTHS[level]
    short = F.length(digits) == 8
    return F.concat(F.when(short, F.lit("4:")).otherwise(F.lit("6:")),
                    F.left(digits, F.when(short, v4).otherwise(v6)))


def home_level(lo: Column, hi: Column) -> Column:
    """Index of the narrowest bucket that holds the whole range."""
    level = F.lit(0)
    for i in range(1, len(_WIDTHS)):
        level = F.when(_bucket(lo, i) == _bucket(hi, i), i).otherwise(level)
    return level


def prefix_level(fam: Column, plen: Column) -> Column:
    """The same index for a prefix, from its length alone."""
    bits = F.when(fam == 4, 8).otherwise(16)
    return F.least(F.floor(plen / bits), F.lit(len(_WIDTHS) - 1))


def build_buckets(ranges: DataFrame, payload: list[str], rank: list[Column],
                  level: Column) -> DataFrame:
    """Written lookup table ``(level, key, entries)`` of ``ranges(lo, hi, ...)``.

    ``rank`` orders the ranges of one bucket; the first that holds an address wins, and a narrower
    bucket beats a wider one. Of equal ranges only the first by rank is kept, so a bucket doesn't grow with
    lists that repeat them. Build it once and pass it wherever ranges are expected.
    """
    entry = F.struct(*[r.alias(f"r{i}") for i, r in enumerate(rank)], "lo", "hi",
                     F.struct(*payload).alias("payload"))
    homed = ranges.withColumn("level", level.cast("int"))
    key = F.lit(None).cast("string")
    for i in range(len(_WIDTHS)):
        key = F.when(F.col("level") == i, _bucket(F.col("lo"), i)).otherwise(key)
    distinct = homed.groupBy("level", key.alias("key"), "lo", "hi").agg(F.min(entry).alias("entry"))
    table = distinct.groupBy("level", "key").agg(F.sort_array(F.collect_list("entry")).alias("entries"))
    return settle(table, "buckets")


def _probe(df: DataFrame, buckets: DataFrame, found: str, small: set[int]) -> DataFrame:
    """Add ``found``: the payload struct of the best range around ``_digits``.

    The tables of the ``small`` levels are broadcast.
    """
    hits = []
    for level in reversed(range(len(_WIDTHS))):
        key, entries = f"_key{level}", f"_entries{level}"
        table = buckets.where(F.col("level") == level).select(
            F.col("key").alias(key), F.col("entries").alias(entries))
        if level in small:
            table = F.broadcast(table)
        df = df.withColumn(key, _bucket(F.col("_digits"), level)).join(table, key, "left").drop(key)
        around = F.filter(entries, lambda e: F.col("_digits").between(e["lo"], e["hi"]))
        hits.append(F.get(around, F.lit(0))["payload"])
    return df.withColumn(found, F.coalesce(*hits)).drop(
        *[f"_entries{level}" for level in range(len(_WIDTHS))])


def range_lookup(df: DataFrame, ip: str, buckets: DataFrame, found: str,
                 opts: Options = Options()) -> DataFrame:
    """Left lookup of ``df[ip]``; adds struct ``found`` or NULL."""
    return range_lookups(df, ip, {found: buckets}, opts)


def range_lookups(df: DataFrame, ip: str, tables: dict[str, DataFrame],
                  opts: Options = Options()) -> DataFrame:
    """Left lookups of ``df[ip]`` in several tables; adds a struct or NULL for each.

    The distinct addresses are written first. While there are at most ``broadcast_rows`` of them, each is
    looked up once, in all tables, and what was found is broadcast by address. Of more addresses, a table
    within ``broadcast_rows`` ranges (summed first) is broadcast and the probe side stays in place; a larger
    one is looked up once per address and joined back, where AQE splits a heavy address.
    """
    levels = {found: _level_sizes(buckets) for found, buckets in tables.items()}
    addresses = settle(df.select(F.col(ip).alias("_ip")).where("_ip IS NOT NULL").distinct(), "addresses")
    known = compute_once(addresses, _digits=ip_hex(F.col("_ip"))).where("_digits IS NOT NULL")
    if rows_within(addresses, opts.broadcast_rows):
        for found, buckets in tables.items():
            known = _probe(known, buckets, found, _small(levels[found], opts))
        return _joined_back(df, ip, F.broadcast(known))
    for found, buckets in tables.items():
        if sum(levels[found].values()) <= opts.broadcast_rows:
            with_digits = compute_once(df, _digits=ip_hex(F.col(ip)))
            df = _probe(with_digits, buckets, found, set(levels[found])).drop("_digits")
        else:
            hits = _probe(known, buckets, found, _small(levels[found], opts)).where(F.col(found).isNotNull())
            df = _joined_back(df, ip, hits)
    return df


def _level_sizes(buckets: DataFrame) -> dict[int, int]:
    """How many ranges each level holds."""
    counted = buckets.groupBy("level").agg(F.sum(F.size("entries")).alias("n")).collect()
    return {level: 0 for level in range(len(_WIDTHS))} | {r["level"]: r["n"] for r in counted}


def _small(sizes: dict[int, int], opts: Options) -> set[int]:
    """The levels to broadcast: all of a table within the limit, else those of a fifth of it."""
    if sum(sizes.values()) <= opts.broadcast_rows:
        return set(sizes)
    return {level for level, n in sizes.items() if n <= opts.broadcast_rows // len(sizes)}


def _joined_back(df: DataFrame, ip: str, known: DataFrame) -> DataFrame:
    return df.join(known.drop("_digits"), F.col(ip) == F.col("_ip"), "left").drop("_ip")


def prefix_buckets(prefixes: DataFrame) -> DataFrame:
    """Lookup table of prefixes; one listed twice resolves to the trusted list, ``lan``, then name."""
    if "entries" in prefixes.columns:
        return prefixes
    rank = [-F.col("plen"), -F.col("support"), (F.col("category") != "lan").cast("int"), F.col("name")]
    return build_buckets(prefixes, ["name", "category", "support"], rank,
                         prefix_level(F.col("fam"), F.col("plen")))


def geo_buckets(ranges: DataFrame) -> DataFrame:
    if "entries" in ranges.columns:
        return ranges
    return build_buckets(ranges, ["country", "region", "city"], [F.col("hi"), F.col("lo")],
                         home_level(F.col("lo"), F.col("hi")))


def match_prefix(df: DataFrame, ip: str, prefixes: DataFrame, opts: Options = Options()) -> DataFrame:
    """Longest matching network: adds ``bot_name``, ``bot_category`` and ``bot_support`` (0 if none).

    Ranks put the longest prefix of a bucket first, so the order is longest-match overall.
    """
    return _with_network(range_lookup(df, ip, prefix_buckets(prefixes), "_net", opts))


def _with_network(found: DataFrame) -> DataFrame:
    return found.withColumns({
        "bot_name": F.col("_net.name"),
        "bot_category": F.col("_net.category"),
        "bot_support": F.coalesce("_net.support", F.lit(0)),
    }).drop("_net")


def match_geo(df: DataFrame, ip: str, ranges: DataFrame, opts: Options = Options()) -> DataFrame:
    """Adds struct ``ip2location`` (NULL on a miss), ``country`` and ``city`` (``NA`` on a miss)."""
    return _with_place(range_lookup(df, ip, geo_buckets(ranges), "ip2location", opts))


def _with_place(found: DataFrame) -> DataFrame:
    return found.withColumns({
        "country": F.coalesce("ip2location.country", F.lit("NA")),
        "city": F.coalesce("ip2location.city", F.lit("NA")),
    })


def match_both(df: DataFrame, ip: str, ranges: DataFrame, prefixes: DataFrame,
               opts: Options = Options()) -> DataFrame:
    """``match_geo`` and ``match_prefix`` in one lookup of the addresses."""
    tables = {"ip2location": geo_buckets(ranges), "_net": prefix_buckets(prefixes)}
    return _with_network(_with_place(range_lookups(df, ip, tables, opts)))
