from __future__ import annotations

from pyspark.sql import functions as F

from checks.common import ntz, plain_types, rounded, with_logs
from netshield.constants import FEATURES
from netshield.operators import features as ft
from netshield.sources.testdata import logs

KEYS = ["ip", "win"]

# Ratios and averages of whole numbers are the same double in both engines and stay unrounded;
# the rest depends on summation order in its last bits.
_DIGITS = {
    "path_entropy": 6, "method_entropy": 6, "status_entropy": 6,
    "interval_std": 6, "bytes_std": 6, "time_std": 6, "time_mean": 10,
    "interval_skew": 4, "interval_kurt": 4, "bytes_skew": 4, "bytes_kurt": 4,
    "time_skew": 4, "time_kurt": 4,
}


def shown(name):
    return rounded(name, _DIGITS[name]) if name in _DIGITS else F.col(name)


def shown_sql(name):
    return f"round({name}, {_DIGITS[name]}) AS {name}" if name in _DIGITS else name


def group():
    return [F.col("ip"), ntz("win")]


def rows(spark, sf_dir):
    return ft.with_window(logs(spark, sf_dir))


def _pick(operator, names):
    def run(spark, sf_dir):
        return operator(rows(spark, sf_dir), KEYS).select(*group(), *[shown(n) for n in names])

    return run


def feat_counts(spark, sf_dir):
    data = rows(spark, sf_dir)
    joined = ft.counters(data, KEYS).join(ft.diversity(data, KEYS), KEYS, "left")
    return joined.select(
        *group(), ntz("timestamp"), "request_count", "request_rate",
        F.coalesce("unique_paths", F.lit(0)).alias("unique_paths"),
        (F.coalesce("unique_paths", F.lit(0)) / F.col("request_count")).alias("unique_paths_ratio"),
        "session_length", "requests_per_second",
    )


def feat_all(spark, sf_dir):
    table = ft.minute_features(logs(spark, sf_dir))
    return table.select(*group(), ntz("timestamp"), *[shown(n) for n in FEATURES])


def value_counts(spark, sf_dir):
    counts = ft.value_counts(rows(spark, sf_dir), KEYS)
    return plain_types(counts.select("ip", "win", "field", "value", "n"))


def last_window(spark, sf_dir):
    """The most recent feature row of each address, the one a scorer sees."""
    return ft.last_windows(ft.minute_features(logs(spark, sf_dir))).select(
        *group(), ntz("timestamp"), *[shown(n) for n in FEATURES]
    )


FEATURE_CTES = """
, parts AS (
  SELECT *, make_timestamp(minute * 60000000) AS win,
    string_split(request, ' ')[1] AS m, string_split(request, ' ')[2] AS p,
    string_split(request, ' ')[3] AS v,
    us - coalesce(lag(us) OVER (PARTITION BY ip, minute ORDER BY us, seq), us) AS gap
  FROM {source}
),
flagged AS (
  SELECT *, gap <= 100000 AND NOT coalesce(
    lag(gap <= 100000) OVER (PARTITION BY ip, minute ORDER BY us, seq), false) AS starts
  FROM parts
),
ent AS (
  SELECT ip, win, sum(CASE WHEN f = 'p' THEN 1 ELSE 0 END) AS paths,
    {entropies}
  FROM (SELECT ip, win, f, val, count(*) AS c FROM (
          SELECT ip, win, unnest(['p', 'm', 's']) AS f, unnest([p, m, status::VARCHAR]) AS val
          FROM parts) GROUP BY ALL)
  GROUP BY ip, win
),
sums AS (
  SELECT ip, win, make_timestamp(max(us)) AS timestamp, count(*) AS n,
    (max(us) - min(us)) / 1e6 AS session_length,
    sum(gap)::DOUBLE / count(*) / 1e6 AS interval_mean,
    coalesce(stddev_samp(gap / 1e6), 0) AS interval_std,
    CASE WHEN count(*) >= 3 THEN skewness(gap / 1e6) * (count(*) - 2)
      / sqrt(count(*)::DOUBLE * (count(*) - 1)) END AS interval_skew,
    kurtosis_pop(gap / 1e6) AS interval_kurt,
    count(*) FILTER (starts) AS bursts,
    count(*) FILTER (gap <= 100000) AS burst_requests,
    coalesce(sum(gap) FILTER (gap <= 100000), 0)::DOUBLE AS burst_us,
    count(*) FILTER (m = 'GET') / count(*) AS get_ratio,
    count(*) FILTER (m = 'POST') / count(*) AS post_ratio,
    count(*) FILTER (v LIKE '%HTTP/1%') / count(v) AS http1_ratio,
    count(*) FILTER (v LIKE '%HTTP/2%') / count(v) AS http2_ratio,
    {moments}
    count(*) FILTER (status >= 400) / count(*) AS error_rate,
    count(*) FILTER (status >= 400 AND status < 500) / count(*) AS error_4xx_rate,
    count(*) FILTER (status >= 500) / count(*) AS error_5xx_rate
  FROM flagged GROUP BY ip, win
),
feats AS (
  SELECT ip, win, timestamp, n AS request_count, n / 60.0::DOUBLE AS request_rate,
    paths::BIGINT AS unique_paths, paths / n AS unique_paths_ratio,
    path_entropy, method_entropy, status_entropy,
    interval_mean, interval_std,
    CASE WHEN session_length > 0 THEN coalesce(interval_skew, 0) ELSE 0 END AS interval_skew,
    CASE WHEN session_length > 0 THEN coalesce(interval_kurt, 0) ELSE 0 END AS interval_kurt,
    CASE WHEN n < 2 THEN 0 ELSE bursts / n END AS burst_rate,
    CASE WHEN n < 2 THEN 0 ELSE burst_us / bursts / 1e6 END AS burst_duration_mean,
    CASE WHEN n < 2 THEN 0 ELSE burst_requests / bursts END AS burst_size_mean,
    get_ratio, post_ratio, 1 - get_ratio - post_ratio AS other_method_ratio,
    http1_ratio, http2_ratio,
    bytes_mean, bytes_std, bytes_skew, bytes_kurt, bytes_min, bytes_max,
    time_mean, time_std, time_skew, time_kurt, time_min, time_max,
    error_rate, error_4xx_rate, error_5xx_rate, session_length,
    CASE WHEN session_length > 0 THEN n / session_length ELSE n END AS requests_per_second
  FROM sums JOIN ent USING (ip, win)
)
""".replace("{entropies}", ",\n    ".join(
    f"coalesce(CASE WHEN count(*) FILTER (f = '{f}') > 1 THEN ln(sum(c) FILTER (f = '{f}'))"
    f" - sum(c * ln(c)) FILTER (f = '{f}') / sum(c) FILTER (f = '{f}') END, 0) AS {name}_entropy"
    for f, name in (("p", "path"), ("m", "method"), ("s", "status"))
)).replace("{moments}", "\n    ".join(
    f"avg({x}::DOUBLE) AS {name}_mean, coalesce(stddev_samp({x}), 0) AS {name}_std,"
    f" coalesce(skewness({x}), 0) AS {name}_skew, coalesce(kurtosis({x}), 0) AS {name}_kurt,"
    f" min({x})::DOUBLE AS {name}_min, max({x})::DOUBLE AS {name}_max,"
    for x, name in (("bytes_sent", "bytes"), ("request_time", "time"))
))


def feature_ctes(source="logs"):
    """CTEs up to ``feats``; ``source`` may fold further keys into its ``ip`` column."""
    return FEATURE_CTES.replace("{source}", source)


def feature_sql(names, extra="", tail=""):
    columns = ", ".join(["ip", "win", *([extra] if extra else []), *map(shown_sql, names)])
    return with_logs(f"{feature_ctes()} SELECT {columns} FROM feats {tail}")


_COUNTS = ("request_count", "request_rate", "unique_paths", "unique_paths_ratio",
           "session_length", "requests_per_second")
_ENTROPY = ("path_entropy", "method_entropy", "status_entropy")
_INTERVALS = ("interval_mean", "interval_std", "interval_skew", "interval_kurt")
_BURSTS = ("burst_rate", "burst_duration_mean", "burst_size_mean")
_PROTOCOL = ("get_ratio", "post_ratio", "other_method_ratio", "http1_ratio", "http2_ratio")
_BYTES = ("bytes_mean", "bytes_std", "bytes_skew", "bytes_kurt", "bytes_min", "bytes_max")
_TIME = ("time_mean", "time_std", "time_skew", "time_kurt", "time_min", "time_max")
_ERRORS = ("error_rate", "error_4xx_rate", "error_5xx_rate")

QUERIES = {
    "feat_counts": feat_counts,
    "feat_entropy": _pick(ft.diversity, _ENTROPY),
    "feat_intervals": _pick(ft.gaps, _INTERVALS),
    "feat_bursts": _pick(ft.gaps, _BURSTS),
    "feat_protocol": _pick(ft.counters, _PROTOCOL),
    "feat_bytes": _pick(ft.counters, _BYTES),
    "feat_time": _pick(ft.counters, _TIME),
    "feat_errors": _pick(ft.counters, _ERRORS),
    "feat_all": feat_all,
    "value_counts": value_counts,
    "last_window": last_window,
}

ORACLES = {
    "feat_counts": feature_sql(_COUNTS, "timestamp"),
    "feat_entropy": feature_sql(_ENTROPY),
    "feat_intervals": feature_sql(_INTERVALS),
    "feat_bursts": feature_sql(_BURSTS),
    "feat_protocol": feature_sql(_PROTOCOL),
    "feat_bytes": feature_sql(_BYTES),
    "feat_time": feature_sql(_TIME),
    "feat_errors": feature_sql(_ERRORS),
    "feat_all": feature_sql(FEATURES, "timestamp"),
    "value_counts": with_logs("""
, parts AS (
  SELECT ip, make_timestamp(minute * 60000000) AS win, string_split(request, ' ') AS r, status
  FROM logs)
SELECT ip, win, field, value, count(*) AS n FROM (
  SELECT ip, win, unnest(['path', 'method', 'status']) AS field,
    unnest([r[2], r[1], status::VARCHAR]) AS value FROM parts)
GROUP BY ALL"""),
    "last_window": feature_sql(
        FEATURES, "timestamp", "QUALIFY row_number() OVER (PARTITION BY ip ORDER BY win DESC) = 1"),
}
