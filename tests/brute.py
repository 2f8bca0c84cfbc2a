"""Feature values worked out row by row from their definitions."""

import math
import re
from collections import Counter

import pandas as pd

COLUMNS = ["seq", "ip", "us", "request", "status", "bytes_sent", "request_time"]
SCHEMA = ("seq long, ip string, us long, request string, status int, bytes_sent long, "
          "request_time double")


def access_logs(spark, rows):
    """Rows in ``COLUMNS`` order as detector input with microsecond times."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([tuple(r) for r in rows], SCHEMA)
    return df.withColumn("ts", F.timestamp_micros("us")).drop("us").withColumns({
        "domain": F.lit("d"), "request_length": F.lit(1).cast("long"), "user_agent": F.lit("ua")})


def _central(values, k):
    mean = math.fsum(values) / len(values)
    return math.fsum((v - mean) ** k for v in values) / len(values)


def _std(values):
    n = len(values)
    return math.sqrt(_central(values, 2) * n / (n - 1)) if n > 1 else 0.0


def _g1(values):
    return _central(values, 3) / _central(values, 2) ** 1.5 if len(set(values)) > 1 else 0.0


def _g2(values):
    return _central(values, 4) / _central(values, 2) ** 2 - 3 if len(set(values)) > 1 else 0.0


def _corrected(values):
    n, equal = len(values), len(set(values)) == 1
    skew = 0.0 if n < 3 or equal else math.sqrt(n * (n - 1)) / (n - 2) * _g1(values)
    kurt = 0.0 if n < 4 or equal else (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * _g2(values) + 6)
    return skew, kurt


def _entropy(values):
    counts = Counter(v for v in values if v is not None)
    total = sum(counts.values())
    return -sum(c / total * math.log(c / total) for c in counts.values()) if len(counts) > 1 else 0.0


def features(rows):
    """All features of one group of rows (``COLUMNS`` order)."""
    rows = sorted(rows, key=lambda r: (r[2], r[0]))
    n = len(rows)
    us = [r[2] for r in rows]
    gaps = [0.0] + [(b - a) / 1e6 for a, b in zip(us, us[1:])]
    matches = [re.search(r"(\S+)\s+(\S+)(?:\s+(\S+))?", r[3]) if r[3] else None for r in rows]
    methods, paths, versions = ([m.group(i) if m else None for m in matches] for i in (1, 2, 3))
    known = [v for v in versions if v is not None]
    near = [g <= 0.1 for g in gaps]
    bursts = sum(now and not before for now, before in zip(near, [False] + near))
    status = [r[4] for r in rows]
    out = {
        "request_count": n, "request_rate": n / 60,
        "unique_paths": len({p for p in paths if p is not None}),
        "unique_paths_ratio": len({p for p in paths if p is not None}) / n,
        "path_entropy": _entropy(paths), "method_entropy": _entropy(methods),
        "status_entropy": _entropy(status),
        "interval_mean": sum(gaps) / n, "interval_std": _std(gaps),
        "interval_skew": _g1(gaps), "interval_kurt": _g2(gaps),
        "burst_rate": bursts / n if n > 1 else 0.0,
        "burst_duration_mean": sum(g for g, b in zip(gaps, near) if b) / bursts if n > 1 else 0.0,
        "burst_size_mean": sum(near) / bursts if n > 1 else 0.0,
        "get_ratio": methods.count("GET") / n, "post_ratio": methods.count("POST") / n,
        "other_method_ratio": 1 - methods.count("GET") / n - methods.count("POST") / n,
        "http1_ratio": sum("HTTP/1" in v for v in known) / len(known) if known else 0.0,
        "http2_ratio": sum("HTTP/2" in v for v in known) / len(known) if known else 0.0,
        "error_rate": sum(s >= 400 for s in status) / n,
        "error_4xx_rate": sum(400 <= s < 500 for s in status) / n,
        "error_5xx_rate": sum(s >= 500 for s in status) / n,
        "session_length": (us[-1] - us[0]) / 1e6,
        "requests_per_second": n / ((us[-1] - us[0]) / 1e6) if us[-1] > us[0] else float(n),
    }
    for name, i in (("bytes", 5), ("time", 6)):
        values = [float(r[i]) for r in rows]
        skew, kurt = _corrected(values)
        out |= {f"{name}_mean": math.fsum(values) / n, f"{name}_std": _std(values),
                f"{name}_skew": skew, f"{name}_kurt": kurt,
                f"{name}_min": min(values), f"{name}_max": max(values)}
    return out


def assert_same(actual: dict, expected: dict, label=""):
    for name, value in expected.items():
        assert math.isclose(actual[name], value, rel_tol=1e-6, abs_tol=1e-7), (
            label, name, actual[name], value)


def minutes(rows):
    groups = {}
    for row in rows:
        groups.setdefault((row[1], row[2] // 60_000_000), []).append(row)
    return groups


def by_key(df, *keys):
    return {tuple(r[k] for k in keys): r.asDict() for r in df.collect()}


def to_us(value):
    return int(pd.Timestamp(value).value // 1000)
