"""Row-level enrichment and the detection-eligibility filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netshield.functions.request import is_static, isp_class, split_request
from netshield.operators.blocklist import drop_blocked
from netshield.operators.lookup import match_both
from netshield.options import Options


def flag_requests(logs: DataFrame) -> DataFrame:
    """Adds ``is_static``, the three request parts and ``request_complete``."""
    parts = split_request(F.col("request"))
    return logs.withColumns({
        "is_static": F.coalesce(is_static(F.col("request")), F.lit(False)),
        **parts,
        "request_complete": F.coalesce(parts["http_protocol"].isNotNull(), F.lit(False)),
    })


def classify_isp(df: DataFrame, isp: str = "isp") -> DataFrame:
    return df.withColumns(
        {f"is_{kind}": isp_class(F.col(isp), kind) for kind in ("hosting", "tor", "vpn", "vps")})


def enrich(logs: DataFrame, prefixes: DataFrame, geo: DataFrame, ip: str = "ip",
           opts: Options = Options()) -> DataFrame:
    """Static flag, request parts, location and known network; every row is kept."""
    return match_both(flag_requests(logs), ip, geo, prefixes, opts)


def is_candidate() -> Column:
    """Neither a static asset nor a trusted network."""
    return ~F.col("is_static") & (F.col("bot_support") == 0)


def eligible(enriched: DataFrame, blocklist: DataFrame | None = None, ip: str = "ip", ts: str = "ts",
             opts: Options = Options()) -> DataFrame:
    """Rows that enter the per-address series."""
    rows = enriched.where(is_candidate())
    return rows if blocklist is None else drop_blocked(rows, blocklist, ip, ts, opts)
