"""Expressions over the request line and other text fields."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from netshield.constants import ISP_KEYWORDS, PREVIEW_CHARS, REQUEST_PATTERN, STATIC_EXTENSIONS


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    """Case-insensitive test for any of the words anywhere in the text."""
    return F.lower(text).rlike("|".join(re.escape(word.lower()) for word in words))


def is_static(request: Column) -> Column:
    """Substring test on the whole request line, so ``/a.json?x`` counts as static."""
    return contains_any(request, STATIC_EXTENSIONS)


def split_request(request: Column) -> dict[str, Column]:
    """Method, URI and protocol split at single spaces; a missing part is NULL."""
    parts = F.split(F.nullif(request, F.lit("")), " ")
    return {
        "http_method": F.get(parts, F.lit(0)),
        "http_uri": F.get(parts, F.lit(1)),
        "http_protocol": F.get(parts, F.lit(2)),
    }


def match_request(request: Column) -> dict[str, Column]:
    """Method, path and version by pattern: tolerant of repeated blanks; NULL when unmatched."""

    def group(i: int) -> Column:
        return F.nullif(F.regexp_extract(request, REQUEST_PATTERN, i), F.lit(""))

    return {"method": group(1), "path": group(2), "version": group(3)}


def isp_class(isp: Column, kind: str) -> Column:
    """Whether a provider name looks like ``hosting``, ``tor``, ``vpn`` or ``vps``."""
    return contains_any(isp, ISP_KEYWORDS[kind])


def preview(text: Column) -> Column:
    return F.substring(text, 1, PREVIEW_CHARS)
