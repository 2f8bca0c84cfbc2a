"""Normalisation of timestamps that arrive in several textual forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _plain_epoch(text: Column, offset_hours: int) -> Column:
    """Epoch seconds of a number or an ISO-8601 time; NULL when it is neither."""
    text = F.trim(text)
    zone = rf"([+-]\d{{2}}:?\d{{2}}(?::?\d{{2}})?|[zZ])\z"
    shaped = text.rlike(r"\A\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2})?(:\d{2}([.,]\d+)?)?.*)?\z")
    micros = F.unix_micros(F.try_to_timestamp(F.when(shaped, F.upper(text))))
    naive = ~F.regexp_replace(text, r"\A\d{4}-\d{2}-\d{2}", "").rlike(zone)
    shift = F.when(naive, F.lit(offset_hours * 3600.0)).otherwise(F.lit(0.0))
    number = text.try_cast("double")
    finite = F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)
    return F.coalesce(finite, micros / 1e6 - shift)


def normalize_epoch(value: Column, now: Column, offset_hours: int = 0) -> Column:
    """Epoch seconds from a number, numeric text, ISO-8601 text or ``{"$date": ...}`` JSON.

    Numbers that aren't finite are unreadable. Times without a zone are read at the fixed offset; anything unreadable becomes ``now``.
    The session time zone must be UTC.
    """
    inner = F.get_json_object(value, "$['$date']")
    twice = F.get_json_object(inner, "$['$date']")
    return F.coalesce(
        _plain_epoch(value, offset_hours),
        _plain_epoch(inner, offset_hours),
        _plain_epoch(twice, offset_hours),
        now.cast("double"),
    )
