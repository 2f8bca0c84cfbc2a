"""Statistics in the exact form the scoring model was trained on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def or_zero(value: Column) -> Column:
    """Missing statistics (NULL or NaN) become 0."""
    return F.coalesce(F.nanvl(value.cast("double"), F.lit(None).cast("double")), F.lit(0.0))


def adjusted_skew(n: Column, g1: Column) -> Column:
    """Bias-corrected skewness; 0 below three values or without variance."""
    n = n.cast("double")
    scaled = g1 * F.sqrt(n * (n - 1)) / (n - 2)
    return or_zero(F.when(n >= 3, scaled))


def adjusted_kurt(n: Column, g2: Column) -> Column:
    """Bias-corrected excess kurtosis; 0 below four values or without variance."""
    n = n.cast("double")
    scaled = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
    return or_zero(F.when(n >= 4, scaled))


def seconds(us: Column) -> Column:
    return us / F.lit(1e6)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 for an empty whole."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))
