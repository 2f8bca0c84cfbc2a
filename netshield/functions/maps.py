"""Maps whose keys may repeat, as JSON objects allow."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def last_wins(entries: Column) -> Column:
    """The map with the last value of every repeated key; NULL stays NULL."""
    pairs = F.map_entries(entries)
    ordered = F.array_sort(F.transform(pairs, lambda e, i: F.struct(e["key"].alias("key"), i.alias("at"))))
    last = F.filter(ordered, lambda e, i: F.coalesce(F.get(ordered, i + 1)["key"] != e["key"], F.lit(True)))
    unique = F.map_from_arrays(F.transform(last, lambda e: e["key"]),
                               F.transform(last, lambda e: F.get(pairs, e["at"])["value"]))
    repeats = F.size(F.array_distinct(F.map_keys(entries))) < F.size(entries)
    return F.when(repeats, unique).otherwise(entries)
