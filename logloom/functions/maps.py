"""Maps from (key, value) pairs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def last_value_map(pairs: Column) -> Column:
    """Map of an array of ``struct<key, value>``; a repeated key keeps its last value.

    The common case without repeats needs no search.
    """
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    newest = F.reverse(pairs)
    searched = F.map_from_arrays(keys, F.transform(
        keys, lambda k: F.element_at(F.filter(newest, lambda p: p["key"] == k), 1)["value"]))
    return F.when(F.size(keys) == F.size(pairs), F.map_from_entries(pairs)).otherwise(searched)
