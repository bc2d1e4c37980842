"""The three severity scales: event (1..8), telemetry text (1..4) and threat label (1..3)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C


def _lookup(table: dict, key: Column) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def default_severity(event_type: Column) -> Column:
    return F.coalesce(_lookup(C.DEFAULT_SEVERITY, F.lower(event_type)), F.lit(C.DEFAULT_SEVERITY_OTHER))


def text_severity(word: Column) -> Column:
    """Telemetry severity word to 1..4; unknown words are 1, a missing one stays missing."""
    known = F.coalesce(_lookup(C.TEXT_SEVERITY, F.lower(word)), F.lit(C.TEXT_SEVERITY_OTHER))
    return F.when(word.isNotNull(), known)


def severity_rank(label: Column) -> Column:
    return F.coalesce(_lookup(C.THREAT_SEVERITY, label), F.lit(0))


def severity_num(value: Column) -> Column:
    """Numeric text as it is, threat labels by rank, anything else 1."""
    number = value.cast("string").try_cast("double")
    return F.coalesce(number, _lookup(C.THREAT_SEVERITY, value.cast("string")).cast("double"), F.lit(1.0))
