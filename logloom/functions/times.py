"""Timestamp parsing and rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Layouts tried in order after the ISO cast.
LAYOUTS = [
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XXX",
    "yyyy/MM/dd HH:mm:ss",
    "MM/dd/yyyy HH:mm:ss",
    "dd-MMM-yyyy HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]xx",
    "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS] xx",
    "dd/MMM/yyyy:HH:mm:ss xx",
    "MMM d yyyy HH:mm:ss",
    "yyyy MMM d HH:mm:ss",
]
#: Digits of an epoch text, and what turns the number into microseconds.
EPOCHS = ((10, 1_000_000), (13, 1_000), (16, 1))


def coerce_timestamp(text: Column) -> Column:
    """Text to timestamp; null where no known layout fits.

    Text of digits alone is a year or an epoch; no layout is tried on it.
    """
    iso, number = F.try_to_timestamp(text), text.try_cast("bigint")
    layouts = [F.try_to_timestamp(text, F.lit(layout)) for layout in LAYOUTS]
    epochs = [F.when(text.rlike(f"^[0-9]{{{digits}}}$"), F.timestamp_micros(number * scale)) for digits, scale in EPOCHS]
    return F.coalesce(iso, F.when(text.rlike("^[0-9]+$"), F.coalesce(*epochs)).otherwise(F.coalesce(*layouts)))


def syslog_timestamp(text: Column, year: Column) -> Column:
    """``Mon d HH:mm:ss`` carries no year, so the caller supplies one."""
    compact = F.regexp_replace(text, r"\s+", " ")
    return F.try_to_timestamp(F.concat_ws(" ", year.cast("string"), compact), F.lit("yyyy MMM d HH:mm:ss"))


def timestamp_text(ts: Column) -> Column:
    """Seconds precision, with six fractional digits only when there is a fraction."""
    micros = F.date_format(ts, "SSSSSS")
    seconds = F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
    return F.when(micros == "000000", seconds).otherwise(F.concat_ws(".", seconds, micros))
