"""Line-oriented text formats as column expressions over ``value``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.maps import last_value_map
from ..functions.text import strip
from ..functions.times import syslog_timestamp


def _pairs(text: Column, pattern: str, quoted: bool = False) -> Column:
    """All ``key=value`` matches as an array of structs with lower-case keys.

    The pattern runs once over the text; its matches are cut at the first sign of equality.
    """

    def cut(match: Column) -> Column:
        at = F.locate("=", match)
        value = strip(F.substring(match, at + 1, F.length(match)))
        if quoted:
            value = F.substring(value, F.lit(2), F.length(value) - 2)
        return F.struct(F.lower(strip(F.substring(match, F.lit(1), at - 1))).alias("key"), value.alias("value"))

    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), cut)


def _overlay(df: DataFrame, base: dict[str, Column], keep: tuple[str, ...]) -> DataFrame:
    """Base fields as columns, each replaced by a pair of the same name; all pairs in ``fields``."""
    named = {name: F.coalesce(F.try_element_at("fields", F.lit(name)), value) for name, value in base.items()}
    return df.select(*keep, *[value.alias(name) for name, value in named.items()], "fields")


def is_syslog(value: Column) -> Column:
    return strip(value).rlike(C.SYSLOG_LINE)


def parse_syslog(lines: DataFrame, year: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """``Mon dd hh:mm:ss host program: message``; quoted pairs if there are any, else plain ones."""
    mark = "\x01"
    line = strip(F.col("value"))
    cut = F.split(F.regexp_replace("line", C.SYSLOG_LINE, mark.join(f"${i}" for i in (1, 2, 3, 4))), mark, 4)
    df = lines.withColumn("line", line).filter(F.col("line").rlike(C.SYSLOG_LINE)).withColumn("parts", cut)
    message = F.get("parts", 3)
    df = df.withColumn("quoted", _pairs(message, C.SYSLOG_QUOTED_PAIR, quoted=True))
    pairs = F.when(F.size("quoted") > 0, F.col("quoted")).otherwise(_pairs(message, C.SYSLOG_PLAIN_PAIR))
    df = df.withColumn("pairs", pairs).withColumn("fields", last_value_map(F.col("pairs")))
    names = ["timestamp", "hostname", "program", "message"]
    base = {name: F.get("parts", i) for i, name in enumerate(names)}
    parsed = _overlay(df, {**base, "event_type": F.lit("syslog")}, keep)
    if year is not None:
        parsed = parsed.withColumn("timestamp", syslog_timestamp(F.col("timestamp"), year))
    return parsed


def _parts(value: Column, tag: str, parts: int) -> Column:
    return F.split(F.substring(strip(value), len(tag) + 1, 1 << 30), r"\|", parts)


def is_leef(value: Column) -> Column:
    return strip(value).startswith("LEEF:") & (F.size(_parts(value, "LEEF:", 6)) >= 5)


def is_cef(value: Column) -> Column:
    return strip(value).startswith("CEF:") & (F.size(_parts(value, "CEF:", 8)) >= 7)


def _headed(lines: DataFrame, tag: str, parts: int, needed: int, names: list[str], event_type: str, keep: tuple[str, ...]) -> DataFrame:
    value = F.col("value")
    df = lines.filter(strip(value).startswith(tag)).withColumn("parts", _parts(value, tag, parts)).filter(F.size("parts") >= needed)
    rest = F.coalesce(F.get("parts", parts - 1), F.lit(""))
    df = df.withColumn("pairs", _pairs(rest, C.ATTRIBUTE_PAIR)).withColumn("fields", last_value_map(F.col("pairs")))
    base = {name: F.get("parts", i) for i, name in enumerate(names)}
    return _overlay(df, {**base, "event_type": F.lit(event_type)}, keep)


def parse_leef(lines: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return _headed(lines, "LEEF:", 6, 5, ["leef_version", "vendor", "product", "version", "event_id"], "leef", keep)


def parse_cef(lines: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return _headed(
        lines, "CEF:", 8, 7,
        ["cef_version", "vendor", "product", "version", "signature_id", "name", "severity"], "cef", keep)
