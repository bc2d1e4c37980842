"""Windows event XML, with or without a namespace on ``Event``."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.maps import last_value_map
from ..functions.rows import rows_where
from ..schemas import WINDOWS_EVENT


END_TAG = "</Event>"


def _entry(key: Column | str, value: Column) -> Column:
    return F.struct(F.lit(key).alias("key") if isinstance(key, str) else key.alias("key"), value.alias("value"))


def _system_entries(schema: T.StructType) -> Column:
    """Each child of System under its lower-case name, each attribute under ``child_attribute``."""
    entries = []
    for child in schema["System"].dataType.fields:
        base = F.col(f"System.{child.name}")
        name = child.name.lower()
        if not isinstance(child.dataType, T.StructType):
            entries.append(F.when(base.isNotNull(), _entry(name, base)))
            continue
        for attribute in child.dataType.names:
            value = base[attribute]
            key = name if attribute == "_VALUE" else f"{name}_{attribute[1:].lower()}"
            entries.append(F.when(value.isNotNull(), _entry(key, value)))
    return F.filter(F.array(*entries), lambda e: e.isNotNull())


_OTHER_CHILD = r"<(?:[\w.-]+:)?(?!(?i:%s)[\s/>])([\w.-]+)(\s[^<>]*?)?(?:/>|>([^<]*)</[^>]*>)"


def _plain(text: Column) -> Column:
    """Text with the five named entities resolved."""
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return text


def _other_children(df: DataFrame, xml: str, schema: T.StructType) -> DataFrame:
    """``_others``: name, attributes and text of the children of System that the schema doesn't list.

    The pattern itself passes over listed names, so that an event without others yields no child.
    """
    body = F.regexp_extract(xml, r"(?s)<(?:\w+:)?System(?:\s[^>]*)?>(.*?)</(?:\w+:)?System>", 1)
    other = F.lit(_OTHER_CHILD % "|".join(map(re.escape, schema["System"].dataType.names)))
    parts = {name: F.regexp_extract_all("_body", other, F.lit(group)) for name, group in (("name", 1), ("attributes", 2), ("said", 3))}
    return df.withColumn("_body", body).withColumns(parts).withColumn("_others", F.arrays_zip(*parts)).drop("_body", *parts)


def _other_entries(children: Column) -> Column:
    """Their text, and attributes under ``child_attribute``."""

    def entries(child: Column) -> Column:
        name, said = F.lower(child["name"]), child["said"]
        attributes = F.when(child["attributes"] != "", F.regexp_extract_all(
            child["attributes"], F.lit(r"[\w.:-]+\s*=\s*(?:\"[^\"]*\"|'[^']*')"), F.lit(0))).otherwise(F.array().cast("array<string>"))
        own = F.transform(attributes, lambda a: _entry(
            F.concat(name, F.lit("_"), F.lower(F.btrim(F.split_part(a, F.lit("="), F.lit(1))))),
            _plain(F.regexp_extract(a, r"(?s)=\s*[\"'](.*)[\"']$", 1))))
        return F.concat(F.when(said != "", F.array(_entry(name, _plain(said)))).otherwise(F.slice(own, 1, 0)), own)

    return F.flatten(F.transform(children, entries))


def event_fields(df: DataFrame, xml: str | None = None) -> DataFrame:
    """``event_type`` and the ``fields`` map of parsed Event rows; with ``xml``, the column that holds the
    text, also what the schema doesn't list."""
    system = _system_entries(df.schema)
    if xml is not None:
        df = _other_children(df, xml, df.schema)
        system = F.concat(system, _other_entries(F.col("_others")))
    df = df.withColumn("_system", system)
    offset = F.size("_system") + 1
    data = F.transform(
        F.coalesce("EventData.Data", F.array()),
        lambda d, i: _entry(F.lower(F.coalesce(d["_Name"], F.concat(F.lit("data_"), offset + i))), d["_VALUE"]))
    df = df.withColumn("_entries", F.concat("_system", data))
    kept = [c for c in df.columns if c in ("file", "place")]
    return df.select(*kept, F.lit("windows_event").alias("event_type"), last_value_map(F.col("_entries")).alias("fields"))


def split_events(pieces: DataFrame) -> DataFrame:
    """``xml``: one text per Event element, from texts (``value``) up to an end tag, with file and place.

    The end tag serves as separator, so big files split between tasks, and it does not
    matter whether the file has a root element, a declaration or line breaks inside events.
    """
    begun = pieces.filter(F.contains("value", F.lit("<Event"))).select(
        F.regexp_extract("value", r"(?s)(<Event(?:\s|>).*)", 1).alias("xml"), "file", "place")
    return rows_where(begun, F.col("xml") != "", F.concat("xml", F.lit(END_TAG)).alias("xml"), "file", "place")


def read_windows_xml(spark: SparkSession, path, schema: T.StructType = WINDOWS_EVENT) -> DataFrame:
    """Parsed events; elements that are not well-formed are left out."""
    return read_xml_events(spark, path, schema)[0].drop("file", "place")


def read_xml_events(spark: SparkSession, path, schema: T.StructType = WINDOWS_EVENT) -> tuple[DataFrame, DataFrame]:
    """(events with file and place, elements that are not well-formed with their file)."""
    pieces = spark.read.option("lineSep", END_TAG).text(path)
    return parse_xml_events(pieces.select(
        "value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("place")), schema)


def parse_xml_events(pieces: DataFrame, schema: T.StructType = WINDOWS_EVENT) -> tuple[DataFrame, DataFrame]:
    """As ``read_xml_events``, from texts up to an end tag."""
    checked = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    parsed = split_events(pieces).withColumn("e", F.from_xml("xml", checked, {"ignoreNamespace": "true"}))
    broken = F.col("e._corrupt_record").isNotNull()
    good = rows_where(parsed, ~broken, "file", "place", "xml", *[F.col(f"e.{name}").alias(name) for name in schema.names])
    return event_fields(good, "xml"), parsed.filter(broken).select("file", F.col("xml").alias("line"))
