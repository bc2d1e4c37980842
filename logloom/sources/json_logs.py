"""JSON sources. A root array or wrapped array is cut into its elements where they lie, by many tasks; see ``cutting``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C
from ..functions.rows import rows_where
from ..functions.text import boxed_json, only_value, strip
from ..schemas import PROCESS, RAW_EVENT
from .cutting import LARGEST_RECORD, SHOWN, WRAPPERS, json_records, pieces


def _parsed(read: DataFrame, keys: tuple[str, ...], largest: int = LARGEST_RECORD) -> DataFrame:
    """Records with ``record``, the VARIANT of their text, which is null if that is no JSON object."""
    texts = json_records(read, keys, largest)
    is_object = strip(F.col("text")).startswith("{") & F.col("problem").isNull()
    # A column of its own, so that a text is parsed once.
    boxed = texts.withColumn("_boxed", F.when(is_object, boxed_json(F.col("text"))))
    return boxed.withColumn("record", only_value(F.col("_boxed"))).drop("_boxed")


def _objects(spark: SparkSession, path, keys: tuple[str, ...], level: int) -> DataFrame:
    return rows_where(_parsed(pieces(spark, path, "}"), keys).where(F.col("level") == level), F.col("record").isNotNull(), "record")


def known_fields(records: DataFrame, schema: T.StructType = RAW_EVENT, record: str = "record") -> DataFrame:
    """VARIANT records as columns of ``schema``, and every other key in the map ``extra``.

    Nested values are in ``extra`` as JSON text. Further columns of ``records`` stay.
    """
    text = F.col("_text")
    known = F.array(*[F.lit(n) for n in schema.names])
    rest = F.map_filter(F.from_json(text, "map<string,string>"), lambda k, _: ~F.array_contains(known, k))
    others = [c for c in records.columns if c not in (record, *schema.names, "extra")]
    return records.withColumn("_text", F.to_json(record)).withColumn("_row", F.from_json(text, schema)).withColumn("_extra", rest).select(
        *others, "_row.*", F.col("_extra").alias("extra"))


def read_json_array(spark: SparkSession, path, schema: T.StructType = RAW_EVENT) -> DataFrame:
    """Root array: one row per element that is an object, keys outside ``schema`` in ``extra``.

    ``read_json_documents`` has the other elements as rejects.
    """
    return known_fields(_objects(spark, path, (), 1), schema)


def read_json_wrapped(spark: SparkSession, path, field: str, schema: T.StructType = RAW_EVENT) -> DataFrame:
    """Root object whose ``field`` ("events" or "data") holds the array."""
    return known_fields(_objects(spark, path, (field,), 2), schema)


def read_json_object(spark: SparkSession, path, schema: T.StructType = RAW_EVENT) -> DataFrame:
    """Any other root object: one row."""
    return known_fields(_objects(spark, path, (), 0), schema)


def read_json_documents(spark: SparkSession, path, largest: int = LARGEST_RECORD) -> tuple[DataFrame, DataFrame]:
    """(records, rejects) of documents of any form: a list under one of ``WRAPPERS``, a list, or one event.

    Records are VARIANT objects with their file and place in it. Rejects have file, line (the beginning) and
    reason: files that hold neither list nor object, elements that are no objects, that are broken, that have more
    than ``largest`` bytes, or in which the document ends.
    """
    return parse_documents(pieces(spark, path, "}"), largest)


def parse_documents(read: DataFrame, largest: int = LARGEST_RECORD) -> tuple[DataFrame, DataFrame]:
    """As ``read_json_documents``, from the documents' pieces up to ``}``."""
    read = _parsed(read, WRAPPERS, largest)
    return (
        rows_where(read, F.col("record").isNotNull(), "place", "record", "file"),
        read.where(F.col("record").isNull()).select("file", F.substring("text", 1, SHOWN).alias("line"),
                                                    F.coalesce("problem", F.lit("not a JSON object")).alias("reason")),
    )


def read_telemetry(spark: SparkSession, path) -> DataFrame:
    """Telemetry documents as VARIANT records, one per event.

    The root may be a list, an object with ``telemetry``, ``telemetry_events`` or ``events``, or one event.
    """
    return read_json_documents(spark, path)[0].select("record")


def tolerant_lines(text: DataFrame) -> DataFrame:
    """Trim, skip blanks and lone brackets, drop one trailing comma, parse to VARIANT.

    ``record`` is null for lines that do not parse.
    """
    line = strip(F.col("value"))
    kept = text.withColumn("line", line).filter((line != "") & ~line.isin(C.BRACKET_LINES))
    kept = kept.withColumn("line", F.regexp_replace("line", ",$", "")).withColumn("_boxed", boxed_json(F.col("line")))
    return kept.withColumn("record", only_value(F.col("_boxed"))).drop("_boxed")


def read_json_lines(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    """(records, rejects): parsed lines with file and place, and the lines that were not JSON with their file."""
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("place"))
    return parse_lines(text)


def parse_lines(text: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As ``read_json_lines``, from lines (``value``) with file and place."""
    lines = tolerant_lines(text)
    return (
        rows_where(lines, F.col("record").isNotNull(), "line", "record", "file", "place"),
        lines.filter(F.col("record").isNull()).select("line", "file"),
    )


def typed(records: DataFrame, schema: T.StructType = RAW_EVENT) -> DataFrame:
    """Known fields of parsed lines as columns, the others in ``extra``."""
    return known_fields(records.select("record"), schema)


def explode_process_events(processes: DataFrame) -> DataFrame:
    """Process header on each of its events; the event itself as JSON text, missing texts empty."""

    def text(column: Column | str) -> Column:
        return F.coalesce(column, F.lit(""))

    header = [c for c in processes.columns if c not in ("events", "start_time", "last_update")]
    one = processes.withColumn("event", F.explode("events"))
    return one.select(
        *header, text("start_time").alias("start_time"), text("last_update").alias("last_update"),
        text("event.event_type").alias("event_type"), text("event.timestamp").alias("timestamp"),
        F.to_json("event").alias("event_data"))


def read_processes(spark: SparkSession, path) -> DataFrame:
    """Exported process records, one JSON object per line."""
    return explode_process_events(spark.read.schema(PROCESS).json(path))
