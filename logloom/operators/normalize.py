"""From a raw table to the event shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C
from ..functions.severity import default_severity, text_severity
from ..functions.times import coerce_timestamp
from .ordering import with_ordinal


def std_columns(df: DataFrame) -> DataFrame:
    """Lower-case names with underscores; columns whose names become equal merge, the first value present wins."""
    merged: dict[str, list[str]] = {}
    for name in df.columns:
        merged.setdefault(name.lower().replace(" ", "_"), []).append(name)
    quoted = lambda name: F.col("`" + name.replace("`", "``") + "`")
    return df.select(*[(quoted(own[0]) if len(own) == 1 else F.coalesce(*map(quoted, own))).alias(name) for name, own in merged.items()])


def require_columns(df: DataFrame) -> DataFrame:
    """``timestamp`` from ``time`` and ``event_type`` from ``type`` where they are missing."""
    for wanted, stand_in in (("timestamp", "time"), ("event_type", "type")):
        if wanted not in df.columns and stand_in in df.columns:
            df = df.withColumn(wanted, F.col(stand_in))
    return df


def parse_timestamps(df: DataFrame, column: str = "timestamp") -> DataFrame:
    """Timestamp column from text (known layouts) or numbers (epoch nanoseconds); bad rows drop out."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.StringType):
        df = df.withColumn(column, coerce_timestamp(F.col(column)))
    elif isinstance(kind, T.NumericType):
        df = df.withColumn(column, F.timestamp_micros((F.col(column) / 1000).cast("long")))
    return df.filter(F.col(column).isNotNull())


def add_default_severity(df: DataFrame) -> DataFrame:
    if "severity" in df.columns:
        return df
    if "event_type" not in df.columns:
        return df.withColumn("severity", F.lit(C.DEFAULT_SEVERITY_OTHER))
    return df.withColumn("severity", default_severity(F.col("event_type")))


def assign_event_id(df: DataFrame, tie_break: list[str] | None = None, first: list[str] | None = None) -> DataFrame:
    """``evt-0``, ``evt-1``, ... in time order, across the whole input, when there is no id.

    Ties go by ``tie_break``, else by all other columns; maps and variants, which have no order, go by
    their JSON text. Without a timestamp column the tie-break alone gives the order.
    """
    if "event_id" in df.columns:
        return df
    first = first or [c for c in ("timestamp",) if c in df.columns]
    ties = tie_break or [c for c in df.columns if c not in first]
    unordered = [c for c in ties if _has_no_order(df.schema[c].dataType)]
    texts = {f"_text_{i}": F.to_json(F.struct(c)) for i, c in enumerate(unordered)}
    names = dict(zip(unordered, texts, strict=True))
    numbered = with_ordinal(df.withColumns(texts) if texts else df, [*first, *(names.get(c, c) for c in ties)]).drop(*texts)
    return numbered.withColumn("event_id", F.concat(F.lit("evt-"), F.col("ord"))).drop("ord")


def _has_no_order(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _has_no_order(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_has_no_order(f.dataType) for f in kind.fields)
    return isinstance(kind, (T.MapType, T.VariantType))


def normalize_events(df: DataFrame, max_events: int | None = None) -> DataFrame:
    """The whole preparation; the event cap applies only on request."""
    df = require_columns(std_columns(df))
    if "timestamp" in df.columns:
        df = parse_timestamps(df)
    df = assign_event_id(add_default_severity(df))
    if max_events is not None:
        df = limit_events(df, max_events)
    return df


def sort_by_time(df: DataFrame) -> DataFrame:
    return df.orderBy("timestamp", "event_id")


def limit_events(df: DataFrame, max_events: int) -> DataFrame:
    return sort_by_time(df).limit(max_events)


def union_sources(*frames: DataFrame) -> DataFrame:
    """Rows of all inputs over the union of their columns."""
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame, allowMissingColumns=True)
    return first


# --- telemetry records held as VARIANT -------------------------------------------------


def _path(name: str) -> str:
    return f"$['{name}']"


def _kind(record: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(record, path, "variant"))


def _scalar(record: Column, path: str) -> Column:
    """Text of a scalar at ``path``; objects and arrays count as absent.

    The kind is looked up only for text that could be an object or an array.
    """
    text = F.try_variant_get(record, path, "string")
    kind = _kind(record, path)
    return F.when(~text.rlike(r"^[\[{]"), text).when(~kind.rlike("^(OBJECT|ARRAY)"), text)


def scalar_texts(record: Column) -> Column:
    """Texts of the scalars of a record by key, all from one pass over it, see ``_scalar``."""
    texts = F.try_variant_get(record, "$", "map<string,string>")
    values = F.try_variant_get(record, "$", "map<string,variant>")
    bracket = lambda text: F.coalesce(text.rlike(r"^[\[{]"), F.lit(False))
    nested = lambda name: F.schema_of_variant(F.try_element_at(values, name)).rlike("^(OBJECT|ARRAY)")
    # Only a text that could be an object or an array asks for the kinds.
    return F.when(F.exists(F.map_values(texts), bracket), F.map_filter(texts, lambda name, text: ~bracket(text) | ~nested(name))).otherwise(texts)


def _first_of(record: Column, names: list[str], texts: Column | None) -> Column:
    return F.coalesce(*[_scalar(record, _path(n)) if texts is None else F.try_element_at(texts, F.lit(n)) for n in names])


def unify_fields(record: Column, texts: Column | None = None) -> dict[str, Column]:
    """Each standard field from the first synonym present; scalars only. ``texts``: a column with the ``scalar_texts``."""
    return {field: _first_of(record, names, texts) for field, names in C.FIELD_SYNONYMS.items()}


def fallback_event_id(record: Column, texts: Column | None = None) -> Column:
    return _first_of(record, C.EVENT_ID_FALLBACKS, texts)


def lift_nested(record: Column, fields: dict[str, Column]) -> dict[str, Column]:
    """``event.type`` and ``process.*`` fill what the flat names left empty."""
    nested = {
        "event_type": "$.event.type",
        "process_name": "$.process.name",
        "process_id": "$.process.pid",
        "command_line": "$.process.command_line",
    }
    return {
        field: F.coalesce(value, _scalar(record, nested[field])) if field in nested else value
        for field, value in fields.items()
    }


def telemetry_severity(record: Column, text: Column) -> Column:
    """Severity words by table; a number in the record stays as it is."""
    worded = F.coalesce(*[_kind(record, _path(name)) for name in C.FIELD_SYNONYMS["severity"]]) == "STRING"
    return F.when(worded, text_severity(text)).otherwise(text.try_cast("int"))


def normalize_telemetry(df: DataFrame, record: str = "record") -> DataFrame:
    """One VARIANT column in, the standard telemetry fields out, all columns kept beside them."""
    source, texts = F.col(record), F.col("_scalars")
    fields = lift_nested(source, unify_fields(source, texts))
    severity = telemetry_severity(source, fields.pop("severity"))
    return df.withColumn("_scalars", scalar_texts(source)).select(
        fallback_event_id(source, texts).alias("event_id"),
        *[value.alias(name) for name, value in fields.items()],
        severity.alias("severity_level"),
        *[F.col(c) for c in df.columns],
    )
