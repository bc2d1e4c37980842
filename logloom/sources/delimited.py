"""CSV and Parquet sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordering import with_ordinal
from ..schemas import FLOW
from ..workspace import stage
from .cutting import csv_heads, csv_records, pieces
from .json_logs import read_json_array


def read_csv(spark: SparkSession, path, schema: T.StructType) -> DataFrame:
    """Headered CSV with a given schema; malformed and empty values become null, a header that differs is an error."""
    rows, heads, _ = _by_position(pieces(spark, path, "\n"), standard=False)
    other = heads.where(F.col("header") != F.array(*map(F.lit, schema.names))).select("file", "header").first()
    if other is not None:
        raise ValueError(f"{other['file']} has the names {other['header']} where {schema.names} are expected")
    return _or_fail(rows).select(*[F.nullif(F.get("values", F.lit(i)), F.lit("")).try_cast(f.dataType).alias(f.name) for i, f in enumerate(schema.fields)])


def read_csv_by_header(spark: SparkSession, path) -> DataFrame:
    """Headered CSV files as text columns by name, whatever columns and order each file has.

    Values may hold line breaks inside quotes. Empty values and those that a short row lacks are null; a row with
    more values than names is an error.
    """
    rows, heads, names = _by_position(pieces(spark, path, "\n"))
    return _or_fail(rows).select(*_columns(heads, names))


def parse_csv(read: DataFrame, first: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of lines: as ``read_csv_by_header``, each row with its ``file`` and ``place``; nothing is an error.

    Rejects have file, line and reason: rows with more or fewer values than names, records that are too large or
    whose quote never closes, and the records of files without a header. ``first`` are the first lines of each file,
    where they can be had without reading them all.
    """
    rows, heads, names = _by_position(read, first)
    said = F.concat(F.size("values"), F.lit(" values under "), F.size("header"), F.lit(" names"))
    reason = F.coalesce("problem", F.when(F.col("header").isNull(), "no header").when(F.size("values") != F.size("header"), said))
    judged = rows.withColumn("reason", reason)
    own = [c.alias("_" + n if n in ("file", "place") else n) for c, n in zip(_columns(heads, names), names, strict=True)]
    good = judged.where("reason is null").select("file", "place", *own)
    return good, judged.where("reason is not null").select("file", F.col("text").alias("line"), "reason")


def _by_position(read: DataFrame, first: DataFrame | None = None, standard: bool = True) -> tuple[DataFrame, DataFrame, list[str]]:
    """Records with their file's ``header`` and ``order`` (per name, its places there), the table of headers, and all names.

    The names of all files reach the driver, which needs them for the schema; files and headers don't.
    """
    heads = csv_heads(read if first is None else first)
    name = lambda n, i: F.when(n == "", F.concat(F.lit("_c"), i)).otherwise(F.lower(F.replace(n, F.lit(" "), F.lit("_"))) if standard else n)
    heads = heads.withColumn("header", F.transform("header", name))
    heads = stage(heads, "csv-heads")
    seen = heads.select(F.posexplode("header").alias("at", "name")).groupBy("name").agg(F.min("at").alias("at")).orderBy("at", "name").collect()
    if not seen:
        raise ValueError("no csv file with a header")
    names = [r["name"] for r in seen]
    places = F.transform(F.array(*map(F.lit, names)), lambda n: F.filter(
        F.transform("header", lambda h, i: F.when(h == n, i)), lambda i: i.isNotNull()))
    ordered = heads.select("file", F.col("place").alias("head"), "header", places.alias("order"))
    rows = csv_records(read).join(ordered, "file", "left")
    return rows.where(F.col("head").isNull() | (F.col("place") != F.col("head"))), ordered, names


def _value(place: int, most: int) -> Column:
    """The first value present under the name at ``place``; a file has it ``most`` times at most."""
    at = F.get("order", F.lit(place))
    found = [F.nullif(F.get("values", F.get(at, F.lit(k))), F.lit("")) for k in range(most)]
    return found[0] if most == 1 else F.coalesce(*found)


def _columns(heads: DataFrame, names: list[str]) -> list[Column]:
    most = heads.select(F.max(F.array_max(F.transform("order", lambda o: F.size(o))))).first()[0] or 1
    return [_value(i, most).alias(n) for i, n in enumerate(names)]


def _or_fail(rows: DataFrame) -> DataFrame:
    problem = F.coalesce("problem", F.when(F.col("header").isNull(), "no header"), F.when(F.size("values") > F.size("header"), "more values than names"))
    said = F.concat(F.col("file"), F.lit(", byte "), F.col("place"), F.lit(": "), problem)
    return rows.where(F.when(problem.isNotNull(), F.raise_error(said).cast("boolean")).otherwise(True))


def read_flows(spark: SparkSession, path, start: Column) -> DataFrame:
    """Headerless ``source,destination,action`` rows with ids ``evt-1``.. and one-second times.

    File order is (file, block, row in the block), which gives the same number on every run.
    """
    rows = spark.read.schema(FLOW).csv(path)
    placed = rows.select(
        *FLOW.names, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"))
    numbered = with_ordinal(placed, ["_file", "_block", "_row"])
    second = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("ord"))
    return numbered.select(
        *FLOW.names, F.concat(F.lit("evt-"), F.col("ord") + 1).alias("event_id"), (start + second).alias("timestamp"))


def read_parquet(spark: SparkSession, path) -> DataFrame:
    return spark.read.parquet(path)


def read_directory(spark: SparkSession, path: str, kind: str, schema: T.StructType, max_events: int | None = None) -> DataFrame:
    """All ``*.json`` (root arrays) or ``*.csv`` files of a directory, by time, capped on request."""
    if kind == "json":
        rows = read_json_array(spark, f"{path.rstrip('/')}/*.json", schema)
    elif kind == "csv":
        named = read_csv_by_header(spark, f"{path.rstrip('/')}/*.csv")
        rows = named.select(*[
            (F.col(f.name).try_cast(f.dataType) if f.name in named.columns else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in schema.fields])
    else:
        raise ValueError(f"unsupported log format: {kind}")
    ordered = rows.orderBy("timestamp", "event_id")
    return ordered if max_events is None else ordered.limit(max_events)
