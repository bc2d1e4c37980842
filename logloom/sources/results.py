"""Writing events and results, and reading results back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import RESULT
from .files import arrow_opens, list_tree
from .units import documents

CHUNKS_PER_FOLDER = 100_000


def write_events(events: DataFrame, path: str, max_records: int = 1_000_000, mode: str = "errorifexists") -> None:
    """Normalised events as Parquet by day. Rows of a day stay spread over the tasks that hold
    them, so one busy day is many files and never one task."""
    events.withColumn("event_date", F.to_date("timestamp")).write.mode(mode).option(
        "maxRecordsPerFile", max_records).partitionBy("event_date").parquet(path)


def write_chunk_results(results: DataFrame, path: str, mode: str = "append") -> None:
    """One JSON line per chunk, in folders of many chunks each (a folder per chunk would be too many)."""
    results.withColumn("chunk_group", F.floor(F.col("chunk_idx") / F.lit(CHUNKS_PER_FOLDER))).write.mode(mode).partitionBy(
        "chunk_group").json(path)


def write_aggregate(result: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The combined result as JSON lines."""
    result.write.mode(mode).json(path)


def _parsed(text: Column) -> Column:
    """The results of a document as rows, as Spark's reader has them: one, or those of an array; a broken document is one null."""
    many = F.from_json(text, T.ArrayType(RESULT))
    broken = F.array(F.lit(None).cast(RESULT))
    return F.when(
        text.rlike(r"^[ \t\r\n]*\["), F.when(many.isNull() | F.exists(many, lambda r: r.isNull()), broken).otherwise(many)
    ).otherwise(F.array(F.from_json(text, RESULT)))


def load_results(spark: SparkSession, path: str) -> DataFrame:
    """Stored results by precedence: the aggregate, else the newest full analysis, else all
    chunk results with their number. ``source_chunk`` counts chunk results from 0 in that order.

    Chunk results are listed and read by tasks, so the driver holds no file name. A file that isn't text is a broken one."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    rank = (
        F.when(name == "aggregated_results.json", 1)
        .when(name.rlike(r"^analysis_results_.*\.json$"), 2)
        .when(name.rlike(r"^chunk_result_.*\.json$"), 3))
    ranked = list_tree(spark, path).withColumn("rank", rank).filter(F.col("rank").isNotNull())
    best = ranked.groupBy("rank").agg(F.max_by("path", "modification_time").alias("newest")).orderBy("rank").first()
    if best is None:
        raise FileNotFoundError(f"no results found in {path}")
    reader = spark.read.schema(RESULT).option("multiLine", True)
    if best["rank"] < 3:
        return reader.json(best["newest"]).withColumn("source_chunk", F.lit(None).cast("long"))
    if not arrow_opens(best["newest"]):
        chunks = reader.option("pathGlobFilter", "chunk_result_*.json").option("recursiveFileLookup", True).json(path)
        chunks = chunks.withColumn("path", F.col("_metadata.file_name"))
    else:
        texts = documents(ranked.where(F.col("rank") == 3).select("path", "length"))
        # A blank file has no result.
        texts = texts.where(~F.coalesce(F.col("text").rlike(r"^[ \t\r\n]*$"), F.lit(False)))
        chunks = texts.select("path", F.explode(_parsed(F.col("text"))).alias("r")).select("path", "r.*")
    number = F.regexp_extract("path", r"_(\d+)\.json$", 1).cast("long")
    return chunks.select(*RESULT.names, (number - 1).alias("source_chunk"))


def result_threats(results: DataFrame) -> DataFrame:
    """Threat rows of loaded results with their chunk."""
    return results.select("source_chunk", F.posexplode("identified_threats").alias("pos", "t")).select(
        "source_chunk", "pos", "t.*")
