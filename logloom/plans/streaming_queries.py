"""Streaming queries over the event table, run to the end of the available input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import jobs
from ..workspace import new_path
from .adapter import load_events, shape_events
from .catalog import query, stamp, stamp_sql
from .detector_queries import DET_SEQUENCE_SQL, SEQUENCE_LIMIT, attack_stages

DELAY = "1 hour"
# The last watermark is the newest event time less the delay; later windows stay open.
_MARK = """(SELECT max("timestamp") FROM ev) - INTERVAL 1 HOUR"""


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = jobs.ingest(spark, sf_dir, schema, "parquet", glob="events.parquet")
    shaped = shape_events(raw)
    return shaped.withColumn("timestamp", F.col("timestamp").cast("timestamp"))


def _finish(stream: DataFrame, label: str, rocksdb: bool = False) -> DataFrame:
    spark = stream.sparkSession
    path = new_path(spark, label)
    jobs.run_to_files(stream, path, new_path(spark, f"{label}-state"), rocksdb=rocksdb)
    return spark.read.schema(stream.schema).parquet(path)


@query("stream_ingest", f"""SELECT event_id, event_type, {stamp_sql('"timestamp"')} AS timestamp_text FROM ev""", "ev")
def stream_ingest(spark, sf_dir):
    return _finish(_stream(spark, sf_dir).select("event_id", "event_type", "timestamp"), "ingest").select(
        "event_id", "event_type", stamp("timestamp").alias("timestamp_text"))


@query("stream_event_frequency", f"""SELECT {stamp_sql('bin')} AS bin_text, n FROM (
    SELECT date_trunc('hour', "timestamp") AS bin, count(*) AS n FROM ev GROUP BY 1) WHERE bin + INTERVAL 1 HOUR <= {_MARK}""", "ev")
def stream_event_frequency(spark, sf_dir):
    counts = jobs.event_frequency(_stream(spark, sf_dir).select("timestamp"), "1 hour", DELAY)
    return _finish(counts, "frequency").select(stamp("bin").alias("bin_text"), "n")


@query("stream_dedup", "SELECT event_id, hostname FROM ev", "ev")
def stream_dedup(spark, sf_dir):
    """Every event arrives twice, as it does in the overlap of two chunks."""
    twice = _stream(spark, sf_dir).select("event_id", "hostname", "timestamp", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    return _finish(jobs.deduplicate(twice, DELAY).select("event_id", "hostname"), "dedup")


@query("stream_detect", f"""SELECT 'scan' AS kind, source, strftime(slot, '%Y-%m-%d %H:%M:%S.%f') AS start_text, n AS event_count FROM (
    SELECT source, time_bucket(INTERVAL '6' HOUR, "timestamp", TIMESTAMP '1970-01-01') AS slot, count(DISTINCT destination) AS d, count(*) AS n
    FROM ev GROUP BY ALL) WHERE d >= 5 AND slot + INTERVAL 6 HOUR <= {_MARK}
  UNION ALL SELECT 'burst', source, strftime(lo, '%Y-%m-%d %H:%M:%S.%f'), n FROM (
    SELECT source, min("timestamp") AS lo, max("timestamp") AS hi, count(*) AS n FROM (
      SELECT *, sum(fresh) OVER (PARTITION BY source ORDER BY "timestamp") AS sid FROM (
        SELECT *, CASE WHEN date_diff('microsecond', lag("timestamp") OVER w, "timestamp") < 21600000000 THEN 0 ELSE 1 END AS fresh
        FROM ev WHERE event_type = 'alert' WINDOW w AS (PARTITION BY source ORDER BY "timestamp"))) GROUP BY source, sid)
    WHERE n >= 3 AND hi + INTERVAL 6 HOUR <= (SELECT max("timestamp") FROM ev WHERE event_type = 'alert') - INTERVAL 1 HOUR""", "ev")
def stream_detect(spark, sf_dir):
    events = _stream(spark, sf_dir)
    scans = _finish(jobs.scanning(events, "6 hours", 5, DELAY), "scans").select(
        F.lit("scan").alias("kind"), "source", stamp("slot").alias("start_text"), "event_count")
    bursts = _finish(jobs.failed_bursts(events, F.col("event_type") == "alert", "6 hours", 3, DELAY), "bursts").select(
        F.lit("burst").alias("kind"), "source", stamp("session_start").alias("start_text"), "event_count")
    return scans.union(bursts)


@query("stream_sequence", DET_SEQUENCE_SQL.replace("'SEQ-' || c.hostname || '-' || e1 AS threat_id, ", ""), "ev")
def stream_sequence(spark, sf_dir):
    """The rows of the batch detector: those that the stream emits, and those still open when it ends."""
    found = _finish(jobs.sequences(_stream(spark, sf_dir), attack_stages(), SEQUENCE_LIMIT, DELAY), "sequences", rocksdb=True)
    rest = jobs.finish_sequences(found, load_events(spark, sf_dir), attack_stages(), SEQUENCE_LIMIT, DELAY)
    rows = found.select("hostname", "related_events").unionByName(rest)
    return rows.select("hostname", F.array_join("related_events", ",").alias("related_events"))
