"""Event statistics and resource samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import with_ordinal


def event_frequency(events: DataFrame, column: str = "timestamp") -> DataFrame:
    """Counts per bin, empty bins included; the bin follows the span of the data.

    Under an hour: minutes. Under a day: hours. Else days. The bins come from the span, so
    there are at most 60, 24 or one per calendar day.
    """
    at = F.col(column)
    span = events.agg(F.min(at).alias("lo"), F.max(at).alias("hi"))
    seconds = F.timestamp_diff("SECOND", F.col("lo"), F.col("hi"))
    unit = F.when(seconds < 3600, "minute").when(seconds < 86400, "hour").otherwise("day")
    span = span.select(unit.alias("unit"), "lo", "hi").filter(F.col("lo").isNotNull())
    chosen = span.select("unit").scalar()

    def floor(ts):
        return (
            F.when(chosen == "minute", F.date_trunc("minute", ts))
            .when(chosen == "hour", F.date_trunc("hour", ts))
            .otherwise(F.date_trunc("day", ts))
        )

    step = (
        F.when(F.col("unit") == "minute", F.expr("INTERVAL '1' MINUTE"))
        .when(F.col("unit") == "hour", F.expr("INTERVAL '1' HOUR"))
        .otherwise(F.expr("INTERVAL '1' DAY"))
    )
    bins = span.select(F.explode(F.sequence(floor(F.col("lo")), floor(F.col("hi")), step)).alias("bin"))
    counts = events.groupBy(floor(at).alias("bin")).agg(F.count("*").alias("n"))
    return bins.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def event_type_distribution(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type")


def resource_summary(samples: DataFrame) -> DataFrame:
    """Extremes and means of CPU and memory, and the moment of the first memory peak."""
    peak = F.min_by(F.struct("timestamp", "tag"), F.struct(-F.col("memory_percent"), F.col("timestamp")))
    measures = []
    for column in ("cpu_percent", "memory_percent", "memory_used_gb"):
        measures += [
            F.min(column).alias(f"{column}_min"), F.max(column).alias(f"{column}_max"), F.avg(column).alias(f"{column}_mean")]
    return samples.agg(
        *measures, peak.alias("peak"), F.count("*").alias("measurement_count"),
        F.min("timestamp").alias("first_measurement"), F.max("timestamp").alias("last_measurement"),
    ).select(
        *[c for m in ("cpu_percent", "memory_percent", "memory_used_gb") for c in (f"{m}_min", f"{m}_max", f"{m}_mean")],
        F.col("peak.timestamp").alias("peak_timestamp"), F.col("peak.tag").alias("peak_tag"),
        "measurement_count", "first_measurement", "last_measurement")


def gpu_summary(samples: DataFrame) -> DataFrame:
    """Per GPU: extremes and means of its percentages and of its absolute memory."""
    gpus = samples.select(F.explode("gpu_info").alias("gpu_id", "gpu"))
    measures = []
    for column in ("memory_used_percent", "utilization_percent", "memory_allocated_mb", "memory_reserved_mb"):
        value = F.col(f"gpu.{column}")
        measures += [F.min(value).alias(f"{column}_min"), F.max(value).alias(f"{column}_max"),
                     F.avg(value).alias(f"{column}_mean")]
    return gpus.groupBy("gpu_id").agg(F.max("gpu.name").alias("name"), *measures)


def stage_times(samples: DataFrame) -> DataFrame:
    """Seconds between an ``x_start`` sample and the ``_end`` sample right after it.

    Neighbours are found by position (an equi-join), not by one window over all samples.
    A stage measured again keeps its last value.
    """
    ordered = with_ordinal(samples.select("timestamp", "tag"), ["timestamp", "tag"])
    starts = ordered.filter(F.col("tag").endswith("_start")).select(
        F.col("ord") + 1, F.col("tag"), F.col("timestamp")).toDF("ord", "start_tag", "started")
    ends = ordered.filter(F.col("tag").endswith("_end")).select("ord", F.col("timestamp").alias("ended"))
    stage_name = F.regexp_replace("start_tag", "_[^_]*$", "")
    micros = F.timestamp_diff("MICROSECOND", F.col("started"), F.col("ended"))
    pairs = starts.join(ends, "ord").select(stage_name.alias("stage"), (micros / 1e6).alias("seconds"), "ord")
    return pairs.filter(F.col("stage") != "").groupBy("stage").agg(F.max_by("seconds", "ord").alias("seconds"))
