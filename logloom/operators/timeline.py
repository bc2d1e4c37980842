"""Which events the findings name, and by which findings.

Two tables, of one shape at every size: events with the number of findings that name them, and the
links between events and findings, one row each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import event_description
from .filters import relevant_events
from .ordering import with_ordinal


def event_index(links: DataFrame, id_column: str) -> DataFrame:
    """Inverted index: one row per event and finding."""
    return links.select("event_id", id_column).distinct()


def timeline_links(threat_links: DataFrame, pattern_links: DataFrame) -> DataFrame:
    """``event_id``, ``kind`` (threat or pattern), ``finding_id``: every finding of every event."""
    kinds = ((threat_links, "threat"), (pattern_links, "pattern"))
    threats, patterns = (event_index(links, f"{kind}_id").select(
        "event_id", F.lit(kind).alias("kind"), F.col(f"{kind}_id").alias("finding_id")) for links, kind in kinds)
    return threats.unionByName(patterns)


def timeline(events: DataFrame, threat_links: DataFrame, pattern_links: DataFrame) -> DataFrame:
    """One row per event that a finding names, with the numbers of its threats and patterns."""
    named = timeline_links(threat_links, pattern_links).groupBy("event_id").agg(
        F.count_if(F.col("kind") == "threat").alias("threat_count"), F.count_if(F.col("kind") == "pattern").alias("pattern_count"))
    blank = F.lit("")
    return events.join(named, "event_id").select(
        "event_id",
        "timestamp",
        F.coalesce("event_type", F.lit("unknown")).alias("event_type"),
        event_description(F.col("process_name"), F.col("command_line")).alias("description"),
        F.coalesce("hostname", blank).alias("hostname"),
        F.coalesce("username", blank).alias("username"),
        F.coalesce("severity", F.lit(0)).alias("severity"),
        "threat_count",
        "pattern_count",
    )


def timeline_position(timeline_rows: DataFrame) -> DataFrame:
    """Sequential position on the time axis."""
    return with_ordinal(timeline_rows, ["timestamp", "event_id"], "y_pos")


def timeline_head(timeline_rows: DataFrame, n: int = 10) -> DataFrame:
    """First rows by time, each with the number of rows left out."""
    total = timeline_rows.select(F.count("*")).scalar()
    head = timeline_rows.orderBy("timestamp", "event_id").limit(n)
    return head.withColumn("remaining", F.greatest(total - n, F.lit(0)))


def most_significant(timeline_rows: DataFrame, n: int) -> DataFrame:
    return timeline_rows.orderBy(F.desc("severity"), "timestamp", "event_id").limit(n)


__all__ = ["event_index", "timeline", "timeline_head", "timeline_links", "timeline_position", "most_significant", "relevant_events"]
