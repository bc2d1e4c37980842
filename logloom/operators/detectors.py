"""Deterministic detectors over the event table.

Each returns ``Detection(threats, links)``: one header row per threat and one link row per
(threat, event). Threat ids are built from the group key, so links need no list of events.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import stage
from .ordering import exact_quantile, in_stretches

PRIVATE_ADDRESS = r"^(10\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.)"

COMMAND_RULES = [
    ("encoded-command", r"(?i)powershell.*\s-e(nc|ncode|ncodedcommand)?\s"),
    ("hidden-window", r"(?i)\s-w(indowstyle)?\s+hidden"),
    ("credential-dump", r"(?i)comsvcs\.dll.*minidump|lsass"),
]
PERSISTENCE_COMMANDS = r"(?i)(schtasks(\.exe)?\s+/create|sc(\.exe)?\s+create\s|new-service)"
PERSISTENCE_KEYS = r"(?i)\\currentversion\\run(once)?(\\|$)|\\currentcontrolset\\services\\"


class Detection(NamedTuple):
    threats: DataFrame
    links: DataFrame


def is_private(address: Column) -> Column:
    return address.rlike(PRIVATE_ADDRESS)


def _id(prefix: str, *parts: Column) -> Column:
    return F.concat_ws("-", F.lit(prefix), *parts)


def _slot(column: Column) -> Column:
    return F.date_format(column, "yyyyMMddHHmmss")


def _headers(grouped: DataFrame, threat_type: str, severity: Column, confidence: str) -> DataFrame:
    return grouped.withColumns({
        "threat_type": F.lit(threat_type), "severity": severity, "confidence": F.lit(confidence)})


def _fan(events: DataFrame, key: str, other: str, width: str, minimum: int, prefix: str, kind: str) -> Detection:
    """``key`` meeting many distinct ``other`` values in one window.

    The distinct count runs in two steps, (key, window, other) first, so one busy key is
    spread over tasks; a threat's events lie in one window of one key.
    """
    slots = events.withColumn("slot", F.window("timestamp", width)["start"]).withColumn(
        "threat_id", _id(prefix, F.col(key), _slot(F.col("slot"))))
    per_other = slots.groupBy("threat_id", key, "slot", other).agg(F.count("*").alias("n"))
    groups = per_other.groupBy("threat_id", key, "slot").agg(
        F.count("*").alias("distinct_count"), F.sum("n").alias("event_count")).filter(F.col("distinct_count") >= minimum)
    severity = F.when(F.col("distinct_count") >= 2 * minimum, "High").otherwise("Medium")
    links = slots.select("threat_id", "event_id").join(groups.select("threat_id"), "threat_id", "left_semi")
    return Detection(_headers(groups, kind, severity, "Medium"), links)


def scanning(events: DataFrame, width: str = "10 minutes", minimum: int = 20) -> Detection:
    return _fan(events, "source", "destination", width, minimum, "SCAN", "Network Scanning")


def lateral_movement(events: DataFrame, width: str = "10 minutes", minimum: int = 10) -> Detection:
    internal = events.filter(is_private(F.col("source")))
    return _fan(internal, "destination", "source", width, minimum, "LATERAL", "Lateral Movement")


def beaconing(events: DataFrame, max_variation: float = 0.1, min_gaps: int = 10, slice_seconds: int = 300) -> Detection:
    """(source, destination) pairs with regular gaps.

    Gaps are taken inside (pair, time slice) groups; the gap between two slices comes from
    the slice summaries. A pair with a third of all events is thus spread over its slices.
    """
    pair = ["source", "destination"]
    ms = F.unix_micros(F.col("timestamp").cast("timestamp")) / 1000
    timed = events.select(*pair, F.floor(ms).alias("ms")).withColumn(
        "slice", F.floor(F.col("ms") / F.lit(slice_seconds * 1000)))
    inside = Window.partitionBy(*pair, "slice").orderBy("ms")
    gap = F.col("ms") - F.lag("ms").over(inside)
    dec = "decimal(38,0)"
    slices = timed.withColumn("gap", gap).groupBy(*pair, "slice").agg(
        F.count("gap").alias("gaps"), F.sum(F.col("gap").cast(dec)).alias("total"),
        F.sum((F.col("gap").cast("decimal(18,0)") * F.col("gap").cast("decimal(18,0)")).cast(dec)).alias("squares"),
        F.min("ms").alias("first"), F.max("ms").alias("last"), F.count("*").alias("n"))
    across = Window.partitionBy(*pair).orderBy("slice")
    bridge = (F.col("first") - F.lag("last").over(across)).cast("decimal(18,0)")
    zero = F.lit(0).cast(dec)
    pairs = slices.withColumn("bridge", bridge).groupBy(*pair).agg(
        (F.sum("gaps") + F.count("bridge")).alias("gap_count"),
        (F.coalesce(F.sum("total"), zero) + F.coalesce(F.sum("bridge"), zero)).cast("double").alias("total"),
        (F.coalesce(F.sum("squares"), zero)
         + F.coalesce(F.sum((F.col("bridge") * F.col("bridge")).cast(dec)), zero)).cast("double").alias("squares"),
        F.sum("n").alias("event_count"))
    mean = F.col("total") / F.col("gap_count")
    spread = F.sqrt(F.greatest(F.col("squares") / F.col("gap_count") - mean * mean, F.lit(0.0)))
    regular = (
        pairs.filter(F.col("gap_count") >= min_gaps)
        .withColumn("mean_gap_seconds", mean / 1000).withColumn("variation", F.try_divide(spread, mean))
        .filter(F.col("variation") <= max_variation)
        .withColumn("threat_id", _id("BEACON", F.col("source"), F.col("destination"))))
    links = events.join(regular.select(*pair, "threat_id"), pair).select("threat_id", "event_id")
    threats = regular.select("threat_id", *pair, "gap_count", "event_count", "mean_gap_seconds", "variation")
    return Detection(_headers(threats, "C2 Communication", F.lit("High"), "Medium"), links)


def exfiltration(events: DataFrame, width: str = "1 hour", q: float = 0.99) -> Detection:
    """Outbound volume per source and window above the exact ``q`` quantile of all of them."""
    outbound = events.filter(~is_private(F.col("destination"))).withColumn(
        "slot", F.window("timestamp", width)["start"]).withColumn(
        "threat_id", _id("EXFIL", F.col("source"), _slot(F.col("slot"))))
    volume = stage(outbound.groupBy("threat_id", "source", "slot").agg(
        F.sum(F.col("bytes").cast("decimal(18,2)")).cast("double").alias("total_bytes"), F.count("*").alias("event_count")), "volume")
    large = volume.filter(F.col("total_bytes") > exact_quantile(volume, "total_bytes", q))
    links = outbound.select("threat_id", "event_id").join(large.select("threat_id"), "threat_id", "left_semi")
    return Detection(_headers(large, "Data Exfiltration", F.lit("High"), "Low"), links)


def _partial_sessions(events: DataFrame, key: str, gap_seconds: int) -> tuple[DataFrame, DataFrame]:
    """Events with the number of their partial session, and the partial sessions with their ``session_start``.

    Events are dealt to stretches of the order (key, time). Sessions are told apart inside (stretch, key), then
    joined over the partial sessions of a key; of these a stretch adds one at most to the real sessions, so
    their number is bounded by the time span, not by the number of events.
    """
    second = F.unix_micros(F.col("timestamp").cast("timestamp")) / 1e6
    timed = in_stretches(events.withColumn("_t", second), [key, "_t"], "session-events")
    inside = Window.partitionBy("_part", key).orderBy("_t")
    starts = F.coalesce((F.col("_t") - F.lag("_t").over(inside) >= gap_seconds).cast("int"), F.lit(1))
    local = timed.withColumn("_new", starts).withColumn(
        "_local", F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    partial = local.groupBy(key, "_part", "_local").agg(
        F.min("_t").alias("lo"), F.max("_t").alias("hi"), F.min("timestamp").alias("started"),
        F.max("timestamp").alias("ended"), F.count("*").alias("n"))
    across = Window.partitionBy(key).orderBy("lo", "_part")
    opens = F.coalesce(F.col("lo") - F.lag("hi").over(across) >= gap_seconds, F.lit(True))
    named = partial.withColumn("_opened", F.when(opens, F.col("started"))).withColumn(
        "session_start", F.last("_opened", True).over(across.rowsBetween(Window.unboundedPreceding, 0)))
    return local, named


def failed_burst(events: DataFrame, failed: Column, gap_seconds: int = 300, minimum: int = 5) -> Detection:
    """Many failures of one source without a pause.

    Headers come from the partial sessions alone; only the links go back to the events.
    """
    local, named = _partial_sessions(events.filter(failed), "source", gap_seconds)
    marked = named.withColumn("threat_id", _id("BURST", F.col("source"), _slot(F.col("session_start"))))
    groups = marked.groupBy("threat_id", "source", "session_start").agg(
        F.sum("n").alias("event_count"), F.max("ended").alias("session_end")).filter(F.col("event_count") >= minimum)
    severity = F.when(F.col("event_count") >= 2 * minimum, "High").otherwise("Medium")
    parts = marked.join(groups.select("threat_id"), "threat_id", "left_semi").select(
        "source", "_part", "_local", "threat_id")
    links = local.join(parts, ["source", "_part", "_local"]).select("threat_id", "event_id")
    return Detection(_headers(groups, "Repeated Failures", severity, "High"), links)


def rare_values(events: DataFrame, columns: list[str], max_share: float = 0.001) -> Detection:
    """Values of the given columns that make up less than ``max_share`` of their column."""
    listed = F.array(*[F.struct(F.lit(c).alias("attribute"), F.col(c).cast("string").alias("value")) for c in columns])
    values = events.select("event_id", F.inline(listed)).filter(F.col("value").isNotNull())
    counts = values.groupBy("attribute", "value").agg(F.count("*").alias("event_count"))
    totals = counts.groupBy("attribute").agg(F.sum("event_count").alias("total"))
    rare = counts.join(totals, "attribute").withColumn("share", F.col("event_count") / F.col("total")).filter(
        F.col("share") < max_share).withColumn("threat_id", _id("RARE", F.col("attribute"), F.col("value")))
    links = values.join(rare.select("attribute", "value", "threat_id"), ["attribute", "value"]).select(
        "threat_id", "event_id")
    return Detection(_headers(rare.drop("total"), "Unusual Value", F.lit("Low"), "Low"), links)


def ioc_matches(events: DataFrame, indicators: DataFrame, columns: list[str]) -> Detection:
    """Events whose value in one of ``columns`` is a known-bad ``indicator``.

    No broadcast hint: the size of the indicator list is the planner's to check.
    """
    listed = F.array(*[F.col(c).cast("string") for c in columns])
    values = events.select("event_id", F.explode(F.array_distinct(listed)).alias("indicator"))
    hits = values.join(indicators.dropDuplicates(["indicator"]), "indicator").withColumn(
        "threat_id", _id("IOC", F.col("indicator")))
    groups = hits.groupBy("threat_id", "indicator", "ioc_type").agg(F.count_distinct("event_id").alias("event_count"))
    return Detection(_headers(groups, "Known Indicator", F.lit("High"), "High"),
                     hits.select("threat_id", "event_id").distinct())


def sequences(events: DataFrame, stages: list[tuple[str, Column]], limit_seconds: int, host: str = "hostname") -> DataFrame:
    """First-stage events followed by every later stage in order, on one host, within the limit.

    Rows are dealt to stretches of the order (host, time, id). From the last stage but one to the first, each row
    learns the nearest following row of the next stage that has a path to the end: inside its (stretch, host) if there
    is one, else the first in a later stretch of the host. A stretch tells the earlier ones that first path only.
    """
    stage_of = F.coalesce(*[F.when(test, F.lit(i)) for i, (_, test) in enumerate(stages)])
    second = F.unix_micros(F.col("timestamp").cast("timestamp")) / 1e6
    last = len(stages) - 1
    # path: end time and event ids from this row to the last stage
    path = F.when(F.col("stage") == last, F.struct(F.col("t").alias("end"), F.array("event_id").alias("ids")))
    staged = events.select("event_id", F.col(host), "timestamp", stage_of.alias("stage"), second.alias("t")).filter(
        F.col("stage").isNotNull()).withColumn("path", path)
    seen = in_stretches(staged, [host, "t", "event_id"], "sequence-events")
    group = ["_part", host]
    backwards = Window.partitionBy(*group).orderBy(F.desc("t"), F.desc("event_id")).rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(host).orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    for number in range(last - 1, -1, -1):
        found = F.when(F.col("stage") == number + 1, F.col("path"))
        firsts = seen.groupBy(*group).agg(F.min_by(found, F.when(found.isNotNull(), F.struct("t", "event_id"))).alias("first"))
        beyond = firsts.withColumn("_beyond", F.last("first", True).over(later)).select(
            F.col("_part").alias("_p"), F.col(host).alias("_h"), "_beyond")
        nearest = seen.withColumn("_near", F.last(found, True).over(backwards)).join(
            beyond, (F.col("_part") == F.col("_p")) & F.col(host).eqNullSafe(F.col("_h")))
        following = F.coalesce("_near", "_beyond")
        grown = F.when((F.col("stage") == number) & following.isNotNull(),
                       F.struct(following["end"].alias("end"), F.concat(F.array("event_id"), following["ids"]).alias("ids")))
        # Rows of later stages are not asked again.
        seen = stage(nearest.where(F.col("stage") <= number).withColumn("path", grown).select(*seen.columns), "sequence-paths")
    complete = seen.filter((F.col("stage") == 0) & F.col("path").isNotNull() & (F.col("path.end") - F.col("t") <= limit_seconds))
    return complete.select(
        _id("SEQ", F.col(host), F.col("event_id")).alias("threat_id"), host, F.col("timestamp").alias("started"),
        (F.col("path.end") - F.col("t")).alias("seconds"), F.col("path.ids").alias("related_events"))


def _rule_hits(events: DataFrame, hits: Column, prefix: str, kind: str, severity: str) -> Detection:
    """Rows of matched rules, grouped per host and rule; no join with a rule table is needed."""
    matched = events.select("event_id", "hostname", F.explode(F.filter(hits, lambda r: r.isNotNull())).alias("rule")).withColumn(
        "threat_id", _id(prefix, F.col("rule"), F.col("hostname")))
    groups = matched.groupBy("threat_id", "rule", "hostname").agg(F.count("*").alias("event_count"))
    return Detection(_headers(groups, kind, F.lit(severity), "High"), matched.select("threat_id", "event_id"))


def command_lines(events: DataFrame, rules: list[tuple[str, str]] = COMMAND_RULES) -> Detection:
    line = F.coalesce("command_line", F.lit(""))
    hits = F.array(*[F.when(line.rlike(pattern), F.lit(name)) for name, pattern in rules])
    return _rule_hits(events, hits, "CMD", "Suspicious Execution", "High")


def persistence(events: DataFrame) -> Detection:
    line, key = F.coalesce("command_line", F.lit("")), F.coalesce("registry_key", F.lit(""))
    hits = F.array(F.when(line.rlike(PERSISTENCE_COMMANDS), F.lit("command")),
                   F.when(key.rlike(PERSISTENCE_KEYS), F.lit("registry")))
    return _rule_hits(events, hits, "PERSIST", "Persistence", "Medium")
