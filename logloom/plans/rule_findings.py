"""A declarative scorer: findings of every chunk by rules, and the replies that would carry them.

It stands in for a model in tests, benchmarks and offline runs. A table is written once per application,
when the first query needs it; every later query reads it.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..operators import chains, findings
from ..operators.detectors import COMMAND_RULES, PERSISTENCE_COMMANDS, PERSISTENCE_KEYS, is_private
from ..operators.ordering import overlapping_chunks, with_ordinal
from ..workspace import once, stage
from .adapter import event_name, shape_events


class Findings:
    """Findings of the events of ``sf_dir``. Each table is built and written when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.chunked = chunked_events(spark, sf_dir)

    @cached_property
    def _hits(self) -> DataFrame:
        return stage(rule_hits(self.chunked), "hits")

    @cached_property
    def raw_threats(self) -> DataFrame:
        return stage(rule_threats(self._hits), "raw-findings")

    @cached_property
    def raw_links(self) -> DataFrame:
        return stage(rule_links(self._hits, self.raw_threats), "raw-findings")

    @cached_property
    def _pattern_groups(self) -> DataFrame:
        return stage(pattern_groups(self.chunked), "pattern-groups")

    @cached_property
    def raw_patterns(self) -> DataFrame:
        return rule_patterns(self._pattern_groups)

    @cached_property
    def raw_pattern_links(self) -> DataFrame:
        return stage(rule_pattern_links(self.chunked, self._pattern_groups), "raw-findings")

    @cached_property
    def threats(self) -> DataFrame:
        return stage(findings.combine_threats(self.raw_threats), "threats")

    @cached_property
    def links(self) -> DataFrame:
        return stage(findings.links_of(self.threats, self.raw_links, "threat_id"), "links")

    @cached_property
    def patterns(self) -> DataFrame:
        return stage(findings.combine_patterns(self.raw_patterns), "patterns")

    @cached_property
    def pattern_links(self) -> DataFrame:
        return stage(findings.links_of(self.patterns, self.raw_pattern_links, "pattern_id"), "links")


class Chains:
    """Attack chains of ``found``, table by table as ``Findings``."""

    def __init__(self, found: Findings):
        self.found = found

    @cached_property
    def members(self) -> DataFrame:
        assignment = stage(chains.assign_chains(self.found.threats, self.found.links), "assignment")
        return stage(chains.chain_threats(assignment, self.found.threats, chains.number_chains(assignment)), "members")

    @cached_property
    def events(self) -> DataFrame:
        return stage(chains.chain_events(self.members, self.found.links), "chain-events")

    @cached_property
    def patterns(self) -> DataFrame:
        return stage(chains.chain_patterns(self.events, self.found.pattern_links), "chain-patterns")

    @cached_property
    def headers(self) -> DataFrame:
        return stage(chains.chain_headers(self.members, self.events, self.patterns), "chains")


_KEYS = ["chunk_idx", "rule", "threat_type", "key"]


def _rules() -> Column:
    """(rule, threat_type, key) entries that an event matches."""
    line, registry = F.coalesce("command_line", F.lit("")), F.coalesce("registry_key", F.lit(""))
    suspicious = F.lit(False)
    for _, pattern in COMMAND_RULES:
        suspicious = suspicious | line.rlike(pattern)
    failed = F.col("event_type").isin("alert", "blocked")
    outbound = (F.col("event_type") == "netconn") & ~is_private(F.col("destination"))
    persistent = line.rlike(PERSISTENCE_COMMANDS) | registry.rlike(PERSISTENCE_KEYS)
    host = F.col("hostname")
    table = [
        (failed, 1, "Failed Activity", host),
        (outbound, 2, "Outbound Connection", host),
        (suspicious, 3, "Suspicious Execution", host),
        (persistent, 4, "Persistence", host),
        (failed, 5, "Noisy Process", F.col("process_name")),
    ]
    entries = [
        F.when(test, F.struct(F.lit(n).alias("rule"), F.lit(kind).alias("threat_type"), key.alias("key")))
        for test, n, kind, key in table
    ]
    return F.filter(F.array(*entries), lambda e: e.isNotNull())


def rule_hits(chunked: DataFrame) -> DataFrame:
    """One row per event of a chunk and rule that it matches."""
    return chunked.select("chunk_idx", "ord", "event_id", F.inline(_rules()))


def rule_threats(hits: DataFrame) -> DataFrame:
    """Threats per (chunk, rule, key), numbered inside the chunk."""
    groups = hits.groupBy(*_KEYS).agg(
        F.count("*").alias("n"), F.min_by("event_id", "ord").alias("first_event")).filter(
        (F.col("rule") != 5) | (F.col("n") >= 2))
    # A chunk is bounded, so is this window.
    inside = Window.partitionBy("chunk_idx").orderBy("rule", "key")
    numbered = groups.withColumn("pos", F.row_number().over(inside) - 1)
    rule, n = F.col("rule"), F.col("n")
    chunk_no = F.col("chunk_idx") + 1
    threat_id = (
        F.when((rule == 2) & (n == 1), "")
        .when(rule == 1, F.concat(F.lit("THREAT-"), "key", F.lit("-"), "first_event"))
        .otherwise(F.concat(F.lit("THREAT-"), chunk_no, F.lit("-"), F.col("pos") + 1)))
    severity = (
        F.when((rule == 4) & (n == 1), None).when(n >= 3, "Critical").when((n == 2) | (rule == 3), "High")
        .when(rule == 2, "Medium").otherwise("Low"))
    confidence = (
        F.when(rule == 1, F.when(n >= 2, "High").otherwise("Medium")).when(rule == 2, "Low").when(rule == 3, "High")
        .when(rule == 5, "Medium"))
    remark = F.when(rule == 3, " with a command line that hides its window or carries an encoded payload").otherwise("")
    description = F.concat(
        "threat_type", F.lit(" on "), "key", F.lit(", "), n, F.lit(" event(s) from "), "first_event", remark,
        F.lit(". Slice "), chunk_no, F.lit("."))
    return numbered.select(
        "chunk_idx", "pos", threat_id.alias("threat_id"), "threat_type", severity.alias("severity"),
        confidence.alias("confidence"), description.alias("description"), "rule", "key", "n")


def rule_links(hits: DataFrame, threats: DataFrame) -> DataFrame:
    """Events of the threats of ``rule_threats``."""
    return hits.join(threats.select(*_KEYS, "pos"), _KEYS).select("chunk_idx", "pos", "ord", "event_id")


def pattern_groups(chunked: DataFrame) -> DataFrame:
    """Destinations met at least twice in a chunk, numbered inside it."""
    groups = chunked.groupBy("chunk_idx", "destination").agg(F.count("*").alias("n")).filter(F.col("n") >= 2)
    inside = Window.partitionBy("chunk_idx").orderBy("destination")
    return groups.withColumn("pos", F.row_number().over(inside) - 1)


def rule_patterns(numbered: DataFrame) -> DataFrame:
    kind = F.when(is_private(F.col("destination")), "Repeated internal contact").otherwise("Repeated outbound contact")
    return numbered.select(
        "chunk_idx", "pos",
        F.concat(F.lit("PATTERN-"), F.col("chunk_idx") + 1, F.lit("-"), F.col("pos") + 1).alias("pattern_id"),
        kind.alias("pattern_type"),
        F.concat(F.lit("Destination "), "destination", F.lit(" met "), "n", F.lit(" times.")).alias("description"))


def rule_pattern_links(chunked: DataFrame, numbered: DataFrame) -> DataFrame:
    keys = ["chunk_idx", "destination"]
    return chunked.join(numbered.select(*keys, "pos"), keys).select("chunk_idx", "pos", "ord", "event_id")


def chunked_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered events in overlapping chunks; the ordered table is written once."""
    source = f"{sf_dir}/events.parquet"
    named = lambda: spark.read.parquet(source).withColumn("_name", event_name())
    ordered = once(spark, ("ordered", sf_dir), lambda: with_ordinal(named(), ["ts", "_name"], shape=shape_events), source)
    return overlapping_chunks(ordered, C.CHUNK_SIZE, C.CHUNK_OVERLAP)


def load_findings(spark: SparkSession, sf_dir: str) -> Findings:
    return once(spark, ("findings", sf_dir), lambda: Findings(spark, sf_dir), f"{sf_dir}/events.parquet")


def load_chains(spark: SparkSession, sf_dir: str) -> Chains:
    return once(spark, ("chains", sf_dir), lambda: Chains(load_findings(spark, sf_dir)), f"{sf_dir}/events.parquet")


def rule_replies(f: Findings) -> DataFrame:
    """Reply text per chunk: the rule findings as JSON inside prose. Lists are bounded by the chunk."""
    def listed(df: DataFrame, links: DataFrame, fields: list[str], name: str) -> DataFrame:
        events = links.groupBy("chunk_idx", "pos").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("ord", "event_id"))), lambda e: e["event_id"]).alias("related_events"))
        item = F.struct("pos", F.struct(*fields[:2], "related_events", *fields[2:]).alias("item"))
        return df.join(events, ["chunk_idx", "pos"]).groupBy("chunk_idx").agg(
            F.transform(F.array_sort(F.collect_list(item)), lambda x: x["item"]).alias(name))

    threats = listed(f.raw_threats, f.raw_links,
                     ["threat_id", "threat_type", "severity", "confidence", "description"], "identified_threats")
    patterns = listed(f.raw_patterns, f.raw_pattern_links,
                      ["pattern_id", "pattern_type", "description"], "suspicious_patterns")
    per_host = f.raw_threats.filter(F.col("rule") <= 4).groupBy("chunk_idx", "key").agg(
        F.array_sort(F.collect_set("threat_type")).alias("techniques")).filter(F.size("techniques") >= 2)
    inside = Window.partitionBy("chunk_idx").orderBy("key")
    chain = F.struct(
        F.concat(F.lit("CHAIN-"), F.col("chunk_idx") + 1, F.lit("-"), F.row_number().over(inside)).alias("chain_id"),
        F.concat(F.lit("Several stages on "), "key").alias("description"), F.lit("Medium").alias("severity"), "techniques")
    proposed = per_host.select("chunk_idx", chain.alias("c")).groupBy("chunk_idx").agg(
        F.array_sort(F.collect_list("c")).alias("potential_attack_chains"))
    advice = f.raw_threats.groupBy("chunk_idx").agg(
        F.array_sort(F.collect_set(F.concat(F.lit("Review "), "threat_type"))).alias("recommendations"))
    sizes = f.chunked.groupBy("chunk_idx").agg(F.count("*").alias("events"))
    joined = sizes
    for part in (threats, patterns, proposed, advice):
        joined = joined.join(part, "chunk_idx", "left")
    body = F.to_json(F.struct(
        "identified_threats", "suspicious_patterns", "potential_attack_chains", "recommendations",
        F.array(F.concat(F.lit("Context limited to "), "events", F.lit(" events"))).alias("limitations")))
    text = F.concat(F.lit("Slice "), F.col("chunk_idx") + 1, F.lit(" reviewed:\n```json\n"), body, F.lit("\n```\nEnd of reply."))
    return joined.select("chunk_idx", text.alias("reply"), F.lit(None).cast("string").alias("error"))


def load_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The replies, written before anything reads them."""
    return once(spark, ("replies", sf_dir), lambda: stage(rule_replies(load_findings(spark, sf_dir)), "replies"),
                f"{sf_dir}/events.parquet")
