"""Whole analyses built from the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..operators import chains, costs, detectors, evaluation, findings, ordering, reports, scoring, timeline
from ..workspace import stage


def detect_and_rank(events: DataFrame, scan_window: str, scan_minimum: int, burst_gap: int, burst_minimum: int) -> DataFrame:
    """Scans and failure bursts of an event log: which events matter, and how high the risk is."""
    scans = detectors.scanning(events, scan_window, scan_minimum)
    bursts = detectors.failed_burst(events, F.col("event_type") == "alert", burst_gap, burst_minimum)
    columns = ["threat_id", "threat_type", "severity"]
    threats = scans.threats.select(*columns).union(bursts.threats.select(*columns))
    links = scans.links.union(bursts.links)
    risk = reports.risk_assessment(threats).select("overall_risk_level").scalar()
    nothing = links.limit(0).select(F.col("threat_id").alias("pattern_id"), "event_id")
    rows = timeline.timeline(events, links, nothing)
    return rows.select(
        "event_id", "timestamp", "event_type", "description", "hostname", "severity",
        "threat_count", risk.alias("overall_risk_level"))


def analyze(
    events: DataFrame,
    scorer: Callable[[str], str],
    size: int = C.CHUNK_SIZE,
    overlap: int = C.CHUNK_OVERLAP,
    concurrency: int | None = None,
    stored: DataFrame | None = None,
    summarize: Callable[[str], str] | None = None,
) -> dict[str, DataFrame]:
    """The full run: chunk, score, parse, combine, chain, timeline, risk, closing summary.

    ``events`` is a normalised event table. Replies are written before anything reads them, so
    a prompt is scored once whatever happens to the executors later. ``stored`` are the scored
    replies of an earlier run (its ``replies``): chunks that succeeded there are not scored again.
    ``summarize`` answers the prompts of the closing summary, ``scorer`` if it is not given.
    """
    ordered = ordering.with_ordinal(events, ["timestamp", "event_id"])
    chunked = ordering.overlapping_chunks(ordered, size, overlap)
    prompts = scoring.render_prompts(scoring.render_events(chunked, size, overlap))
    if stored is not None:
        prompts = scoring.pending_chunks(prompts, stored)
    scored = stage(scoring.score_chunks(prompts, scorer, concurrency=concurrency), "replies")
    if stored is not None:
        done = stored.filter(F.col("error").isNull()).join(chunked.select("chunk_idx").distinct(), "chunk_idx", "left_semi")
        scored = scored.unionByName(done.select(*scored.columns))
    parsed = stage(scoring.parse_replies(scored), "parsed")
    raw_threats, raw_patterns = scoring.explode_threats(parsed), scoring.explode_patterns(parsed)
    threats = stage(findings.combine_threats(raw_threats), "threats")
    patterns = stage(findings.combine_patterns(raw_patterns), "patterns")

    def linked(kept: DataFrame, raw: DataFrame, id_column: str) -> DataFrame:
        return stage(findings.links_of(kept, scoring.explode_links(raw, id_column).drop(id_column), id_column), "links")

    threat_links = linked(threats, raw_threats, "threat_id")
    pattern_links = linked(patterns, raw_patterns, "pattern_id")
    assignment = stage(chains.assign_chains(threats, threat_links), "assignment")
    members = stage(chains.chain_threats(assignment, threats, chains.number_chains(assignment)), "members")
    chain_events = chains.chain_events(members, threat_links)
    chain_patterns = chains.chain_patterns(chain_events, pattern_links)
    failures = scoring.chunk_failures(chunked, parsed)
    texts = scoring.text_lists(parsed)
    chunk_count: Column = parsed.agg(F.count("*")).scalar()
    headers = stage(chains.chain_headers(members, chain_events, chain_patterns), "chains")
    rows = stage(timeline.timeline(events, threat_links, pattern_links), "timeline")
    limits = findings.distinct_texts(texts, "limitations")
    shared = reports.risk_assessment(threats, chunk_count), patterns.agg(F.count("*")).scalar(), timeline.timeline_head(rows)
    answer = lambda p: scoring.score_chunks(p, summarize or scorer, budget=None)
    parts = stage(answer(scoring.summary_prompt(*shared, scoring.summary_lines(headers, members, limits))), "summary-parts")
    summary = scoring.fold_summaries(parts, scoring.summary_intro(*shared), answer)
    runs = scored.select("chunk_idx", F.col("attempts").cast("long").alias("api_calls"), F.col("tokens").alias("total_tokens"),
                         F.col("seconds").alias("duration_seconds"))
    totals = costs.performance_totals(runs)
    return {
        "replies": scored,
        "summary": scoring.final_summary(summary, threats.agg(F.count("*")).scalar()).drop("chunk_idx"),
        "attack_summary": reports.attack_summary(threats, headers, members),
        "key_indicators": reports.key_indicators(threats, patterns),
        "threats_by_severity": reports.threats_by_severity(threats),
        "chains_by_severity": chains.by_severity(headers),
        "totals": totals,
        "run_metrics": costs.run_metrics(totals, events.agg(F.count("*")).scalar()),
        "threats": threats,
        "patterns": patterns,
        "threat_links": threat_links,
        "pattern_links": pattern_links,
        "chains": headers,
        "chain_members": members,
        "chain_patterns": chain_patterns,
        "proposed_chains": findings.collect_chains(scoring.proposed_chains(parsed)),
        "timeline": rows,
        "timeline_links": timeline.timeline_links(threat_links, pattern_links),
        "risk": reports.risk_assessment(threats, chunk_count),
        "recommendations": findings.distinct_texts(texts, "recommendations"),
        "limitations": limits,
        "failures": failures,
        "run_state": scoring.run_state(failures),
        "performance": runs,
    }


def evaluate(stored_threats: DataFrame, truth: DataFrame) -> dict[str, DataFrame]:
    """How well stored results did: spans, context, similarity, accuracy, memory and the limitation report.

    ``stored_threats`` comes from ``results.result_threats``; a result without a chunk number counts as
    chunk 0. ``truth`` has the column ``type``.
    """
    raw = stage(findings.fill_blank_ids(
        stored_threats.withColumn("chunk_idx", F.coalesce("source_chunk", F.lit(0)).cast("long")).drop("source_chunk"), "threat_id"), "stored")
    raw_links = scoring.explode_links(raw, "threat_id")
    threats = stage(findings.combine_threats(raw), "threats")
    links = stage(findings.links_of(threats, raw_links.drop("threat_id"), "threat_id"), "links")
    assignment = stage(chains.assign_chains(threats, links), "assignment")
    members = stage(chains.chain_threats(assignment, threats, chains.number_chains(assignment)), "members")
    spans = evaluation.threat_span(raw, raw_links)
    chain_spans = stage(evaluation.chain_spans(members), "chain-spans")
    chunks = raw.agg(F.count_distinct("chunk_idx")).scalar()
    context = evaluation.context_window_metrics(spans, chain_spans, chunks)
    similarity = evaluation.chunk_similarity(threats)
    memory = evaluation.memory_metrics(
        chain_spans, members.agg(F.count_distinct("threat_id")).scalar(), threats.agg(F.count_distinct("threat_id")).scalar())
    report = evaluation.limitation_report(
        F.col("limitation_score"), similarity.select("inconsistency_rate").scalar(), memory.select("memory_limitation_score").scalar(), context)
    return {
        "threat_span": spans, "context_window": context, "similarity": similarity, "memory": memory, "limitations": report,
        "types_by_chunk": evaluation.threat_types_by_chunk(threats), "accuracy": evaluation.detection_accuracy(threats, truth),
        "type_sets": evaluation.type_set_operations(threats, truth),
    }
