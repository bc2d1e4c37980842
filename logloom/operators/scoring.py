"""Chunk scoring as a batch job: render, prompt, score, parse, explode."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.text import boxed_json, only_value
from ..functions.times import timestamp_text
from ..schemas import FINDINGS, SUMMARY
from ..workspace import stage
from .ordering import with_ordinal

_UNKNOWN = "unknown"


def render_events(chunked: DataFrame, size: int = C.CHUNK_SIZE, overlap: int = C.CHUNK_OVERLAP) -> DataFrame:
    """Text of every chunk. The number of an event follows from its position, and a chunk
    never holds more than ``size`` events, so the per-chunk list is bounded."""
    number = F.col("ord") - F.col("chunk_idx") * F.lit(size - overlap) + 1

    def shown(column: str) -> Column:
        return F.coalesce(F.col(column), F.lit(_UNKNOWN)) if column in chunked.columns else F.lit(_UNKNOWN)

    when = F.coalesce(timestamp_text(F.col("timestamp")), F.lit(_UNKNOWN))
    line = F.format_string(C.EVENT_LAYOUT, number, shown("event_id"), when, shown("source"), shown("destination"), shown("action"))
    lines = chunked.select("chunk_idx", F.struct("ord", line.alias("text")).alias("line"))
    ordered = F.transform(F.array_sort(F.collect_list("line")), lambda x: x["text"])
    grouped = lines.groupBy("chunk_idx").agg(F.count("*").alias("event_count"), F.array_join(ordered, "").alias("body"))
    header = F.format_string(C.EVENTS_HEADER, F.col("event_count"))
    return grouped.select("chunk_idx", "event_count", F.concat(header, "body").alias("events_text"))


PROMPT_HEAD = (
    "Act as a security analyst. Below is one slice of a longer event log, slice number "
)
PROMPT_RULES = (
    "\n\nLook for unknown endpoints, lateral movement, large outbound transfers, regular call-backs, "
    "persistence, known-bad indicators, bursts of failures, odd ports or protocols, staged activity and scans."
    "\nReply with one JSON object. Its keys: identified_threats (threat_id, threat_type, related_events, severity, "
    "confidence, description), suspicious_patterns (pattern_id, pattern_type, related_events, description), "
    "potential_attack_chains (chain_id, description, events, severity, techniques), "
    "risk_assessment (overall_risk_level, reasoning), recommendations, limitations."
    "\nUse High, Medium or Low for severity and confidence. Number ids like "
)


def render_prompts(rendered: DataFrame) -> DataFrame:
    """One prompt per chunk; chunk numbers in the text start at 1."""
    number = F.col("chunk_idx") + 1
    ids = F.concat_ws(", ", *[F.concat(F.lit(f"{kind}-"), number, F.lit("-1")) for kind in ("THREAT", "PATTERN", "CHAIN")])
    prompt = F.concat(F.lit(PROMPT_HEAD), number, F.lit(".\n\n"), F.col("events_text"), F.lit(PROMPT_RULES), ids, F.lit("."))
    return rendered.select("chunk_idx", "event_count", prompt.alias("prompt"))


SCORED = "chunk_idx bigint, reply string, error string, attempts int, seconds double, tokens double"


def score_chunks(
    prompts: DataFrame,
    scorer: Callable[[str], str],
    max_retries: int = C.MAX_RETRIES,
    budget: int | None = C.PROMPT_BUDGET,
    concurrency: int | None = None,
    sleep: Callable[[float], None] = time.sleep,
) -> DataFrame:
    """Call ``scorer`` once per prompt inside the tasks.

    A failing call is tried again after 2^attempt plus a random part of a second; after the
    last try, or for a prompt over the budget, the row carries an error. ``concurrency`` caps
    the calls in flight. Write the result before reading it twice: calls may cost money.
    """

    chars_per_token = C.CHARS_PER_TOKEN

    def answer(prompt: str) -> tuple[str | None, str | None, int]:
        if budget is not None and len(prompt) >= budget:
            return None, f"prompt of {len(prompt)} characters is over the budget", 0
        for attempt in range(max_retries):
            try:
                return scorer(prompt), None, attempt + 1
            except Exception as error:  # any failure of the user's callable becomes a row
                problem = str(error) or type(error).__name__
                if attempt + 1 < max_retries:
                    sleep(2 ** attempt + random.random())
        return None, problem, max_retries

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for chunk, prompt in zip(batch["chunk_idx"], batch["prompt"]):
                started = time.monotonic()
                reply, error, attempts = answer(prompt)
                spent = time.monotonic() - started
                tokens = (len(prompt) + len(reply or "")) / chars_per_token if reply is not None else 0.0
                rows.append((chunk, reply, error, attempts, spent, tokens))
            yield pd.DataFrame(rows, columns=["chunk_idx", "reply", "error", "attempts", "seconds", "tokens"])

    source = prompts.select("chunk_idx", "prompt")
    if concurrency:
        source = source.repartition(concurrency, "chunk_idx")
    return source.mapInPandas(work, SCORED)


def json_slice(reply: Column) -> Column:
    """From the first ``{`` to the last ``}``; empty when there is none in that order."""
    return F.regexp_extract(reply, r"(?s)(\{.*\})", 1)


def parse_replies(scored: DataFrame, schema=FINDINGS, name: str = "findings") -> DataFrame:
    """Structured findings per reply, or the reason why there are none, with the raw text."""
    reply = F.col("reply")
    found = F.col("_found")
    # Columns of their own: slice and parse once for a reply.
    scored = scored.withColumn("_found", json_slice(reply)).withColumn("_boxed", boxed_json(found))
    valid = only_value(F.col("_boxed")).isNotNull()
    missing = ~(F.contains(reply, F.lit("{")) & F.contains(reply, F.lit("}")))
    error = (
        F.when(F.col("error").isNotNull(), F.concat(F.lit("Processing error: "), F.col("error")))
        .when(reply.isNull() | missing, F.lit(C.REPLY_WITHOUT_JSON))
        .when(~valid, F.lit("JSON parsing error"))
    )
    checked = scored.withColumn("parsing_error", error)
    broken = F.col("parsing_error").isNotNull()
    return checked.withColumn(name, F.when(~broken, F.from_json(found, schema))).withColumn(
        "raw_text", F.when(broken, reply)).drop("_found", "_boxed")


def explode_threats(parsed: DataFrame) -> DataFrame:
    return _explode(parsed, "identified_threats")


def explode_patterns(parsed: DataFrame) -> DataFrame:
    return _explode(parsed, "suspicious_patterns")


def _explode(parsed: DataFrame, column: str) -> DataFrame:
    listed = parsed.filter(F.col("parsing_error").isNull()).select(
        "chunk_idx", F.posexplode(f"findings.{column}").alias("pos", "item"))
    return listed.select("chunk_idx", "pos", "item.*")


def explode_links(findings: DataFrame, id_column: str) -> DataFrame:
    """Link rows finding -> event with the place of the event in the finding's list."""
    return findings.select("chunk_idx", "pos", id_column, F.posexplode("related_events").alias("place", "event_id"))


def text_lists(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("parsing_error").isNull()).select(
        "chunk_idx", F.coalesce("findings.recommendations", F.array().cast("array<string>")).alias("recommendations"),
        F.coalesce("findings.limitations", F.array().cast("array<string>")).alias("limitations"))


def proposed_chains(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("parsing_error").isNull()).select(
        "chunk_idx", F.col("findings.potential_attack_chains").alias("potential_attack_chains"))


def chunk_failures(chunks: DataFrame, parsed: DataFrame) -> DataFrame:
    """Every chunk with its state; a failed or missing one has no findings and an unknown risk."""
    outcome = parsed.select(
        "chunk_idx", F.col("parsing_error").alias("why"), F.lit(True).alias("answered"),
        F.size("findings.identified_threats").alias("n"), F.col("findings.risk_assessment.overall_risk_level").alias("risk"))
    joined = chunks.select("chunk_idx").distinct().join(outcome, "chunk_idx", "left")
    error = F.when(F.col("answered").isNull(), F.lit("Processing error: no reply")).otherwise(F.col("why"))
    checked = joined.withColumn("error", error)
    failed = F.col("error").isNotNull()
    return checked.select(
        "chunk_idx", "error", failed.alias("failed"),
        F.when(failed, F.lit(0)).otherwise(F.greatest(F.coalesce("n", F.lit(0)), F.lit(0))).alias("threats"),
        F.when(failed, F.lit("Unknown")).otherwise(F.col("risk")).alias("overall_risk_level"),
        F.when(failed, F.lit("Score the chunk again with other settings or a smaller chunk")).alias("recommendation"))


def run_state(failures: DataFrame) -> DataFrame:
    """One row: how many chunks failed, and whether all of them did."""
    counts = failures.agg(F.count("*").alias("chunks"), F.count_if("failed").alias("failed_chunks"),
                          F.bool_and("failed").alias("all_failed"))
    return counts.withColumn("error", F.when(F.col("all_failed"), F.lit(C.ALL_CHUNKS_FAILED)))


def pending_chunks(chunks: DataFrame, results: DataFrame) -> DataFrame:
    """Chunks without a successful result; failed ones count as pending."""
    done = results.filter(F.col("error").isNull()).select("chunk_idx")
    return chunks.join(done, "chunk_idx", "left_anti")


# --- final summary ---------------------------------------------------------------------

LINES_PER_PROMPT = 200


def summary_lines(chains: DataFrame, members: DataFrame, limitations: DataFrame) -> DataFrame:
    """The open-ended part of the summary prompt as ordered rows: chains, their threats, limitations."""
    from ..functions.severity import severity_rank

    rank = -severity_rank(F.col("severity"))
    head = chains.select(
        F.lit(0).alias("section"), rank.alias("rank"), F.col("chain_no"), F.lit(-1).cast("long").alias("item"),
        F.concat(F.lit("  "), "chain_id", F.lit(" (Severity: "), "severity", F.lit("): "), "threat_count",
                 F.lit(" threats across "), "event_count", F.lit(" events")).alias("text"))
    ranks = chains.select("chain_no", rank.alias("rank"))
    threats = members.join(ranks, "chain_no").select(
        F.lit(0).alias("section"), "rank", "chain_no", F.col("idx").alias("item"),
        F.concat(F.lit("    - Threat: "), F.coalesce("threat_type", F.lit("Unknown")), F.lit(" - "),
                 F.substring(F.coalesce("description", F.lit("")), 1, 100), F.lit("...")).alias("text"))
    limits = limitations.select(
        F.lit(1).alias("section"), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("chain_no"),
        F.lit(0).cast("long").alias("item"), F.concat(F.lit("- "), "text").alias("text"))
    return head.unionByName(threats).unionByName(limits)


def summary_prompt(risk: DataFrame, pattern_count: Column, head: DataFrame, lines: DataFrame) -> DataFrame:
    """Prompts for the parts of the closing summary: one row per ``LINES_PER_PROMPT`` lines.

    ``head`` is the ten-row start of the timeline; it and the risk row are small by definition,
    everything of open length is cut into parts by position instead of being gathered.
    """
    intro = summary_intro(risk, pattern_count, head)
    ordered = with_ordinal(lines, ["section", "rank", "chain_no", "item", "text"])
    return _part_prompts(ordered, intro, "Chains and limitations")


def summary_intro(risk: DataFrame, pattern_count: Column, head: DataFrame) -> Column:
    """What every prompt of the summary begins with, as a scalar: counts, risk and first events."""
    entry = F.struct("timestamp", F.concat(
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"), F.lit(" - "), "event_type", F.lit(" - "), "description").alias("t"))
    opening = head.agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: F.concat(F.lit("  "), e["t"])), "\n").alias("shown"),
        F.coalesce(F.max("remaining"), F.lit(0)).alias("remaining"))
    timeline = opening.select(F.concat(
        "shown", F.when(F.col("remaining") > 0, F.concat(F.lit("\n  ... and "), "remaining", F.lit(" more events")))
        .otherwise(F.lit("")))).scalar()
    intro = risk.select(F.concat(
        F.lit("Write the closing summary of a log analysis.\nThreats: "), "threat_count", F.lit(", patterns: "),
        pattern_count, F.lit(".\nRisk: "), "overall_risk_level", F.lit(". "), "reasoning")).scalar()
    return F.concat(intro, F.lit("\n\nTimeline:\n"), timeline)


_ASK = ("\n\nReply with one JSON object with the keys conclusion, confidence, attack_summary, key_indicators, "
        "false_positives, reasoning and limitations.")


def _part_prompts(ordered: DataFrame, intro: Column, title: str) -> DataFrame:
    parts = ordered.withColumn("part", F.floor(F.col("ord") / F.lit(LINES_PER_PROMPT)))
    body = parts.groupBy("part").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda e: e["text"]), "\n").alias("body"))
    return body.select(
        F.col("part").alias("chunk_idx"), F.concat(intro, F.lit(f"\n\n{title}:\n"), "body", F.lit(_ASK)).alias("prompt"))


def fold_summaries(scored: DataFrame, intro: Column, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One scored closing summary from the scored parts, however many they are.

    The conclusions of the parts are the lines of the next prompts, and so on until one prompt holds
    all that is left; that happens also for one part or none. ``score`` answers prompts; each level is
    written before the next reads it, and a level has ``LINES_PER_PROMPT`` times fewer rows.
    """
    while True:
        parsed = parse_replies(scored, SUMMARY, "summary")
        said = F.coalesce("summary.conclusion", F.concat(F.lit("no summary: "), F.coalesce("parsing_error", F.lit("empty"))))
        lines = parsed.select(F.col("chunk_idx").alias("ord"), F.concat(F.lit("- Part "), F.col("chunk_idx") + 1, F.lit(": "), said).alias("text"))
        prompts = _part_prompts(lines, intro, "Summaries of the parts")
        last = lines.agg(F.coalesce(F.max("ord"), F.lit(0))).first()[0] < LINES_PER_PROMPT
        if last:
            nothing = lines.isEmpty()
            if nothing:
                prompts = scored.sparkSession.range(1).select(
                    F.lit(0).cast("long").alias("chunk_idx"), F.concat(intro, F.lit(_ASK)).alias("prompt"))
            return stage(score(prompts), "summary")
        scored = stage(score(prompts), "summary-level")


def final_summary(scored: DataFrame, finding_count: Column) -> DataFrame:
    """Parsed summary, or the fixed text for: nothing found, no JSON, broken JSON."""
    parsed = parse_replies(scored, SUMMARY, "summary")
    failed = F.col("parsing_error").isNotNull()
    nothing = finding_count == 0

    def text(column: str, empty: str | None, broken: str | None) -> Column:
        return (F.when(nothing, F.lit(empty)).when(failed, F.lit(broken)).otherwise(F.col(f"summary.{column}"))).alias(column)

    return parsed.select(
        "chunk_idx",
        text("conclusion", C.CONCLUSION_NOTHING, C.CONCLUSION_BROKEN),
        text("confidence", "Medium", "Low"),
        text("attack_summary", None, None),
        text("reasoning", "The log shows no significant security threats.", "The summary reply could not be parsed."),
        F.when(~nothing & ~failed, F.col("summary.key_indicators")).alias("key_indicators"),
        F.when(~nothing & ~failed, F.col("summary.limitations")).alias("limitations"))
