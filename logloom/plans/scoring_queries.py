"""Queries of the chunk scoring job."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import token_estimate
from ..operators import filters, reports, scoring, timeline
from ..workspace import once, stage
from . import offline_scorer
from .adapter import load_events
from .catalog import CTES, query
from .rule_findings import chunked_events, load_chains, load_findings, load_replies

_WHEN = """CASE WHEN strftime("timestamp", '%f') = '000000' THEN strftime("timestamp", '%Y-%m-%d %H:%M:%S')
      ELSE strftime("timestamp", '%Y-%m-%d %H:%M:%S.%f') END"""
CTES["rendered"] = (["ce"], f"""rendered AS (
  SELECT chunk_idx, count(*) AS event_count, 'NETWORK FLOW DATA (' || count(*) || ' total events)' || chr(10) || chr(10) ||
    string_agg('Event ' || (ord - chunk_idx * 40 + 1) || ' (ID: ' || event_id || ')' || chr(10) || 'Time: ' || {_WHEN} || chr(10) ||
      'Source: ' || source || chr(10) || 'Destination: ' || destination || chr(10) || 'Action: ' || action || chr(10) || chr(10),
      '' ORDER BY ord) AS events_text FROM ce GROUP BY chunk_idx)""")
CTES["prompts"] = (["rendered"], f"""prompts AS (
  SELECT chunk_idx, event_count, '{scoring.PROMPT_HEAD}' || (chunk_idx + 1) || '.' || chr(10) || chr(10) || events_text ||
    '{scoring.PROMPT_RULES}' || 'THREAT-' || (chunk_idx + 1) || '-1, PATTERN-' || (chunk_idx + 1) || '-1, CHAIN-' ||
    (chunk_idx + 1) || '-1.' AS prompt FROM rendered)""")


def _prompts(spark, sf_dir):
    return scoring.render_prompts(scoring.render_events(chunked_events(spark, sf_dir)))


@query("render_events", "SELECT chunk_idx, event_count, events_text FROM rendered", "rendered")
def render_events(spark, sf_dir):
    return scoring.render_events(chunked_events(spark, sf_dir))


@query("render_prompt", "SELECT chunk_idx, length(prompt) AS length, md5(prompt) AS prompt_md5 FROM prompts", "prompts")
def render_prompt(spark, sf_dir):
    return _prompts(spark, sf_dir).select(
        "chunk_idx", F.length("prompt").cast("long").alias("length"), F.md5("prompt").alias("prompt_md5"))


@query("filter_prompt_budget", """SELECT chunk_idx, length(prompt) < 6650 AS accepted FROM prompts""", "prompts")
def filter_prompt_budget(spark, sf_dir):
    """A budget in the middle of the prompt sizes, so that both outputs have rows."""
    accepted, rejected = filters.within_prompt_budget(_prompts(spark, sf_dir), 6650)
    return accepted.select("chunk_idx", F.lit(True).alias("accepted")).union(
        rejected.select("chunk_idx", F.lit(False).alias("accepted")))


def _scored(spark, sf_dir):
    """Replies are written before they are read."""
    return once(spark, ("scored", sf_dir), lambda: stage(
        scoring.score_chunks(_prompts(spark, sf_dir), offline_scorer.failed_action_scorer), "replies"), f"{sf_dir}/events.parquet")


@query("score_chunks", """SELECT chunk_idx, count(*) FILTER (action = 'error') AS failed_events, CASE WHEN count(*) FILTER (action = 'error') > 0
  THEN 'THREAT-' || (chunk_idx + 1) || '-1' END AS threat_id, string_agg(event_id, ',' ORDER BY ord) FILTER (action = 'error') AS related_events
  FROM ce GROUP BY chunk_idx""", "ce")
def score_chunks(spark, sf_dir):
    parsed = scoring.parse_replies(_scored(spark, sf_dir))
    first = F.get("findings.identified_threats", 0)
    return parsed.select(
        "chunk_idx", F.coalesce(F.size(first["related_events"]), F.lit(0)).cast("long").alias("failed_events"),
        first["threat_id"].alias("threat_id"), F.array_join(first["related_events"], ",").alias("related_events"))


def _mixed_replies(spark, sf_dir):
    """Rule replies; of ten chunks one has no JSON, one is cut off and one failed."""
    replies = load_replies(spark, sf_dir)
    case = F.col("chunk_idx") % 10
    reply = (
        F.when(case == 3, "I found nothing to report.").when(case == 7, F.replace("reply", F.lit('"limitations":'), F.lit("")))
        .when(case == 9, None).otherwise(F.col("reply")))
    return replies.select("chunk_idx", reply.alias("reply"), F.when(case == 9, "timed out").alias("error"))


_ERROR = """CASE chunk_idx % 10 WHEN 3 THEN 'No JSON found in response' WHEN 7 THEN 'JSON parsing error'
  WHEN 9 THEN 'Processing error: timed out' END"""


@query("parse_replies", f"""SELECT c.chunk_idx, {_ERROR.replace('chunk_idx', 'c.chunk_idx')} AS parsing_error,
  CASE WHEN c.chunk_idx % 10 NOT IN (3, 7, 9) THEN coalesce(n, 0) END AS threats FROM (SELECT DISTINCT chunk_idx FROM ce) c
  LEFT JOIN (SELECT chunk_idx, count(*) AS n FROM raw_threats GROUP BY 1) t USING (chunk_idx)""", "ce", "raw_threats")
def parse_replies(spark, sf_dir):
    parsed = scoring.parse_replies(_mixed_replies(spark, sf_dir))
    count = F.when(F.col("parsing_error").isNull(), F.coalesce(F.size("findings.identified_threats"), F.lit(0)))
    return parsed.select("chunk_idx", "parsing_error", count.cast("long").alias("threats"))


@query("filter_parse_ok", """SELECT DISTINCT chunk_idx FROM ce WHERE chunk_idx % 10 NOT IN (3, 7, 9)""", "ce")
def filter_parse_ok(spark, sf_dir):
    return filters.parse_ok(scoring.parse_replies(_mixed_replies(spark, sf_dir))).select("chunk_idx")


@query("explode_findings", """SELECT chunk_idx, 'threat' AS kind, pos, threat_id AS id, threat_type AS type, severity, description,
    string_agg(event_id, ',' ORDER BY ord) AS events FROM raw_threats JOIN raw_links USING (chunk_idx, pos) GROUP BY ALL
  UNION ALL SELECT chunk_idx, 'pattern', pos, pattern_id, pattern_type, NULL, description, string_agg(event_id, ',' ORDER BY ord)
    FROM raw_patterns JOIN raw_pattern_links USING (chunk_idx, pos) GROUP BY ALL""",
       "raw_threats", "raw_links", "raw_patterns", "raw_pattern_links")
def explode_findings(spark, sf_dir):
    parsed = scoring.parse_replies(load_replies(spark, sf_dir))
    events = F.array_join("related_events", ",").alias("events")
    threats = scoring.explode_threats(parsed).select(
        "chunk_idx", F.lit("threat").alias("kind"), F.col("pos").cast("long").alias("pos"), F.col("threat_id").alias("id"), F.col("threat_type").alias("type"),
        "severity", "description", events)
    patterns = scoring.explode_patterns(parsed).select(
        "chunk_idx", F.lit("pattern").alias("kind"), F.col("pos").cast("long").alias("pos"), F.col("pattern_id").alias("id"), F.col("pattern_type").alias("type"),
        F.lit(None).cast("string").alias("severity"), "description", events)
    return threats.union(patterns)


@query("chunk_failures", """SELECT chunk_idx, chunk_idx % 10 IN (3, 7, 9) AS failed, CASE WHEN chunk_idx % 10 IN (3, 7, 9) THEN 0
  ELSE coalesce(n, 0) END AS threats, CASE WHEN chunk_idx % 10 IN (3, 7, 9) THEN 'Unknown' END AS overall_risk_level
  FROM (SELECT DISTINCT chunk_idx FROM ce) LEFT JOIN (SELECT chunk_idx, count(*) AS n FROM raw_threats GROUP BY 1) USING (chunk_idx)""",
       "ce", "raw_threats")
def chunk_failures(spark, sf_dir):
    parsed = scoring.parse_replies(_mixed_replies(spark, sf_dir))
    return scoring.chunk_failures(chunked_events(spark, sf_dir), parsed).select(
        "chunk_idx", "failed", F.col("threats").cast("long").alias("threats"), "overall_risk_level")


@query("run_state", """SELECT count(*) AS chunks, count(*) FILTER (chunk_idx % 10 IN (3, 7, 9)) AS failed_chunks, false AS all_failed
  FROM (SELECT DISTINCT chunk_idx FROM ce)""", "ce")
def run_state(spark, sf_dir):
    parsed = scoring.parse_replies(_mixed_replies(spark, sf_dir))
    return scoring.run_state(scoring.chunk_failures(chunked_events(spark, sf_dir), parsed)).drop("error")


@query("pending_chunks", "SELECT DISTINCT chunk_idx FROM ce WHERE chunk_idx % 10 = 9", "ce")
def pending_chunks(spark, sf_dir):
    chunks = chunked_events(spark, sf_dir).select("chunk_idx").distinct()
    return scoring.pending_chunks(chunks, _mixed_replies(spark, sf_dir))


def _summary_prompts(spark, sf_dir):
    """Prompts of the parts, and what they begin with."""
    f, c = load_findings(spark, sf_dir), load_chains(spark, sf_dir)
    # What the head shows; no other column of the events is shuffled or written.
    shown = timeline.timeline(load_events(spark, sf_dir), f.links, f.pattern_links).select(
        "event_id", "timestamp", "event_type", "description")
    rows = stage(shown, "timeline")
    head = timeline.timeline_head(rows)
    texts = scoring.text_lists(scoring.parse_replies(load_replies(spark, sf_dir)))
    limits = texts.select(F.explode("limitations").alias("text")).distinct()
    lines = scoring.summary_lines(c.headers, c.members, limits)
    shared = reports.risk_assessment(f.threats), f.patterns.agg(F.count("*")).scalar(), head
    return scoring.summary_prompt(*shared, lines), scoring.summary_intro(*shared)


_ASK = ("Reply with one JSON object with the keys conclusion, confidence, attack_summary, key_indicators, "
        "false_positives, reasoning and limitations.")
CTES["summary"] = (["tl", "chain", "threats", "patterns", "ce"], f"""head10 AS (
  SELECT '  ' || strftime("timestamp", '%Y-%m-%d %H:%M:%S') || ' - ' || event_type || ' - ' || description AS t, "timestamp" AS tm, event_id
  FROM tl ORDER BY "timestamp", event_id LIMIT 10),
counted AS (SELECT count(*) AS n, count(*) FILTER (severity = 'High') AS h, count(*) FILTER (severity = 'Medium') AS m,
  count(*) FILTER (coalesce(severity, 'Low') = 'Low') AS l FROM threats),
intro AS (SELECT 'Write the closing summary of a log analysis.' || chr(10) || 'Threats: ' || n || ', patterns: ' ||
    (SELECT count(*) FROM patterns) || '.' || chr(10) || 'Risk: ' || CASE WHEN h > 0 THEN 'High' WHEN m > 0 THEN 'Medium' WHEN l > 0 THEN 'Low'
    ELSE 'Minimal' END || '. Based on ' || n || ' identified threats (' || h || ' high, ' || m || ' medium, ' || l || ' low severity).' ||
    chr(10) || chr(10) || 'Timeline:' || chr(10) || (SELECT string_agg(t, chr(10) ORDER BY tm, event_id) FROM head10) ||
    CASE WHEN (SELECT count(*) FROM tl) > 10 THEN chr(10) || '  ... and ' || ((SELECT count(*) FROM tl) - 10) || ' more events' ELSE '' END ||
    chr(10) || chr(10) || 'Chains and limitations:' || chr(10) AS text FROM counted),
line AS (
  SELECT 0 AS section, -rank AS rank, chain_no, -1 AS item, '  ' || chain_id || ' (Severity: ' || severity || '): ' || threat_count ||
    ' threats across ' || event_count || ' events' AS text FROM header
  UNION ALL SELECT 0, -h.rank, c.chain_no, t.chunk_idx * 16777216 + t.pos, '    - Threat: ' || t.threat_type || ' - ' || left(t.description, 100) || '...'
    FROM chain c JOIN header h USING (chain_no) JOIN threats t USING (threat_id)
  UNION ALL SELECT DISTINCT 1, 0, 0, 0, '- Context limited to ' || n || ' events' FROM (SELECT count(*) AS n FROM ce GROUP BY chunk_idx)),
summary AS (
  SELECT part AS chunk_idx, (SELECT text FROM intro) || string_agg(text, chr(10) ORDER BY ord) || chr(10) || chr(10) || '{_ASK}' AS prompt
  FROM (SELECT *, ord // 200 AS part FROM (SELECT *, row_number() OVER (ORDER BY section, rank, chain_no, item, text) - 1 AS ord FROM line))
  GROUP BY part)""")


@query("summary_prompt", "SELECT chunk_idx, prompt FROM summary", "summary")
def summary_prompt(spark, sf_dir):
    return _summary_prompts(spark, sf_dir)[0].select("chunk_idx", "prompt")


@query("final_summary", """SELECT count(*) FILTER (text LIKE '    - Threat: %') || ' threat lines, ' || count(*) FILTER (section = 1) ||
  ' limitation lines' AS conclusion, 'Medium' AS confidence FROM line""", "summary")
def final_summary(spark, sf_dir):
    """One row: the parts are scored, then folded."""
    prompts, intro = _summary_prompts(spark, sf_dir)
    score = lambda p: scoring.score_chunks(p, offline_scorer.summary_scorer, budget=None)
    folded = scoring.fold_summaries(stage(score(prompts), "replies"), intro, score)
    found = load_findings(spark, sf_dir).threats.agg(F.count("*")).scalar()
    return scoring.final_summary(folded, found).select("conclusion", "confidence")


@query("token_estimate", """SELECT conv_id, sum(CASE WHEN role = 'user' THEN length(text) ELSE 0 END) / 4.0 AS prompt_tokens,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) / 4.0 AS reply_tokens, sum(length(text)) / 4.0 AS total_tokens
  FROM conversations GROUP BY conv_id""")
def token_estimate_query(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "role", token_estimate(F.col("text")).alias("t"))
    zero = F.lit(0.0)
    return turns.groupBy("conv_id").agg(
        F.sum(F.when(F.col("role") == "user", F.col("t")).otherwise(zero)).alias("prompt_tokens"),
        F.sum(F.when(F.col("role") == "assistant", F.col("t")).otherwise(zero)).alias("reply_tokens"),
        F.sum("t").alias("total_tokens"))
