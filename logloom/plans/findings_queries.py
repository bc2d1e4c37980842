"""Queries over findings: combining, timeline, chains, risk, distributions and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chains, filters, findings, reports, scoring, timeline
from ..workspace import stage
from .adapter import load_events
from .catalog import CTES, query, stamp, stamp_sql
from .rule_findings import load_chains, load_findings, load_replies

TS = stamp_sql('"timestamp"')

CTES["tl"] = (["ev", "links", "pattern_links"], """tl AS (
  SELECT ev.*, trim(process_name || ' ' || coalesce(command_line, '')) AS description, coalesce(t.n, 0) AS threat_count,
    coalesce(p.n, 0) AS pattern_count
  FROM ev LEFT JOIN (SELECT event_id, count(DISTINCT threat_id) AS n FROM links GROUP BY 1) t USING (event_id)
  LEFT JOIN (SELECT event_id, count(DISTINCT pattern_id) AS n FROM pattern_links GROUP BY 1) p USING (event_id)
  WHERE t.n > 0 OR p.n > 0)""")

CTES["seq"] = (["threats"], """seq AS (
  SELECT threat_id, row_number() OVER (ORDER BY chunk_idx, pos) AS no FROM threats)""")


def _timeline(spark, sf_dir):
    f = load_findings(spark, sf_dir)
    return timeline.timeline(load_events(spark, sf_dir), f.links, f.pattern_links)


# --- filters over findings -------------------------------------------------------------


@query("filter_relevant_events", """SELECT event_id, event_type FROM ev WHERE event_id IN (SELECT event_id FROM links)
  OR event_id IN (SELECT event_id FROM pattern_links)""", "ev", "links", "pattern_links")
def filter_relevant_events(spark, sf_dir):
    f = load_findings(spark, sf_dir)
    return filters.relevant_events(load_events(spark, sf_dir), f.links, f.pattern_links).select("event_id", "event_type")


@query("filter_high_threats", "SELECT threat_id, threat_type, severity FROM threats WHERE severity = 'High'", "threats")
def filter_high_threats(spark, sf_dir):
    return filters.high_threats(load_findings(spark, sf_dir).threats).select("threat_id", "threat_type", "severity")


# --- combining chunks ------------------------------------------------------------------


@query("combine_threats", """SELECT threat_id, threat_type, severity, confidence, description, chunk_idx AS source_chunk
  FROM threats""", "threats")
def combine_threats(spark, sf_dir):
    return findings.combine_threats(load_findings(spark, sf_dir).raw_threats).select(
        "threat_id", "threat_type", "severity", "confidence", "description", "source_chunk")


@query("combine_patterns", """SELECT pattern_id, pattern_type, description, chunk_idx AS source_chunk FROM patterns""", "patterns")
def combine_patterns(spark, sf_dir):
    return findings.combine_patterns(load_findings(spark, sf_dir).raw_patterns).select(
        "pattern_id", "pattern_type", "description", "source_chunk")


@query("generated_ids", """SELECT chunk_idx, CAST(pos AS INTEGER) AS pos, 'gen-' || chunk_idx || '-' || pos AS threat_id
  FROM raw_threats WHERE threat_id = ''""", "raw_threats")
def generated_ids(spark, sf_dir):
    raw = load_findings(spark, sf_dir).raw_threats
    blank = raw.filter(F.coalesce("threat_id", F.lit("")) == "")
    return findings.fill_blank_ids(blank, "threat_id").select("chunk_idx", "pos", "threat_id")


@query("distinct_recommendations", """SELECT DISTINCT 'recommendation' AS kind, 'Review ' || threat_type AS text FROM raw_threats
  UNION SELECT 'limitation', 'Context limited to ' || n || ' events' FROM (SELECT count(*) AS n FROM ce GROUP BY chunk_idx)""",
       "raw_threats", "ce")
def distinct_recommendations(spark, sf_dir):
    texts = scoring.text_lists(scoring.parse_replies(load_replies(spark, sf_dir)))
    # One list with both kinds, so that a reply is parsed once.
    named = lambda kind: lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("text"))
    both = [F.transform(c, named(kind)) for kind, c in (("recommendation", "recommendations"), ("limitation", "limitations"))]
    return texts.select(F.inline(F.concat(*both))).distinct()


@query("collect_llm_chains", """SELECT chunk_idx, 'CHAIN-' || (chunk_idx + 1) || '-' || row_number() OVER
    (PARTITION BY chunk_idx ORDER BY "key") AS chain_id, 'Several stages on ' || "key" AS description, 'Medium' AS severity,
    techniques FROM (SELECT chunk_idx, "key", string_agg(DISTINCT threat_type, ',' ORDER BY threat_type) AS techniques
      FROM raw_threats WHERE rule <= 4 GROUP BY ALL HAVING count(DISTINCT threat_type) >= 2)""", "raw_threats")
def collect_proposed_chains(spark, sf_dir):
    parsed = scoring.parse_replies(load_replies(spark, sf_dir))
    return findings.collect_chains(scoring.proposed_chains(parsed)).select(
        "chunk_idx", "chain_id", "description", "severity", F.array_join("techniques", ",").alias("techniques"))


# --- timeline --------------------------------------------------------------------------

_TL = "event_id, {ts} AS timestamp_text, event_type, description, hostname, username, severity, threat_count, pattern_count"


@query("timeline", f"SELECT {_TL.format(ts=TS)} FROM tl", "tl")
def timeline_query(spark, sf_dir):
    return _timeline(spark, sf_dir).select(
        "event_id", stamp("timestamp").alias("timestamp_text"), "event_type", "description", "hostname", "username",
        "severity", "threat_count", "pattern_count")


@query("timeline_links", """SELECT DISTINCT event_id, 'threat' AS kind, threat_id AS finding_id FROM links
  UNION ALL SELECT DISTINCT event_id, 'pattern', pattern_id FROM pattern_links""", "links", "pattern_links")
def timeline_links(spark, sf_dir):
    f = load_findings(spark, sf_dir)
    return timeline.timeline_links(f.links, f.pattern_links)


@query("threat_event_index", "SELECT DISTINCT event_id, threat_id FROM links", "links")
def threat_event_index(spark, sf_dir):
    return timeline.event_index(load_findings(spark, sf_dir).links, "threat_id")


@query("timeline_position", """SELECT event_id, row_number() OVER (ORDER BY "timestamp", event_id) - 1 AS y_pos FROM tl""", "tl")
def timeline_position(spark, sf_dir):
    rows = _timeline(spark, sf_dir).select("timestamp", "event_id")
    return timeline.timeline_position(rows).select("event_id", F.col("y_pos").cast("long").alias("y_pos"))


@query("summary_timeline_head", f"""SELECT event_id, {TS} AS timestamp_text, description,
  (SELECT greatest(count(*) - 10, 0) FROM tl) AS remaining FROM (SELECT * FROM tl ORDER BY "timestamp", event_id LIMIT 10)""", "tl")
def summary_timeline_head(spark, sf_dir):
    return timeline.timeline_head(stage(_timeline(spark, sf_dir), "timeline")).select(
        "event_id", stamp("timestamp").alias("timestamp_text"), "description", F.col("remaining").cast("long").alias("remaining"))


@query("max_timeline_events", """SELECT event_id, severity FROM tl ORDER BY severity DESC, "timestamp", event_id LIMIT 500""", "tl")
def max_timeline_events(spark, sf_dir):
    return timeline.most_significant(_timeline(spark, sf_dir), 500).select("event_id", "severity")


# --- chains ----------------------------------------------------------------------------

# Pairs (threat, earlier threat with a common event). A threat opens a chain once all its earlier
# partners are known members, and is a member once one of them opens a chain.
CTES["assigned"] = (["seq", "links"], """earlier AS (
  SELECT DISTINCT b.no AS no, a.no AS other FROM links x JOIN links y ON x.event_id = y.event_id
  JOIN seq a ON a.threat_id = x.threat_id JOIN seq b ON b.threat_id = y.threat_id WHERE a.no < b.no),
settled AS (
  WITH RECURSIVE state(turn, no, role) AS (
    SELECT 0, no, 'open' FROM seq
    UNION ALL
    SELECT s.turn + 1, s.no, CASE WHEN any_value(s.role) <> 'open' THEN any_value(s.role)
        WHEN bool_or(n.role = 'head') THEN 'member' WHEN bool_and(n.no IS NULL OR n.role = 'member') THEN 'head' ELSE 'open' END
    FROM state s LEFT JOIN earlier e ON e.no = s.no LEFT JOIN state n ON n.no = e.other
    WHERE (SELECT count(*) FROM state WHERE role = 'open') > 0 GROUP BY s.turn, s.no)
  SELECT no, role FROM state WHERE turn = (SELECT max(turn) FROM state)),
assigned AS (
  SELECT s.no, q.threat_id, coalesce(min(h.no), s.no) AS head FROM settled s JOIN seq q USING (no)
  LEFT JOIN earlier e ON e.no = s.no AND s.role = 'member' LEFT JOIN settled h ON h.no = e.other AND h.role = 'head'
  GROUP BY s.no, q.threat_id)""")


@query("attack_chains", """, numbered AS (SELECT head, dense_rank() OVER (ORDER BY head) AS chain_no FROM (SELECT DISTINCT head FROM assigned)),
  m AS (SELECT a.threat_id, n.chain_no, a.no, coalesce(t.severity, 'Low') AS severity,
      CASE coalesce(t.severity, 'Low') WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 1 ELSE 0 END AS rk
    FROM assigned a JOIN numbered n USING (head) JOIN threats t USING (threat_id)),
  e AS (SELECT chain_no, count(DISTINCT event_id) AS event_count FROM m JOIN links USING (threat_id) GROUP BY 1)
  SELECT 'chain-' || chain_no AS chain_id, arg_min(severity, (3 - rk) * 1000000 + no) AS severity, count(*) AS threat_count, any_value(event_count) AS event_count
  FROM m JOIN e USING (chain_no) GROUP BY chain_no""", "assigned")
def attack_chains(spark, sf_dir):
    """The order-dependent one-hop chains, computed afresh."""
    f = load_findings(spark, sf_dir)
    assignment = chains.assign_chains(f.threats, f.links)
    members = chains.chain_threats(assignment, f.threats, chains.number_chains(assignment))
    events = chains.chain_events(members, f.links)
    none = events.limit(0).select("chain_no", F.col("event_id").alias("pattern_id"))
    return chains.chain_headers(members, events, none).select("chain_id", "severity", "threat_count", "event_count")


@query("attack_chains_transitive", """, pairs AS (SELECT a.threat_id AS x, b.threat_id AS y FROM links a JOIN links b USING (event_id)),
  reach AS (WITH RECURSIVE r(x, y) AS (SELECT x, y FROM pairs UNION SELECT r.x, p.y FROM r JOIN pairs p ON r.y = p.x)
    SELECT * FROM r),
  comp AS (SELECT r.x AS threat_id, min(t.chunk_idx * 16777216 + t.pos) AS head FROM reach r JOIN threats t ON t.threat_id = r.y GROUP BY 1)
  SELECT head, count(*) AS threat_count FROM comp GROUP BY head""", "links")
def attack_chains_transitive(spark, sf_dir):
    f = load_findings(spark, sf_dir)
    return chains.connected_chains(f.threats, f.links).groupBy("head").agg(F.count("*").alias("threat_count"))


CTES["chain"] = (["assigned", "links", "pattern_links"], """chain AS (
  SELECT a.threat_id, a.no, a.head, a.no = a.head AS is_head, n.chain_no, t.threat_type, t.chunk_idx AS source_chunk,
    coalesce(t.severity, 'Low') AS label,
    CASE coalesce(t.severity, 'Low') WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 1 ELSE 0 END AS rk
  FROM assigned a JOIN (SELECT head, row_number() OVER (ORDER BY head) AS chain_no FROM (SELECT DISTINCT head FROM assigned)) n
    USING (head) JOIN threats t USING (threat_id)),
chain_event AS (SELECT DISTINCT chain_no, event_id FROM chain JOIN links USING (threat_id)),
chain_pattern AS (SELECT DISTINCT chain_no, pattern_id FROM chain_event JOIN pattern_links USING (event_id)),
header AS (
  SELECT h.*, 'chain-' || chain_no AS chain_id, CASE severity WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 1 ELSE 0 END AS rank,
    event_count, coalesce(pattern_count, 0) AS pattern_count
  FROM (SELECT chain_no, arg_min(label, (3 - rk) * 1000000 + no) AS severity, count(*) AS threat_count FROM chain GROUP BY 1) h
  JOIN (SELECT chain_no, count(*) AS event_count FROM chain_event GROUP BY 1) USING (chain_no)
  LEFT JOIN (SELECT chain_no, count(*) AS pattern_count FROM chain_pattern GROUP BY 1) USING (chain_no))""")


@query("chain_patterns", "SELECT chain_no, pattern_id FROM chain_pattern", "chain")
def chain_patterns(spark, sf_dir):
    c, f = load_chains(spark, sf_dir), load_findings(spark, sf_dir)
    return chains.chain_patterns(c.events, f.pattern_links)


@query("event_set_intersection", """SELECT chain_no, pattern_id, count(*) AS shared_events FROM chain_event
  JOIN pattern_links USING (event_id) GROUP BY ALL""", "chain")
def event_set_intersection(spark, sf_dir):
    c, f = load_chains(spark, sf_dir), load_findings(spark, sf_dir)
    return chains.sets_meet(c.events, f.pattern_links, "chain_no", "pattern_id")


@query("chains_by_severity", """SELECT chain_id, severity, threat_count, event_count, pattern_count FROM header""", "chain")
def chains_by_severity(spark, sf_dir):
    return chains.by_severity(load_chains(spark, sf_dir).headers).drop("chain_no")


@query("top5_chains", """SELECT chain_id, severity, threat_count FROM header ORDER BY rank DESC, chain_no LIMIT 5""", "chain")
def top5_chains(spark, sf_dir):
    return chains.first_chains(load_chains(spark, sf_dir).headers).select("chain_id", "severity", "threat_count")


@query("top_chain", """SELECT chain_id, severity, threat_count FROM header
  ORDER BY CASE severity WHEN 'High' THEN 1 WHEN 'Medium' THEN 0.5 ELSE 0 END DESC, threat_count DESC, rank DESC, chain_no LIMIT 1""", "chain")
def top_chain(spark, sf_dir):
    return reports.top_chain(load_chains(spark, sf_dir).headers).select("chain_id", "severity", "threat_count")


CTES["chain_text"] = (["chain"], """chain_text AS (
  SELECT chain_no, string_agg(n || ' ' || threat_type, ', ' ORDER BY fs) AS types, arg_min(threat_type, fs) AS first_type,
    arg_max(threat_type, ls) AS last_type FROM (
    SELECT chain_no, threat_type, count(*) AS n, min(CASE WHEN is_head THEN 0 ELSE no END) AS fs,
      max(CASE WHEN is_head THEN 0 ELSE no END) AS ls FROM chain GROUP BY ALL) GROUP BY chain_no)""")


@query("chain_type_summary", "SELECT 'chain-' || chain_no AS chain_id, types, first_type, last_type FROM chain_text", "chain_text")
def chain_type_summary(spark, sf_dir):
    return reports.chain_type_summary(load_chains(spark, sf_dir).members).select("chain_id", "types", "first_type", "last_type")


@query("attack_summary", """SELECT 'Analysis identified a ' || lower(severity) || ' severity attack chain involving ' || threat_count ||
  ' connected threats. The attack chain involves ' || types || ', beginning with ' || first_type || ' and progressing to ' ||
  last_type || '.' AS attack_summary FROM header JOIN chain_text USING (chain_no)
  ORDER BY CASE severity WHEN 'High' THEN 1 WHEN 'Medium' THEN 0.5 ELSE 0 END DESC, threat_count DESC, rank DESC, chain_no LIMIT 1""",
       "chain_text")
def attack_summary(spark, sf_dir):
    f, c = load_findings(spark, sf_dir), load_chains(spark, sf_dir)
    return reports.attack_summary(f.threats, c.headers, c.members)


@query("correlation_threshold", """, s AS (SELECT threat_id, list_sort(list(DISTINCT event_id)) AS events FROM links GROUP BY 1),
  d AS (SELECT min(threat_id) AS id, count(*) AS findings, events FROM s GROUP BY events)
  SELECT a.id AS set_a, b.id AS set_b, a.findings AS findings_a, b.findings AS findings_b,
    round(len(list_intersect(a.events, b.events)) / len(list_distinct(list_concat(a.events, b.events))), 6) AS similarity
  FROM d a JOIN d b ON a.id < b.id OR (a.id = b.id AND a.findings > 1)
  WHERE list_has_any(a.events, b.events)
    AND len(list_intersect(a.events, b.events)) / len(list_distinct(list_concat(a.events, b.events))) >= 0.3""", "links")
def correlation_threshold(spark, sf_dir):
    linked = chains.correlated_sets(load_findings(spark, sf_dir).links, "threat_id", 0.3)
    return linked.select("set_a", "set_b", "findings_a", "findings_b", F.round("similarity", 6).alias("similarity"))


# --- risk, distributions, report -------------------------------------------------------

_DIST = """, c AS (SELECT coalesce({0}, 'Low') AS label, count(*) AS n FROM threats GROUP BY 1),
  l AS (SELECT unnest(['High', 'Medium', 'Low']) AS label),
  r AS (SELECT label, coalesce(n, 0) AS n FROM l LEFT JOIN c USING (label))
  SELECT label, n, round(n * 100.0 / (SELECT sum(n) FROM r), 1) AS percent FROM r"""


@query("severity_distribution", _DIST.format("severity"), "threats")
def severity_distribution(spark, sf_dir):
    return reports.severity_distribution(load_findings(spark, sf_dir).threats)


@query("confidence_distribution", _DIST.format("confidence"), "threats")
def confidence_distribution(spark, sf_dir):
    return reports.confidence_distribution(load_findings(spark, sf_dir).threats)


@query("confidence_share", """SELECT coalesce(confidence, 'Unknown') AS confidence, count(*) AS n,
  round(count(*) / (SELECT count(*) FROM threats), 6) AS share FROM threats GROUP BY 1""", "threats")
def confidence_share(spark, sf_dir):
    return reports.confidence_share(load_findings(spark, sf_dir).threats).withColumn("share", F.round("share", 6))


@query("risk_assessment", """, c AS (SELECT count(*) AS n, count(*) FILTER (severity = 'High') AS h,
    count(*) FILTER (severity = 'Medium') AS m, count(*) FILTER (coalesce(severity, 'Low') = 'Low') AS l FROM threats)
  SELECT CASE WHEN h > 0 THEN 'High' WHEN m > 0 THEN 'Medium' WHEN l > 0 THEN 'Low' ELSE 'Minimal' END AS overall_risk_level,
    'Based on ' || n || ' identified threats (' || h || ' high, ' || m || ' medium, ' || l || ' low severity).' AS reasoning,
    n AS threat_count, h AS high, m AS medium, l AS low FROM c""", "threats")
def risk_assessment(spark, sf_dir):
    spread = F.col("severity_distribution")
    return reports.risk_assessment(load_findings(spark, sf_dir).threats).select(
        "overall_risk_level", "reasoning", "threat_count", spread["High"].alias("high"), spread["Medium"].alias("medium"),
        spread["Low"].alias("low"))


@query("key_indicators", """SELECT DISTINCT indicator FROM (
    SELECT CASE WHEN length(s) > 100 THEN left(s, 97) || '...' ELSE s END AS indicator FROM (
      SELECT split_part(description, '.', 1) AS s FROM threats WHERE severity = 'High' AND length(description) > 10)
    UNION SELECT pattern_type FROM patterns) ORDER BY indicator LIMIT 5""", "threats", "patterns")
def key_indicators(spark, sf_dir):
    f = load_findings(spark, sf_dir)
    return reports.key_indicators(f.threats, f.patterns)


@query("threats_by_severity", """SELECT threat_id, coalesce(severity, 'Low') AS severity, CASE coalesce(severity, 'Low')
  WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 1 ELSE 0 END AS severity_rank FROM threats""", "threats")
def threats_by_severity(spark, sf_dir):
    return reports.threats_by_severity(load_findings(spark, sf_dir).threats).select(
        "threat_id", F.coalesce("severity", F.lit("Low")).alias("severity"), "severity_rank")


@query("top_events_per_threat", """SELECT threat_id, string_agg(event_id, ',' ORDER BY rn) AS events, greatest(any_value(total) - 5, 0) AS more
  FROM (SELECT threat_id, event_id, row_number() OVER (PARTITION BY threat_id ORDER BY ord) AS rn,
    count(*) OVER (PARTITION BY threat_id) AS total FROM links) WHERE rn <= 5 GROUP BY threat_id
  UNION ALL SELECT pattern_id, string_agg(event_id, ',' ORDER BY rn), greatest(any_value(total) - 5, 0)
  FROM (SELECT pattern_id, event_id, row_number() OVER (PARTITION BY pattern_id ORDER BY ord) AS rn,
    count(*) OVER (PARTITION BY pattern_id) AS total FROM pattern_links) WHERE rn <= 5 GROUP BY pattern_id""", "links", "pattern_links")
def top_events_per_threat(spark, sf_dir):
    f = load_findings(spark, sf_dir)
    threats = reports.top_events(f.links, "threat_id", "ord")
    patterns = reports.top_events(f.pattern_links, "pattern_id", "ord")
    both = threats.union(patterns)
    return both.select("threat_id", F.array_join("events", ",").alias("events"), F.col("more").cast("long").alias("more"))
