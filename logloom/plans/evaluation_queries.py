"""Queries that measure a run: spans, similarity, accuracy, performance, cost and resources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import costs, evaluation, findings, stats
from .adapter import load_events
from .catalog import CTES, query, stamp, stamp_sql
from .rule_findings import load_chains, load_findings

# --- chunk borders and chains ----------------------------------------------------------


def _raw(f):
    """All findings before repeats are removed, with their links."""
    threats = findings.fill_blank_ids(f.raw_threats, "threat_id")
    return threats, f.raw_links.join(threats.select("chunk_idx", "pos", "threat_id"), ["chunk_idx", "pos"])


CTES["named"] = (["raw_threats"], """named AS (
  SELECT * REPLACE (CASE WHEN coalesce(threat_id, '') = '' THEN 'gen-' || chunk_idx || '-' || pos ELSE threat_id END AS threat_id)
  FROM raw_threats)""")
CTES["spans"] = (["named", "raw_links"], """spans AS (
  SELECT threat_id, count(DISTINCT n.chunk_idx) AS chunk_count, count(DISTINCT l.event_id) AS event_count,
    count(DISTINCT n.chunk_idx) > 1 AS multi_chunk FROM named n JOIN raw_links l USING (chunk_idx, pos) GROUP BY threat_id)""")
CTES["chain_span"] = (["chain"], """chain_span AS (
  SELECT chain_no, count(*) AS threats, count(DISTINCT source_chunk) AS chunks FROM chain GROUP BY chain_no)""")
CTES["context"] = (["spans", "chain_span", "ce"], """context AS (
  SELECT (SELECT count(DISTINCT chunk_idx) FROM ce) AS total_chunks, count(*) AS total_threats,
    count(*) FILTER (NOT multi_chunk) AS single_chunk_threats, count(*) FILTER (multi_chunk) AS multi_chunk_threats,
    count(*) FILTER (multi_chunk) / count(*) AS rate, (SELECT avg(threats) FROM chain_span) AS avg_chain_length,
    (SELECT max(threats) FROM chain_span) AS max_chain_length,
    (SELECT count(*) FILTER (chunks > 1) FROM chain_span) AS cross_chunk_chains FROM spans)""")


@query("threat_span", "SELECT threat_id, chunk_count, event_count, multi_chunk FROM spans", "spans")
def threat_span(spark, sf_dir):
    return evaluation.threat_span(*_raw(load_findings(spark, sf_dir)))


def _context(spark, sf_dir):
    f, c = load_findings(spark, sf_dir), load_chains(spark, sf_dir)
    chunks = f.chunked.agg(F.count_distinct("chunk_idx")).scalar()
    return evaluation.context_window_metrics(evaluation.threat_span(*_raw(f)), evaluation.chain_spans(c.members), chunks)


@query("context_window_metrics", """SELECT total_chunks, total_threats, single_chunk_threats, multi_chunk_threats,
  round(rate, 6) AS cross_chunk_connection_rate, round(avg_chain_length, 6) AS avg_chain_length, max_chain_length,
  cross_chunk_chains, round(1 - rate, 6) AS limitation_score FROM context""", "context")
def context_window_metrics(spark, sf_dir):
    rounded = ("cross_chunk_connection_rate", "avg_chain_length", "limitation_score")
    return _context(spark, sf_dir).withColumns({c: F.round(c, 6) for c in rounded})


@query("threat_types_by_chunk", "SELECT DISTINCT chunk_idx AS source_chunk, threat_type FROM threats", "threats")
def threat_types_by_chunk(spark, sf_dir):
    return evaluation.threat_types_by_chunk(load_findings(spark, sf_dir).threats)


CTES["type_sets"] = (["threats"], "type_sets AS (SELECT chunk_idx AS c, list(DISTINCT threat_type) AS t FROM threats GROUP BY 1)")
CTES["pairs"] = (["type_sets"], """pairs AS (
  SELECT least(len(a.t), len(b.t)) AS types_a, greatest(len(a.t), len(b.t)) AS types_b, len(list_intersect(a.t, b.t)) AS shared_types
  FROM type_sets a JOIN type_sets b ON a.c < b.c)""")


@query("chunk_pairs", """SELECT types_a, types_b, shared_types, count(*) AS pairs,
  round(shared_types / (types_a + types_b - shared_types), 6) AS similarity FROM pairs GROUP BY ALL""", "pairs")
def chunk_pairs(spark, sf_dir):
    return evaluation.chunk_pairs(load_findings(spark, sf_dir).threats).withColumn("similarity", F.round("similarity", 6))


@query("chunk_similarity", """SELECT round(avg(shared_types / (types_a + types_b - shared_types)), 6) AS avg_chunk_similarity,
  round(1 - avg(shared_types / (types_a + types_b - shared_types)), 6) AS inconsistency_rate,
  (SELECT count(DISTINCT threat_type) FROM threats) AS unique_threat_types, (SELECT count(*) FROM threats) AS total_threats FROM pairs""",
       "pairs")
def chunk_similarity(spark, sf_dir):
    result = evaluation.chunk_similarity(load_findings(spark, sf_dir).threats)
    return result.withColumns({c: F.round(c, 6) for c in ("avg_chunk_similarity", "inconsistency_rate")})


# True types: what the event actions of the log stand for, one of them never detected.
_TRUTH = """truth AS (SELECT DISTINCT CASE event_type WHEN 'alert' THEN 'Failed Activity' WHEN 'netconn' THEN 'Outbound Connection'
  WHEN 'regmod' THEN 'Persistence' ELSE 'Staging' END AS type FROM ev)"""
CTES["truth"] = (["ev"], _TRUTH)
CTES["kinds"] = (["threats"], "kinds AS (SELECT DISTINCT threat_type AS type FROM threats)")


def _truth(spark, sf_dir):
    kind = F.col("event_type")
    true = (F.when(kind == "alert", "Failed Activity").when(kind == "netconn", "Outbound Connection")
            .when(kind == "regmod", "Persistence").otherwise("Staging"))
    return load_events(spark, sf_dir).select(true.alias("type"))


@query("detection_accuracy", """, d AS (SELECT DISTINCT threat_type AS type FROM threats),
  c AS (SELECT (SELECT count(*) FROM d WHERE type IN (FROM truth)) AS tp, (SELECT count(*) FROM d WHERE type NOT IN (FROM truth)) AS fp,
    (SELECT count(*) FROM truth WHERE type NOT IN (FROM d)) AS fn)
  SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
    round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS f1_score FROM c""", "threats", "truth")
def detection_accuracy(spark, sf_dir):
    result = evaluation.detection_accuracy(load_findings(spark, sf_dir).threats, _truth(spark, sf_dir))
    return result.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1_score")})


@query("type_set_ops", """, d AS (SELECT DISTINCT threat_type AS type FROM threats)
  SELECT 'intersection' AS operation, type FROM d WHERE type IN (FROM truth)
  UNION ALL SELECT 'only_detected', type FROM d WHERE type NOT IN (FROM truth)
  UNION ALL SELECT 'only_true', type FROM truth WHERE type NOT IN (FROM d)
  UNION ALL SELECT 'union', type FROM (FROM d UNION FROM truth)""", "threats", "truth")
def type_set_ops(spark, sf_dir):
    return evaluation.type_set_operations(load_findings(spark, sf_dir).threats, _truth(spark, sf_dir))


def _memory(spark, sf_dir):
    f, c = load_findings(spark, sf_dir), load_chains(spark, sf_dir)
    covered = c.members.agg(F.count_distinct("threat_id")).scalar()
    known = f.threats.agg(F.count_distinct("threat_id")).scalar()
    return evaluation.memory_metrics(evaluation.chain_spans(c.members), covered, known)


@query("memory_metrics", """SELECT count(*) AS total_chains, round(avg(threats), 6) AS avg_chain_length, max(threats) AS max_chain_length,
  count(*) FILTER (chunks > 1) AS cross_chunk_chains, round(count(*) FILTER (chunks > 1) / count(*), 6) AS cross_chunk_chains_percent,
  max(chunks) AS max_chunks_per_chain, round((SELECT count(DISTINCT threat_id) FROM chain) / (SELECT count(*) FROM threats), 6)
    AS chain_threat_coverage, round(1 - count(*) FILTER (chunks > 1) / count(*), 6) AS memory_limitation_score FROM chain_span""", "chain_span")
def memory_metrics(spark, sf_dir):
    rounded = ("avg_chain_length", "cross_chunk_chains_percent", "chain_threat_coverage", "memory_limitation_score")
    return _memory(spark, sf_dir).withColumns({c: F.round(c, 6) for c in rounded})


_REPORT = """, s AS (SELECT 1 - rate AS a, (SELECT 1 - avg(shared_types / (types_a + types_b - shared_types)) FROM pairs) AS b,
    (SELECT 1 - count(*) FILTER (chunks > 1) / count(*) FROM chain_span) AS c FROM context),
  r AS (SELECT 'overall' AS area, (a + b + c) / 3 AS score FROM s UNION ALL SELECT 'context_window', a FROM s
    UNION ALL SELECT 'probabilistic_correlation', b FROM s UNION ALL SELECT 'memory', c FROM s)
  SELECT area, round(score, 6) AS score, CASE WHEN score < 0.25 THEN 'Minimal' WHEN score < 0.5 THEN 'Moderate' WHEN score < 0.75
    THEN 'Significant' ELSE 'Severe' END || ' limitation' AS band FROM r"""


@query("limitation_report", _REPORT, "context", "pairs")
def limitation_report(spark, sf_dir):
    f = load_findings(spark, sf_dir)
    inconsistency = evaluation.chunk_similarity(f.threats).select("inconsistency_rate").scalar()
    memory = _memory(spark, sf_dir).select("memory_limitation_score").scalar()
    context = _context(spark, sf_dir)
    report = evaluation.limitation_report(F.col("limitation_score"), inconsistency, memory, context)
    return report.withColumn("score", F.round("score", 6))


@query("evaluate_results", _REPORT + """ UNION ALL SELECT 'accuracy', round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6), ''
  FROM (SELECT (SELECT count(*) FROM kinds WHERE type IN (FROM truth)) AS tp, (SELECT count(*) FROM kinds WHERE type NOT IN (FROM truth)) AS fp,
    (SELECT count(*) FROM truth WHERE type NOT IN (FROM kinds)) AS fn)""", "context", "pairs", "truth", "kinds")
def evaluate_results(spark, sf_dir):
    """The report and the accuracy from chunk results that were written to files and read back."""
    from ..sources.results import load_results, result_threats
    from .analysis import evaluate
    from .source_queries import store_results

    found = evaluate(result_threats(load_results(spark, store_results(spark, sf_dir))), _truth(spark, sf_dir))
    accuracy = found["accuracy"].select(F.lit("accuracy").alias("area"), F.col("f1_score").alias("score"), F.lit("").alias("band"))
    return found["limitations"].select("area", "score", "band").unionByName(accuracy).withColumn("score", F.round("score", 6))


# --- performance and cost --------------------------------------------------------------
# One conversation counts as one scored chunk: its assistant turns are the calls.

CTES["runs"] = ([], """runs AS (
  SELECT conv_id, count(*) FILTER (role = 'assistant') AS api_calls, sum(length(text)) / 4.0 AS total_tokens,
    sum(length(text)) / 1000.0 AS duration_seconds,
    CASE conv_id % 5 WHEN 0 THEN 'anthropic' WHEN 1 THEN 'anthropic' WHEN 2 THEN 'deepseek' WHEN 3 THEN 'deepseek_local' ELSE 'other' END AS provider,
    CASE conv_id % 5 WHEN 0 THEN 'claude-3-opus' WHEN 1 THEN 'unlisted' WHEN 2 THEN 'deepseek-coder' WHEN 3 THEN 'any' ELSE 'any' END AS model
  FROM conversations GROUP BY conv_id)""")


def _runs(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    case = F.col("conv_id") % 5 + 1

    def pick(*names):
        return F.element_at(F.array(*[F.lit(n) for n in names]), case.cast("int"))

    return turns.groupBy("conv_id").agg(
        F.count_if(F.col("role") == "assistant").alias("api_calls"), (F.sum(F.length("text")) / 4.0).alias("total_tokens"),
        (F.sum(F.length("text")) / 1000.0).alias("duration_seconds"),
    ).withColumns({
        "provider": pick("anthropic", "anthropic", "deepseek", "deepseek_local", "other"),
        "model": pick("claude-3-opus", "unlisted", "deepseek-coder", "any", "any")})


@query("performance_totals", """SELECT sum(api_calls)::BIGINT AS total_api_calls, round(sum(total_tokens), 3) AS total_tokens,
  round(sum(duration_seconds), 3) AS total_duration_seconds, count(*) AS chunks_processed,
  round(sum(total_tokens) / count(*), 6) AS average_tokens_per_chunk, round(sum(duration_seconds) / count(*), 6) AS average_duration_per_chunk
  FROM runs""", "runs")
def performance_totals(spark, sf_dir):
    digits = {"total_tokens": 3, "total_duration_seconds": 3, "average_tokens_per_chunk": 6, "average_duration_per_chunk": 6}
    return costs.performance_totals(_runs(spark, sf_dir)).withColumns({c: F.round(c, d) for c, d in digits.items()})


@query("run_metrics", """SELECT floor(sum(total_tokens) / sum(api_calls))::BIGINT AS average_tokens_per_call,
  round((SELECT count(*) FROM events) / sum(duration_seconds), 6) AS events_per_second FROM runs""", "runs")
def run_metrics(spark, sf_dir):
    events = load_events(spark, sf_dir).agg(F.count("*")).scalar()
    return costs.run_metrics(costs.performance_totals(_runs(spark, sf_dir)), events).withColumn(
        "events_per_second", F.round("events_per_second", 6))


CTES["cost"] = (["runs"], """cost AS (
  SELECT *, total_tokens * 0.7 AS tin, total_tokens * 0.3 AS tout, total_tokens * 0.7 / 1000 * CASE conv_id % 5 WHEN 0 THEN 0.03 WHEN 1 THEN 0.015
    WHEN 2 THEN 0.0025 WHEN 3 THEN 0 ELSE 0.01 END AS cin, total_tokens * 0.3 / 1000 * CASE conv_id % 5 WHEN 0 THEN 0.15 WHEN 1 THEN 0.075
    WHEN 2 THEN 0.0075 WHEN 3 THEN 0 ELSE 0.05 END AS cout FROM runs)""")


@query("cost_estimate", """SELECT conv_id, provider, model, floor(cin * 1e6)::BIGINT AS input_micro_usd,
  floor(cout * 1e6)::BIGINT AS output_micro_usd, floor((cin + cout) * 1e6)::BIGINT AS total_micro_usd, 'USD' AS currency FROM cost""", "cost")
def cost_estimate(spark, sf_dir):
    """Whole millionths of a dollar, so that no rounding rule matters."""
    priced = costs.cost_estimate(_runs(spark, sf_dir))
    return priced.select("conv_id", "provider", "model", *[
        F.floor(F.col(f"{c}_cost") * 1e6).alias(f"{c}_micro_usd") for c in ("input", "output", "total")], "currency")


# --- resource samples: every event is one measurement ----------------------------------

CTES["samples"] = (["ev"], """samples AS (
  SELECT "timestamp" AS t, 'chunk_' || (event_no // 2) || CASE WHEN event_no % 2 = 0 THEN '_start' ELSE '_end' END AS tag,
    bytes % 100 AS cpu, CAST(k AS DOUBLE) AS mem, k * 0.32::DOUBLE AS gb, bytes % 50 AS g0, CAST(k % 10 AS DOUBLE) AS g1, hostname FROM ev)""")


def _samples(spark, sf_dir):
    k, half = F.col("k"), F.floor(F.col("event_no") / 2)
    tag = F.concat(F.lit("chunk_"), half, F.when(F.col("event_no") % 2 == 0, "_start").otherwise("_end"))

    def gpu(name, used, load):
        none = F.lit(None).cast("double")
        return F.struct(F.lit(name).alias("name"), used.cast("double").alias("memory_used_percent"),
                        load.cast("double").alias("utilization_percent"), none.alias("memory_allocated_mb"),
                        none.alias("memory_reserved_mb"))

    return load_events(spark, sf_dir).select(
        "timestamp", tag.alias("tag"), (F.col("bytes") % 100).alias("cpu_percent"), k.cast("double").alias("memory_percent"),
        (k * 0.32).alias("memory_used_gb"), "hostname",
        F.create_map(F.lit("gpu_0"), gpu("first", F.col("bytes") % 50, k), F.lit("gpu_1"), gpu("second", k % 10, k)).alias("gpu_info"))


@query("resource_summary", f"""SELECT min(cpu) AS cpu_percent_min, max(cpu) AS cpu_percent_max, round(avg(cpu), 6) AS cpu_percent_mean,
  min(mem) AS memory_percent_min, max(mem) AS memory_percent_max, round(avg(mem), 6) AS memory_percent_mean,
  min(gb) AS memory_used_gb_min, max(gb) AS memory_used_gb_max, round(avg(gb), 6) AS memory_used_gb_mean,
  (SELECT {stamp_sql('t')} FROM samples ORDER BY mem DESC, t LIMIT 1) AS peak_text, (SELECT tag FROM samples ORDER BY mem DESC, t LIMIT 1) AS peak_tag,
  count(*) AS measurement_count FROM samples""", "samples")
def resource_summary(spark, sf_dir):
    means = {f"{c}_mean": F.round(f"{c}_mean", 6) for c in ("cpu_percent", "memory_percent", "memory_used_gb")}
    return stats.resource_summary(_samples(spark, sf_dir)).withColumns(means).withColumn(
        "peak_text", stamp("peak_timestamp")).drop("peak_timestamp", "first_measurement", "last_measurement")


@query("gpu_summary", """SELECT 'gpu_0' AS gpu_id, 'first' AS name, min(g0) AS memory_used_percent_min, max(g0) AS memory_used_percent_max,
  round(avg(g0), 6) AS memory_used_percent_mean, max(mem) AS utilization_percent_max FROM samples
  UNION ALL SELECT 'gpu_1', 'second', min(g1), max(g1), round(avg(g1), 6), max(mem) FROM samples""", "samples")
def gpu_summary(spark, sf_dir):
    return stats.gpu_summary(_samples(spark, sf_dir)).select(
        "gpu_id", "name", "memory_used_percent_min", "memory_used_percent_max",
        F.round("memory_used_percent_mean", 6).alias("memory_used_percent_mean"), "utilization_percent_max")


@query("stage_times", """SELECT regexp_replace(prev_tag, '_[^_]*$', '') AS stage, (epoch_us(t) - epoch_us(prev_t)) / 1e6 AS seconds FROM (
    SELECT tag, t, lag(tag) OVER w AS prev_tag, lag(t) OVER w AS prev_t FROM samples WINDOW w AS (ORDER BY t, tag))
  WHERE prev_tag LIKE '%\\_start' ESCAPE '\\' AND tag LIKE '%\\_end' ESCAPE '\\'""", "samples")
def stage_times(spark, sf_dir):
    return stats.stage_times(_samples(spark, sf_dir))


@query("resource_requirements", """, r AS (SELECT provider, sum(api_calls) AS c, sum(total_tokens) AS t, sum(duration_seconds) AS d,
    sum(cin + cout) AS cost, sum(total_tokens) * 4 / 1e9 AS gb FROM cost GROUP BY provider)
  SELECT provider, c::BIGINT AS total_api_calls, round(t, 3) AS total_tokens, round(t / c, 6) AS tokens_per_api_call, round(t / d, 6) AS tokens_per_second,
    round(cost, 6) AS cost_estimate_usd, (SELECT max(cpu) FROM samples) AS max_cpu_percent, (SELECT max(mem) FROM samples) AS max_memory_percent,
    (SELECT greatest(max(g0), max(g1)) FROM samples) AS max_gpu_memory_percent, round(t / gb, 0) AS tokens_per_gb,
    round(CASE WHEN cost <> 0 THEN cost / gb END, 3) AS cost_per_gb FROM r""", "cost", "samples")
def resource_requirements(spark, sf_dir):
    priced = costs.cost_estimate(_runs(spark, sf_dir))
    samples = _samples(spark, sf_dir)
    peaks = stats.resource_summary(samples)
    gpu = stats.gpu_summary(samples)
    runs = priced.groupBy("provider").agg(
        F.sum("api_calls").alias("total_api_calls"), F.sum("total_tokens").alias("total_tokens"),
        F.sum("duration_seconds").alias("total_duration_seconds"), F.sum("total_cost").alias("cost")
    ).withColumns({
        "input_file_size_gb": F.col("total_tokens") * 4 / 1e9,
        "max_cpu_percent": peaks.select("cpu_percent_max").scalar(),
        "max_memory_percent": peaks.select("memory_percent_max").scalar(),
        "max_memory_gb": peaks.select("memory_used_gb_max").scalar(),
        "max_gpu_memory_mb": gpu.agg(F.max("memory_allocated_mb_max")).scalar(),
        "max_gpu_memory_percent": gpu.agg(F.max("memory_used_percent_max")).scalar()})
    need = costs.resource_requirements(runs, ["provider"])
    digits = {"total_tokens": 3, "tokens_per_api_call": 6, "tokens_per_second": 6, "cost_estimate_usd": 6, "tokens_per_gb": 0, "cost_per_gb": 3}
    return need.withColumns({c: F.round(c, d) for c, d in digits.items()}).select(
        "provider", "total_api_calls", "total_tokens", "tokens_per_api_call", "tokens_per_second", "cost_estimate_usd",
        "max_cpu_percent", "max_memory_percent", "max_gpu_memory_percent", "tokens_per_gb", "cost_per_gb")
