"""Reply parsing, combining, chains, evaluation and scoring on hand-made rows and random cases."""

from __future__ import annotations

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from logloom.operators import chains, evaluation, findings, reports, scoring, timeline
from logloom.plans import analysis
from logloom.plans.offline_scorer import failed_action_scorer, summary_scorer

REPLY = """Some words first:

```json
{
  "identified_threats": [
    {"threat_id": "t-one", "threat_type": "Odd Login", "related_events": ["ev-a", "ev-b"], "severity": "Medium",
     "confidence": "Medium", "description": "Login at night."},
    {"threat_id": "t-two", "threat_type": "Strange Tool", "related_events": ["ev-c", "ev-d", "ev-e"], "severity": "High",
     "confidence": "High", "description": "Tool nobody knows."}
  ],
  "suspicious_patterns": [{"pattern_id": "p-one", "pattern_type": "Night work", "related_events": ["ev-a"], "description": "d"}],
  "risk_assessment": {"overall_risk_level": "High", "reasoning": "r"},
  "recommendations": ["a", "b"],
  "limitations": ["c"]
}
```
"""


def parsed(spark, *replies):
    rows = [(i, r, None) for i, r in enumerate(replies)]
    return scoring.parse_replies(spark.createDataFrame(rows, "chunk_idx long, reply string, error string"))


def test_reply_parsing(spark):
    rows = parsed(spark, REPLY, "no braces", "{broken", "} before {", '{"a": 1} and a brace }').orderBy("chunk_idx").collect()
    assert rows[0].parsing_error is None and len(rows[0].findings.identified_threats) == 2
    assert rows[0].findings.identified_threats[0].threat_id == "t-one"
    assert rows[0].findings.risk_assessment.overall_risk_level == "High"
    assert [r.parsing_error for r in rows[1:]] == ["No JSON found in response"] * 2 + ["JSON parsing error"] * 2
    assert rows[1].raw_text == "no braces"


def threat(id_, severity="Low", events=("e",), kind="T"):
    return {"threat_id": id_, "threat_type": kind, "related_events": list(events), "severity": severity, "confidence": "High",
            "description": "d"}


def test_combine_two_chunks(spark):
    one = {"identified_threats": [threat("t-one", "Medium", ["ev-a", "ev-b"])], "suspicious_patterns": [],
           "recommendations": ["x"], "limitations": ["l1"]}
    two = {"identified_threats": [threat("t-two", "High", ["ev-c", "ev-d"])],
           "suspicious_patterns": [{"pattern_id": "p-one", "pattern_type": "p", "related_events": ["ev-c"], "description": "d"}],
           "recommendations": ["y"], "limitations": ["l2"]}
    p = parsed(spark, json.dumps(one), json.dumps(two))
    kept = findings.combine_threats(scoring.explode_threats(p)).orderBy("idx").collect()
    assert [(r.threat_id, r.source_chunk) for r in kept] == [("t-one", 0), ("t-two", 1)]
    assert findings.combine_patterns(scoring.explode_patterns(p)).count() == 1
    texts = scoring.text_lists(p)
    assert findings.distinct_texts(texts, "recommendations").count() == 2
    assert findings.distinct_texts(texts, "limitations").count() == 2


def test_combine_repeats_blanks_and_failures(spark):
    def reply(*threats):
        return json.dumps({"identified_threats": list(threats)})

    p = parsed(spark, reply(threat("t1", kind="first"), threat("")), "nothing", reply(threat("t1", kind="second"), threat(None)))
    kept = findings.combine_threats(scoring.explode_threats(p)).orderBy("idx").collect()
    assert [(r.threat_id, r.threat_type) for r in kept] == [("t1", "first"), ("gen-0-1", "T"), ("gen-2-1", "T")]


def test_chunk_failures(spark):
    p = parsed(spark, REPLY, "nothing")
    states = scoring.chunk_failures(spark.range(3).select(F.col("id").alias("chunk_idx")), p)
    rows = states.orderBy("chunk_idx").collect()
    assert [(r.failed, r.threats, r.overall_risk_level) for r in rows] == [(False, 2, "High"), (True, 0, "Unknown"), (True, 0, "Unknown")]
    assert scoring.run_state(states).first().all_failed is False
    assert scoring.run_state(states.filter("failed")).first().error == "All chunks failed to process"


def test_scoring_retries_and_errors(spark):
    def scorer(prompt):
        if "bad" in prompt:
            raise RuntimeError("no answer")
        return prompt.upper()

    prompts = spark.createDataFrame([(0, "good"), (1, "bad"), (2, "x" * 50)], "chunk_idx long, prompt string")
    waits = []
    rows = scoring.score_chunks(prompts, scorer, budget=20, sleep=waits.append).orderBy("chunk_idx").collect()
    assert [(r.reply, r.error, r.attempts) for r in rows] == [
        ("GOOD", None, 1), (None, "no answer", 3), (None, "prompt of 50 characters is over the budget", 0)]
    assert rows[0].tokens == 2.0
    done = scoring.pending_chunks(prompts, scoring.score_chunks(prompts, scorer, budget=20, sleep=waits.append))
    assert sorted(r.chunk_idx for r in done.collect()) == [1, 2]


def test_final_summary_fallbacks(spark):
    def summary(reply, found):
        scored = spark.createDataFrame([(0, reply, None)], "chunk_idx long, reply string, error string")
        row = scoring.final_summary(scored, F.lit(found)).first()
        return row.conclusion, row.confidence

    assert summary('{"conclusion": "c", "confidence": "High", "key_indicators": ["k"]}', 1) == ("c", "High")
    assert summary("no json", 1) == ("Analysis complete but summary parsing failed", "Low")
    assert summary("{broken}", 1) == ("Analysis complete but summary parsing failed", "Low")
    assert summary("anything", 0) == ("No significant threats detected", "Medium")


def greedy(threats):
    """Plain model of the order-dependent chains."""
    head = {}
    for i, events in enumerate(threats):
        if i in head:
            continue
        head[i] = i
        for j, other in enumerate(threats):
            if j not in head and events & other:
                head[j] = i
    return head


def components(threats):
    label = list(range(len(threats)))
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(range(len(threats)), 2):
            if threats[a] & threats[b] and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return dict(enumerate(label))


def random_threats(seed):
    rnd = random.Random(seed)
    n, events = rnd.randint(1, 40), rnd.randint(1, 60)
    return [set(rnd.sample(range(events), rnd.randint(0, min(3, events)))) for _ in range(n)]


def frames(spark, threats):
    t = spark.createDataFrame([(i, f"t{i}", "Low") for i in range(len(threats))], "idx long, threat_id string, severity string")
    rows = [(i, f"t{i}", f"e{e}") for i, s in enumerate(threats) for e in s]
    return t, spark.createDataFrame(rows, "idx long, threat_id string, event_id string")


@pytest.mark.parametrize("threats", [*map(random_threats, range(4)), [{i, i + 1} for i in range(12)], [set(), set()], [{1}] * 5])
def test_chains_equal_model(spark, threats):
    t, links = frames(spark, threats)
    got = {r.idx: r.head for r in chains.assign_chains(t, links).collect()}
    assert got == greedy(threats)
    assert {r.idx: r.head for r in chains.connected_chains(t, links).collect()} == components(threats)


@pytest.mark.parametrize("rows", [1000, 20])
def test_long_runs_by_groups(spark, monkeypatch, rows):
    """Runs of overlapping threats in one stretch and in many, with a threat larger than a stretch."""
    monkeypatch.setattr(chains, "STRETCH_ROWS", rows)
    rnd = random.Random(rows)
    threats = [{i, i + 1} | ({i + 2} if rnd.random() < 0.3 else set()) for i in range(45)] + [{0, 44}, {90}, {90, 12}, set(range(40, 75)), {74, 80}]
    t, links = frames(spark, threats)
    assert {r.idx: r.head for r in chains.assign_chains(t, links).collect()} == greedy(threats)


@pytest.mark.parametrize(("rows", "steps"), [(1_000_000, 1), (30_000, 4)])
def test_unbroken_run_needs_few_rounds(spark, monkeypatch, rows, steps):
    """One run of overlapping threats over 50,000 chunks takes one job per stretch of its 100,000 rows."""
    rounds = []
    monkeypatch.setattr(chains, "STRETCH_ROWS", rows)
    monkeypatch.setattr(chains, "stage", lambda df, label, keep=chains.stage: rounds.append(label) or keep(df, label))
    ids = spark.range(50000).select(F.col("id").alias("idx"))
    links = ids.select("idx", F.explode(F.array(F.col("idx").cast("string"), (F.col("idx") + 1).cast("string"))).alias("event_id"))
    heads = chains.assign_chains(ids, links)
    assert heads.where("idx % 2 = 0 AND head <> idx OR idx % 2 = 1 AND head <> idx - 1").count() == 0
    assert heads.count() == 50000 and rounds.count("chain-rest") == steps


def test_event_of_many_findings(spark):
    """25,000 threats on one event are one timeline row and 25,000 links."""
    events = spark.createDataFrame([("e1", "p", None, "h", "u", 3, "t"), ("e2", "p", None, "h", "u", 3, "t")],
                                   "event_id string, process_name string, command_line string, hostname string, username string, severity int, event_type string")
    events = events.withColumn("timestamp", F.lit("2025-01-01").cast("timestamp"))
    links = spark.range(25000).select(F.concat(F.lit("t"), "id").alias("threat_id"), F.lit("e1").alias("event_id"))
    patterns = spark.createDataFrame([("p1", "e2"), ("p1", "e2")], "pattern_id string, event_id string")
    rows = timeline.timeline(events, links, patterns)
    assert sorted((r.event_id, r.threat_count, r.pattern_count) for r in rows.collect()) == [("e1", 25000, 0), ("e2", 0, 1)]
    assert timeline.timeline_links(links, patterns).count() == 25001
    assert {r.remaining for r in timeline.timeline_head(rows, 1).collect()} == {1}


@pytest.mark.parametrize("parts", [0, 1, 2, 450])
def test_summaries_fold_to_one(spark, parts):
    rows = [(i, f'{{"conclusion": "{i % 3} threat lines, 1 limitation lines", "confidence": "High"}}', None) for i in range(parts)]
    scored = spark.createDataFrame(rows, "chunk_idx long, reply string, error string")
    score = lambda p: scoring.score_chunks(p, summary_scorer, budget=None)
    folded = scoring.fold_summaries(scored, F.lit("a\n\nb"), score)
    row = scoring.final_summary(folded, F.lit(1)).collect()
    assert [r.conclusion for r in row] == [f"{sum(i % 3 for i in range(parts))} threat lines, {parts} limitation lines"]


def test_chain_headers(spark):
    t = spark.createDataFrame([(0, "a", "Low", "X"), (5, "b", "High", "Y"), (9, "c", "Critical", "X"), (11, "d", None, "X")],
                              "idx long, threat_id string, severity string, threat_type string")
    links = spark.createDataFrame([(0, "a", "e1"), (5, "b", "e1"), (5, "b", "e2"), (9, "c", "e3")], "idx long, threat_id string, event_id string")
    patterns = spark.createDataFrame([("p", "e2"), ("p", "e3"), ("q", "e9")], "pattern_id string, event_id string")
    assignment = chains.assign_chains(t, links)
    members = chains.chain_threats(assignment, t, chains.number_chains(assignment))
    events = chains.chain_events(members, links)
    header = chains.chain_headers(members, events, chains.chain_patterns(events, patterns))
    rows = [tuple(r)[1:] for r in chains.by_severity(header).collect()]
    assert rows == [("chain-1", "High", 2, 2, 1), ("chain-3", "Low", 1, 0, 0), ("chain-2", "Critical", 1, 1, 1)]
    text = reports.attack_summary(t, header, members).first()[0]
    assert text.startswith("Analysis identified a high severity attack chain involving 2 connected threats. The attack chain "
                           "involves 1 X, 1 Y, beginning with X and progressing to Y.")


def test_attack_summary_without_chains(spark):
    t = spark.createDataFrame([(0, "a", "High", "X"), (1, "b", "High", "Y")], "idx long, threat_id string, severity string, threat_type string")
    members = spark.createDataFrame([], "chain_no long, chain_id string, idx long, threat_type string, is_head boolean")
    header = spark.createDataFrame([], "chain_no long, chain_id string, severity string, threat_count long")

    def text(threats):
        return reports.attack_summary(threats, header, members).first()[0]

    assert text(t) == ("Analysis identified 2 high severity threats including X, Y. However, no clear attack chain was established.")
    assert text(t.limit(0)) == "No significant threats identified in the analyzed data."
    assert text(t.withColumn("severity", F.lit("Low"))) == (
        "Analysis identified 2 potential threats but no clear attack patterns were established.")


def test_correlated_sets_equal_brute_force(spark):
    rnd = random.Random(5)
    sets = [frozenset(rnd.sample(range(12), rnd.randint(1, 5))) for _ in range(60)]
    rows = [(f"t{i:02d}", f"e{e}") for i, s in enumerate(sets) for e in s]
    links = spark.createDataFrame(rows, "threat_id string, event_id string")
    got = 0
    for row in chains.correlated_sets(links, "threat_id", 0.5).collect():
        got += row.findings_a * (row.findings_a - 1) // 2 if row.set_a == row.set_b else row.findings_a * row.findings_b
    want = sum(1 for a, b in itertools.combinations(sets, 2) if len(a & b) / len(a | b) >= 0.5)
    assert got == want


@pytest.mark.parametrize("threshold", [0.25, 0.5, 0.75, 1.0])
def test_correlated_sets_with_a_hot_event(spark, monkeypatch, threshold):
    """One event in a third of all sets, in blocks; and sets whose hash sums are made equal stay apart."""
    monkeypatch.setattr(chains, "EVENT_BLOCK", 7)
    rnd = random.Random(8)
    sets = [frozenset(rnd.sample(range(30), rnd.randint(1, 6)) + ([99] if i % 3 == 0 else [])) for i in range(90)] + [frozenset([99])] * 4
    rows = [(f"t{i:02d}", f"e{e:02d}") for i, s in enumerate(sets) for e in s]
    found = chains.correlated_sets(spark.createDataFrame(rows, "threat_id string, event_id string"), "threat_id", threshold).collect()
    got = {(r.set_a, r.set_b): (r.shared, r.findings_a, r.findings_b) for r in found if r.set_a != r.set_b}
    first = {s: min(i for i, o in enumerate(sets) if o == s) for s in sets}
    want = {(f"t{first[a]:02d}", f"t{first[b]:02d}"): (len(a & b), sets.count(a), sets.count(b))
            for a, b in itertools.combinations(sorted(first, key=first.get), 2) if len(a & b) >= threshold * len(a | b)}
    assert len(found) == len(got) + sum(sets.count(s) > 1 for s in first) and got == want


def test_sets_that_only_look_equal(spark, monkeypatch):
    monkeypatch.setattr(chains.F, "xxhash64", lambda *c: F.lit(1).cast("long"))
    links = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "2"), ("b", "3"), ("c", "1"), ("c", "2")], "threat_id string, event_id string")
    rows = chains._distinct_sets(links, "threat_id").collect()
    assert sorted((r.threat_id, r.set_id) for r in rows) == [("a", "a"), ("b", "b"), ("c", "a")]


@pytest.mark.parametrize(("wide", "tile", "types"), [(10, 1024, 4096), (3, 5, 2), (0, 16, 3)])
def test_chunk_pairs_equal_brute_force(spark, monkeypatch, wide, tile, types):
    """One tile, and many with few types at a time."""
    monkeypatch.setattr(evaluation, "TILE_SETS", tile)
    monkeypatch.setattr(evaluation, "TILE_TYPES", types)
    rnd = random.Random(wide)
    sets = [frozenset(rnd.sample("ABCDEFGH", rnd.randint(1, 6))) for _ in range(50)] + [frozenset("ABC")] * 6
    rows = [(i, t) for i, s in enumerate(sets) for t in s for _ in range(rnd.randint(1, 2))]
    threats = spark.createDataFrame(rows, "source_chunk long, threat_type string")
    want: dict[tuple, int] = {}
    for a, b in itertools.combinations(sets, 2):
        key = (*sorted((len(a), len(b))), len(a & b))
        want[key] = want.get(key, 0) + 1
    got = {(r.types_a, r.types_b, r.shared_types): r.pairs for r in evaluation.chunk_pairs(threats).collect()}
    assert got == want
    mean = sum(len(a & b) / len(a | b) for a, b in itertools.combinations(sets, 2)) / (len(sets) * (len(sets) - 1) / 2)
    assert evaluation.chunk_similarity(threats).first().avg_chunk_similarity == pytest.approx(mean)


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "chunk_idx long, source_chunk long, threat_id string, threat_type string, severity string, idx long")
    assert reports.risk_assessment(none).first().overall_risk_level == "Minimal"
    assert [r.n for r in reports.severity_distribution(none).collect()] == [0, 0, 0]
    assert evaluation.chunk_similarity(none).first().avg_chunk_similarity == 0
    spans = spark.createDataFrame([], "chain_no long, threats long, chunks long")
    assert evaluation.memory_metrics(spans, F.lit(0), F.lit(0)).first().memory_limitation_score == 1.0


def test_whole_analysis(spark, small):
    from logloom.plans.adapter import load_events

    events = load_events(spark, small)
    result = analysis.analyze(events, failed_action_scorer, summarize=summary_scorer)
    chunks = result["run_state"].first()
    assert chunks.chunks == 25 and chunks.failed_chunks == 0
    alerts = events.filter("event_type = 'alert'")
    assert result["timeline"].select("event_id").distinct().count() == alerts.count()
    assert result["threats"].count() == 25 and result["risk"].first().reasoning.startswith("Based on 25 identified threats across 25")
    assert result["chains"].agg(F.sum("threat_count")).first()[0] == 25


def test_resume_scores_only_what_failed(spark, small):
    """A second run scores the failed chunk alone, and ends with the findings of an undisturbed run."""
    from logloom.plans.adapter import load_events

    events = load_events(spark, small).where("event_no < 200")

    def flaky(prompt):
        if "slice number 2." in prompt:
            raise RuntimeError("down")
        return failed_action_scorer(prompt)

    def only_second(prompt):
        assert "slice number 2." in prompt
        return failed_action_scorer(prompt)

    first = analysis.analyze(events, flaky, summarize=summary_scorer)
    assert first["run_state"].first().failed_chunks == 1
    second = analysis.analyze(events, only_second, stored=first["replies"], summarize=summary_scorer)
    whole = analysis.analyze(events, failed_action_scorer, summarize=summary_scorer)
    assert second["run_state"].first().failed_chunks == 0
    ids = lambda result: sorted(r.threat_id for r in result["threats"].collect())
    assert ids(second) == ids(whole) and ids(first) != ids(whole)
    assert second["summary"].collect() == whole["summary"].collect() and second["summary"].count() == 1
    assert second["totals"].first().chunks_processed == whole["totals"].first().chunks_processed


def test_chain_with_a_million_types(spark):
    """Types of a chain are rows with a place; the text names some and counts the others."""
    n = 1_000_000
    ids = spark.range(n).select(F.col("id").alias("idx"), F.lit(1).alias("chain_no"), F.lit("chain-1").alias("chain_id"), (F.col("id") == 7).alias("is_head"),
                                F.concat(F.lit("type "), F.col("id")).alias("threat_type"))
    members = ids.unionByName(spark.createDataFrame(
        [(0, 2, "chain-2", True, "b"), (1, 2, "chain-2", False, None), (2, 2, "chain-2", False, "b")],
        "idx long, chain_no int, chain_id string, is_head boolean, threat_type string"))
    types = reports.chain_types(members)
    assert types.count() == n + 2
    assert [(r.place, r.threat_type) for r in types.where("chain_no = 1 and place < 3").orderBy("place").collect()] == [(0, "type 7"), (1, "type 0"), (2, "type 1")]
    rows = {r.chain_no: r for r in reports.chain_type_summary(members, named=3).collect()}
    assert (rows[1].types, rows[1].types_left_out) == (f"1 type 7, 1 type 0, 1 type 1 and {n - 3} more types", n - 3)
    assert (rows[1].first_type, rows[1].last_type) == ("type 7", f"type {n - 1}")
    assert (rows[2].types, rows[2].types_left_out, rows[2].last_type) == ("2 b, 1 Unknown", 0, "b")
