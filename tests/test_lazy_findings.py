"""Tables of findings are built when asked for."""

from __future__ import annotations

from logloom.plans import rule_findings, scoring_queries


def _events(spark, path, n=300):
    words = ["error", "click", "view", "signup", "purchase"]
    rows = [(i, i % 7, words[i % 5], float(i), '{"k": %d}' % (i % 90)) for i in range(n)]
    made = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string")
    made.selectExpr("event_id", "timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, event_id) AS ts", "user_id", "event_type",
                    "value", "props").write.parquet(f"{path}/events.parquet")
    return str(path)


def _labels(monkeypatch, module):
    labels, real = [], module.stage
    monkeypatch.setattr(module, "stage", lambda df, label: labels.append((label, df.columns)) or real(df, label))
    return labels


def test_threats_build_nothing_else(spark, tmp_path, monkeypatch):
    folder = _events(spark, tmp_path / "t")
    labels = _labels(monkeypatch, rule_findings)
    found = rule_findings.load_findings(spark, folder)
    assert found.threats.count() > 0
    assert [name for name, _ in labels] == ["hits", "raw-findings", "threats"]
    assert found.threats is rule_findings.load_findings(spark, folder).threats
    chains = rule_findings.load_chains(spark, folder)
    assert chains.members.count() == found.threats.count()
    assert {name for name, _ in labels} == {"hits", "raw-findings", "threats", "links", "assignment", "members"}


def test_links_name_every_event_of_a_threat(spark, tmp_path):
    found = rule_findings.load_findings(spark, _events(spark, tmp_path / "l"))
    counted = {(r.chunk_idx, r.pos): r["count"] for r in found.raw_links.groupBy("chunk_idx", "pos").count().collect()}
    assert counted == {(r.chunk_idx, r.pos): r.n for r in found.raw_threats.collect()}


def test_summary_writes_what_its_head_shows(spark, tmp_path, monkeypatch):
    folder = _events(spark, tmp_path / "s")
    labels = _labels(monkeypatch, scoring_queries)
    assert scoring_queries.final_summary(spark, folder).count() == 1
    assert dict(labels)["timeline"] == ["event_id", "timestamp", "event_type", "description"]
