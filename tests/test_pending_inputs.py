"""Heads of input files are read once, and only pending files are read."""

from __future__ import annotations

from logloom.plans import source_queries


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


def test_pending_inputs_reads_heads_once(spark, tmp_path, monkeypatch):
    folder = _events(spark, tmp_path / "p", 450)
    labels = _labels(monkeypatch, source_queries)
    rows = {r.block: r.events for r in source_queries.pending_inputs(spark, folder).collect()}
    assert rows == {"block-1": 100, "block-3": 100}
    assert [name for name, _ in labels] == ["listing"]


def test_pending_inputs_leaves_out_events_without_a_number(spark, tmp_path):
    source = _events(spark, tmp_path / "a", 250)
    some = spark.read.parquet(f"{source}/events.parquet")
    some.selectExpr("CASE WHEN event_id < 240 THEN event_id END AS event_id", "ts", "user_id", "event_type", "value", "props").write.parquet(
        f"{tmp_path}/b/events.parquet")
    assert {r.block: r.events for r in source_queries.pending_inputs(spark, f"{tmp_path}/b").collect()} == {"block-1": 100}
