"""Recommendations and limitations come from one reading of the replies."""

from __future__ import annotations

from logloom.plans import findings_queries


def _events(spark, path, n=300):
    words = ["error", "click", "view", "signup", "purchase"]
    rows = [(i, i % 7, words[i % 5], float(i), '{"k": %d}' % (i % 90)) for i in range(n)]
    made = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string")
    made.selectExpr("event_id", "timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, event_id) AS ts", "user_id", "event_type",
                    "value", "props").write.parquet(f"{path}/events.parquet")
    return str(path)


def test_replies_are_parsed_once_for_both_kinds(spark, tmp_path):
    found = findings_queries.distinct_recommendations(spark, _events(spark, tmp_path / "d"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    rows = [tuple(r) for r in found.collect()]
    assert len(set(rows)) == len(rows) and {kind for kind, _ in rows} == {"recommendation", "limitation"}
    assert all(text.startswith("Review " if kind == "recommendation" else "Context limited to ") for kind, text in rows)
    assert ("limitation", "Context limited to 50 events") in rows
