"""Rejects come without sorting and numbering the events."""

from __future__ import annotations

from logloom.operators import ordering
from logloom.sources import files


def test_rejects_number_no_event(spark, tmp_path, monkeypatch):
    lines = ['{"event_id": "a", "timestamp": "2025-01-01T00:00:00"}', '{"event_id": "b", "timestamp": "soon"}', '{"event_id": "c"}', '{"event_id":']
    (tmp_path / "x.jsonl").write_text("\n".join(lines) + "\n")
    written, real = [], ordering.stage
    monkeypatch.setattr(ordering, "stage", lambda df, label: written.append(label) or real(df, label))
    found = sorted(map(tuple, files.load_rejects(spark, str(tmp_path)).select("line", "reason").collect()))
    assert found == [("soon", "unreadable time"), ('{"event_id":', "not a JSON line")] and not written
    events, rejects = files.load_events(spark, str(tmp_path))
    assert sorted(r.event_id for r in events.collect()) == ["a", "c"]
    assert sorted(map(tuple, rejects.select("line", "reason").collect())) == found
