"""Chunk results lie in folders of a bounded number of files, and each comes back with its number."""

from __future__ import annotations

from pathlib import Path

from test_lazy_findings import _events

from logloom.plans import source_queries
from logloom.sources import results


def test_results_lie_in_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(source_queries, "INPUT_FILES", 2)
    folder = source_queries.store_results(spark, _events(spark, tmp_path / "r"))
    held = sorted((f.parent.name, f.name) for f in Path(folder).rglob("*.json"))
    assert held == sorted((str(n // 2), f"chunk_result_{n + 1}.json") for n in range(8))
    loaded = results.load_results(spark, folder)
    assert sorted(r.source_chunk for r in loaded.select("source_chunk").collect()) == list(range(8))
