from __future__ import annotations

import math
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.llm import neighbours


def plain(rows, k=5, every=50):
    best = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        key = [float(x) for x in v]
        best[i] = min(best.get(i, key), key)
    size = {i: math.sqrt(sum(x * x for x in v)) for i, v in best.items()}
    out = []
    for q in (i for i in best if i % every == 0):
        found = sorted((-sum(map(lambda a, b: a * b, best[q], best[c])) / (size[q] * size[c]), c) for c in best if c != q and len(best[c]) == len(best[q]))
        out += [(q, r + 1, c) for r, (_, c) in enumerate(found[:k])]
    return sorted(out)


def answer(spark, rows, kind="float"):
    table = spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>").withColumn("score", F.lit("clash"))
    found = neighbours.nearest(table, F.col("vec_id") % 50 == 0)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    return found.collect()


@pytest.mark.parametrize("values", [1 << 20, 3000])
def test_against_all_pairs(spark, monkeypatch, values):
    monkeypatch.setattr(neighbours, "BLOCK_VALUES", values)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 24)).astype(np.float32)
    rows = [(i, (base[i % 40] + (0 if i % 3 else 0.2) * rng.normal(size=24)).astype(np.float32).tolist()) for i in range(400)]
    rows += [(400 + i, base[7].tolist()) for i in range(300)]
    rows = [(int(i), v) for i, v in rows]
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in answer(spark, rows)) == plain(rows)


def test_scores_are_cosines(spark, small):
    table = spark.read.parquet(f"{small}/embeddings.parquet")
    vectors = {r["vec_id"]: np.array(r["embedding"], float) for r in table.collect()}
    rows = neighbours.nearest(table, F.col("vec_id") % 50 == 0).collect()
    assert len(rows) == 5 * sum(i % 50 == 0 for i in vectors)
    for r in rows:
        a, b = vectors[r["query_id"]], vectors[r["vec_id"]]
        assert abs(r["score"] - a @ b / math.sqrt(a @ a) / math.sqrt(b @ b)) < 1e-12


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [-1.0, 0.0]),
            (9, [1.0, 1.0, 1.0]), (50, [0.5, 0.5]), (50, [0.1, 0.9]), (None, [1.0, 0.0]), (100, [3.0, 3.0, 3.0]), (150, [1.0]), (1, [1.0, 0.0])]
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in answer(spark, rows, "double")) == plain(rows)
    assert answer(spark, rows[:0]) == []


def test_bounds_hold():
    """No pair's true cosine lies outside what its int8 product allows, so pruning loses nothing."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 2500)) * rng.lognormal(size=(60, 1)) ** 3
    ids = np.arange(60)
    q, c, s = neighbours.tile_nearest(ids[:5] + 1000, x[:5], ids, x, 4)
    unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    for i in range(5):
        assert sorted(c[q == 1000 + i]) == sorted(np.argsort(-(unit @ unit[i]), kind="stable")[:4])


def test_tile_memory_is_bounded():
    """A tile's pairs are compared in steps: 4,000 queries and 8,000 candidates have a matrix of 256 MB in doubles."""
    rng = np.random.default_rng(5)
    x, ids = rng.normal(size=(8000, 8)).astype(np.float32), np.arange(8000)
    tracemalloc.start()
    q, c, s = neighbours.tile_nearest(ids[:4000], x[:4000], ids, x, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(s) == 12000 and peak < 100 << 20


def test_many_tiles_in_steps(spark, monkeypatch):
    """Several query blocks and steps, copies of one vector in most steps, and vectors of two lengths."""
    for name, value in (("BLOCK_VALUES", 3000), ("QUERY_VALUES", 1600), ("CANDIDATES_PER_QUERY", 1), ("STEP_ROWS", 50), ("PAIRS_AT_ONCE", 700),
                        ("VALUES_AT_ONCE", 100)):
        monkeypatch.setattr(neighbours, name, value)
    rng = np.random.default_rng(6)
    rows = [(int(i), rng.normal(size=24 if i % 7 else 16).tolist()) for i in rng.permutation(9000)[:900]]
    rows = [(i, [1.0] * 24 if n % 3 == 0 else v) for n, (i, v) in enumerate(rows)] + [(50 * n + 20000, rng.normal(size=16).tolist()) for n in range(250)]
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in answer(spark, rows, "double")) == plain(rows)
