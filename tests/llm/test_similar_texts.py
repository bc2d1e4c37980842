from __future__ import annotations

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.llm import similar_texts


def plain_sets(texts):
    found = []
    for text in texts:
        words = (text or "").encode().lower().split()
        n = min(5, len(words))
        found.append({tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if words else set())
    return found


def plain_kept(rows):
    """Smallest id of each component, by comparing all pairs of distinct ids."""
    rows = sorted(rows)
    sets, root = plain_sets([t for _, t in rows]), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if common >= 0.8 * (len(a) + len(sets[j]) - common):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [doc for i, (doc, _) in enumerate(rows) if find(i) == i]


def test_documents(documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    out = similar_texts.keep_one_per_group(documents)
    assert out.columns == documents.columns and sorted(r["doc_id"] for r in out.collect()) == plain_kept(rows)


@pytest.mark.parametrize("chunk", [256, 5])
def test_stage_finds_edited_copies(spark, small, monkeypatch, chunk):
    """Copies with single words exchanged, near the bar on both sides, in chains, dense groups and with a shared passage."""
    monkeypatch.setattr(similar_texts, "SET_CHUNK", chunk)
    monkeypatch.setattr(similar_texts, "CHUNK", 3 * chunk)
    rng = np.random.default_rng(3)
    word = lambda: "w" + str(rng.integers(0, 1 << 40))
    passage, rows = [word() for _ in range(60)], []
    for _ in range(12):
        words = [word() for _ in range(int(rng.integers(20, 300)))] + passage
        for _ in range(8):
            rows.append((len(rows), " ".join(words)))
            words = list(words)
            for at in rng.choice(len(words), max(1, int(len(words) * rng.choice([0.01, 0.02, 0.03]))), replace=False):
                words[at] = word()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = sorted(r["doc_id"] for r in corpus_pipeline.keep_first_copies(spark, docs, small).collect())
    assert kept == plain_kept(rows) and 12 <= len(kept) < 96


def test_odd_rows(odd, empty):
    out = similar_texts.keep_one_per_group(odd)
    ids = [r["doc_id"] for r in out.collect()]
    rows = {}
    for r in odd.where(F.col("doc_id").isNotNull()).collect():
        rows[r["doc_id"]] = min(r["text"] or "", rows.get(r["doc_id"], r["text"] or ""))
    assert out.columns == odd.columns and sorted(i for i in ids if i is not None) == plain_kept(rows.items()) and ids.count(None) == 1
    assert similar_texts.keep_one_per_group(empty).count() == 0


def test_a_large_group_of_copies_is_settled_by_its_first(spark, monkeypatch):
    """Members near the first document meet nobody else; one that is near another member only is still found."""
    monkeypatch.setattr(similar_texts, "SET_CHUNK", 16)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(words[:i % 280] + [f"x{i}"] + words[i % 280 + 1:])) for i in range(1, 400)]
    far = words[:150] + [f"y{i}" for i in range(17)] + words[167:]
    further = far[:-17] + [f"z{i}" for i in range(17)]
    rows += [(1000, " ".join(far)), (1001, " ".join(further)), (1002, " ".join(f"v{i}" for i in range(300)))]
    seen = []
    plain = similar_texts._left_to_meet
    monkeypatch.setattr(similar_texts, "_left_to_meet", lambda *a: seen.append(plain(*a)) or seen[-1])
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in similar_texts.keep_one_per_group(docs).collect()) == plain_kept(rows)
    tiles = seen[0].groupBy("doc_id").count().collect()
    assert not tiles or max(r["count"] for r in tiles if r["doc_id"] < 1000) <= 2


def test_fingerprints_make_candidates(spark):
    """Pairs of at most 3 differing bits are candidates without any band of minima."""
    words = [f"w{i}" for i in range(900)]
    texts = [" ".join(words[:i * 14] + [f"x{i}"] + words[i * 14 + 1:]) for i in range(60)] + [" ".join(words[:i * 10]) for i in range(60)]
    prints = similar_texts._prints(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), 5).where("n > 0").dropDuplicates(["hi", "lo"])
    rows = sorted((r["doc_id"], r["fp"] & ((1 << 64) - 1)) for r in prints.collect())
    root = {d: d for d, _ in rows}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, (a, x) in enumerate(rows):
        for b, y in rows[:i]:
            if (x ^ y).bit_count() <= 3:
                low, high = sorted((find(a), find(b)))
                root[high] = low
    links = similar_texts._fingerprint_links(prints.select("doc_id", "n", "fp"), 3)
    reached = {r["node"]: r["root"] for r in similar_texts.connected_components(links).collect()}
    assert reached and {d: reached.get(d, d) for d, _ in rows} == {d: find(d) for d, _ in rows}
