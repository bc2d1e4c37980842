from __future__ import annotations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from logloom.llm import simhash


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + n]), 42) for i in range(len(words) - n + 1)]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """doc_id and text rows to the smallest id reachable, by comparing all pairs."""
    prints = [plain_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                parent[root(i)] = root(j)
    smallest = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            smallest[root(i)] = min(doc, smallest.get(root(i), doc))
    return sorted(((d, format(p, "016x"), smallest.get(root(i))) for i, ((d, _), p) in enumerate(zip(rows, prints, strict=True))), key=repr)


def check(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    found = simhash.near_duplicates(docs)
    assert found.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain_components(rows)


def test_documents(documents):
    check(documents)


def test_odd_rows(odd, empty):
    check(odd)
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("chunk", [8192, 7])
def test_links_span_close_pairs(spark, monkeypatch, chunk):
    """Random fingerprints in dense groups, chains and alone; with small chunks every long key is cut."""
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rng = np.random.default_rng(1)
    values = set()
    for _ in range(6):
        x = int(rng.integers(0, 1 << 63))
        for _ in range(30):
            flips = rng.choice(64, rng.integers(0, 4), replace=False)
            values.add(x ^ sum(1 << int(b) for b in flips))
            if rng.random() < 0.3:
                x ^= sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
    values |= {int(v) for v in rng.integers(0, 1 << 63, 100)}
    values = sorted(values)
    signed = [v - (1 << 64) if v >= 1 << 63 else v for v in values]
    prints = spark.createDataFrame(list(zip(signed, range(len(values)), strict=True)), "fp bigint, i bigint")
    prints = prints.select("fp", F.struct(F.lit(False).alias("missing"), F.col("i").alias("id")).alias("node"))
    links = {(r["a"]["id"], r["b"]["id"]) for r in simhash.near_links(prints).collect()}

    def groups(pairs):
        label = list(range(len(values)))
        for a, b in pairs:
            old, new = label[a], label[b]
            label = [new if x == old else x for x in label]
        return [label.index(x) for x in label]

    close = [(i, j) for i in range(len(values)) for j in range(i) if bin(values[i] ^ values[j]).count("1") <= 3]
    assert groups(links) == groups(close)


def test_long_text_in_parts(monkeypatch):
    text = ("some words that go on " * 50).encode()
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "HASHES_AT_ONCE", 17)
    assert simhash.fingerprint(text) == whole == plain_fingerprint(text.decode())


def test_one_of_each_group_stays(documents, odd):
    kept = [r["doc_id"] for r in simhash.keep_one_per_group(documents).collect()]
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    assert sorted(kept) == sorted({c for _, _, c in plain_components(rows)})
    out = simhash.keep_one_per_group(odd)
    assert out.columns == odd.columns
    ids = [r["doc_id"] for r in out.collect()]
    assert len(ids) == len(set(ids)) and None in ids
