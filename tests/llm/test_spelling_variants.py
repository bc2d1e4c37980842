from __future__ import annotations

import random
import re
from collections import Counter
from zlib import crc32

import pytest

from logloom.llm import spelling_variants
from logloom.llm.queries import op13_spelling_variants

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_words(rows, least=3):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= least}


def plain_groups(words):
    """Every deletion, replacement and insertion of every word, looked up."""
    letters, form, near = sorted({c for w in words for c in w}), {}, {}
    for w in words:
        found = {w[:i] + w[i + 1:] for i in range(len(w))} | {w[:i] + c + w[i + 1:] for i in range(len(w)) for c in letters}
        found |= {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        known = [x for x in found - {w} if x in words]
        near[w], best = len(known), min(known, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, near[w], words[form[w]] if form[w] else None) for w, n in words.items()}


def rows_of(df):
    assert df.columns[:6] == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_query_equals_plain_search(spark, small, documents):
    want = plain_groups(plain_words([(r["doc_id"], r["text"]) for r in documents.collect()]))
    assert any(form for _, form, *_ in want) and rows_of(op13_spelling_variants(spark, small)) == want


@pytest.mark.parametrize("seed", range(3))
def test_dense_words(spark, seed):
    """Short words over few letters: nearly all are near each other, with repeated letters and ties."""
    rng = random.Random(seed)
    words = {"".join(rng.choice("aabcé") for _ in range(rng.randint(1, 6))): rng.choice([1, 2, 3, 5, 9, 20, 60]) for _ in range(700)}
    df = spark.createDataFrame([*words.items(), ("", 4), (None, 4)], "word string, n bigint").repartition(5)
    assert rows_of(spelling_variants.group_variants(df)) == plain_groups(words)


def test_words_over_many_partitions(spark, monkeypatch):
    """Paths that begin in earlier partitions: words with long common beginnings, one or two in each partition."""
    words = {"prefix" * 5 + "x" * i + e: 3 + 7 * i for i in range(40) for e in ("", "a", "ab")} | {"z" * 400: 9, "z" * 401: 30, "y" + "z" * 400: 4}
    df = spark.createDataFrame(list(words.items()), "word string, n bigint")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 61)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert rows_of(spelling_variants.group_variants(df)) == plain_groups(words)
        paths = spelling_variants.number_paths(df, "word", "path").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    nodes = {}
    for r in paths:
        for depth, number in enumerate(r["path"]):
            assert nodes.setdefault(number, r["word"][:depth]) == r["word"][:depth]
    assert len(nodes) == len({w[:d] for w in words for d in range(len(w) + 1)})
    assert [r["word"] for r in sorted(paths, key=lambda r: r["path"][-1])] == sorted(words)


def test_odd_rows(odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    want = plain_groups(plain_words(rows, least=1))
    assert any(len(w) >= 29_999 for w, *_ in want)
    assert rows_of(spelling_variants.spelling_variants(odd, least=1, counted=3)) == want
    assert spelling_variants.spelling_variants(empty).collect() == []
    with pytest.raises(ValueError):
        spelling_variants.group_variants(empty.selectExpr("text as word", "doc_id as n"), factor=1)


def test_long_ways_to_the_root(spark):
    words = {"a" * (5 + i): 2 ** (i + 2) for i in range(30)}
    df = spark.createDataFrame(list(words.items()), "word string, n bigint")
    got = rows_of(spelling_variants.group_variants(df))
    assert got == plain_groups(words) and {r[2] for r in got} == {"a" * 34}
