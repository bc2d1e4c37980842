from __future__ import annotations

import re
from collections import Counter, defaultdict

import pytest

from logloom.llm import collocations
from logloom.llm.queries import op11_collocations

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain(rows, least=10, longest=3, cover=50, first=2000):
    """The contract word for word, on (lang, text) rows."""
    total, found, out = Counter(), defaultdict(Counter), set()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for m in range(1, longest + 1):
                found[lang].update(tuple(words[i:i + m]) for i in range(len(words) - m + 1))
    for lang, f in found.items():
        candidates = {p: a for p, a in f.items() if a >= least and len(p) > 1}
        longer = defaultdict(int)
        for p, a in candidates.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longer[p[i:i + m]] = max(longer[p[i:i + m]], a)
        scored = []
        for p, a in candidates.items():
            if p not in longer or 100 * longer[p] < cover * a:
                score, k = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out |= {(lang, i, p.decode(), -a, left, right, total[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:first], 1)}
    return out


def rows_of(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return {tuple(r) for r in df.collect()}


def test_query_equals_plain_count(spark, small, documents):
    want = plain([(r["lang"], r["text"]) for r in documents.collect()])
    assert want and rows_of(op11_collocations(spark, small)) == want


@pytest.mark.parametrize(("entries", "burst"), [(300, 5), (5000, 64)])
def test_spills_and_bursts_change_nothing(documents, entries, burst):
    """A trie that is always full and containers that always burst: many runs for each partition."""
    want = plain([(r["lang"], r["text"]) for r in documents.collect()], least=4, first=50)
    assert rows_of(collocations.collocations(documents.repartition(3), least=4, first=50, entries=entries, burst=burst)) == want


def test_many_partitions(documents, monkeypatch):
    monkeypatch.setattr(collocations, "PARTITION_BYTES", 10_000)
    want = plain([(r["lang"], r["text"]) for r in documents.collect()], longest=2)
    assert rows_of(collocations.collocations(documents, longest=2)) == want


def test_odd_rows(odd, empty):
    want = plain([(r["lang"], r["text"]) for r in odd.collect()], least=2)
    assert {p for _, _, p, *_ in want} >= {"same text here"} and rows_of(collocations.collocations(odd, least=2)) == want
    assert collocations.collocations(empty).collect() == []
    with pytest.raises(ValueError):
        collocations.phrase_counts(odd, longest=4)


def test_signs_and_control_characters(spark):
    texts = ["A\x01 b a\x01 B\x0bc\x0cd\re,f;g:h!i?j k\tl  m", "é É e f é É", "a" * 5000 + " b. b " + "a" * 5000, "x x x x x x", "a b " * 50] * 3
    rows = [(None, t) for t in texts] + [("\t\n", "x y x y"), ("", "x y x y")]
    df = spark.createDataFrame(rows, "lang string, text string")
    assert rows_of(collocations.collocations(df, least=2)) == plain(rows, least=2)


def test_exact_arithmetic_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    cases = [(10 ** 14 + 7, 3 * 10 ** 14 + 1, 2 * 10 ** 14 + 9), (999_999_999_999_999, 999_999_999_999_999, 999_999_999_999_999), (10, 10, 10)]
    df = spark.createDataFrame(cases, "a bigint, l bigint, r bigint")
    got = [r[0] for r in df.select(collocations.score_of(F.col("a"), F.col("l"), F.col("r"))).collect()]
    assert got == [1000000 * a * a // (left * right) for a, left, right in cases]


def test_ties_go_to_the_phrase(spark):
    df = spark.createDataFrame([("en", " , ".join(["zeta one", "Älpha one", "beta one"] * 5))], "lang string, text string")
    got = sorted(rows_of(collocations.collocations(df, least=5)), key=lambda r: r[1])
    assert [r[2] for r in got] == ["beta one", "zeta one", "Älpha one"]
