from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from logloom.llm import quality_rules as qr
from logloom.llm import textstats


def plain_base(text):
    text = text or ""
    matches = list(re.finditer(r"[^\x20\x09-\x0D]+", text))
    words = [m.group() for m in matches]
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for k in range(5)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered), n < 10 or 100 * len(covered) > 20 * n


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab é#\n\t\x0b|①", max_size=120))
def test_base_counts(text):
    n, chars, symbols, lines, repeats, _, _, failed, _ = qr.judge(text.encode(), "en", {})
    assert (n, chars, symbols, lines, repeats, failed) == plain_base(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=60))
def test_windows_by_number(words):
    n = len(words) - 4
    if n < 2:
        return
    counts = Counter(tuple(words[i:i + 5]) for i in range(n))
    assert textstats._repeated_by_number(words, 5).tolist() == [counts[tuple(words[i:i + 5])] > 1 for i in range(n)]


def test_distance_is_jensen_shannon():
    p, q = np.array([3.0, 0, 1]), np.array([10.0, 5, 5])
    a = p / p.sum()
    b = (q + qr.PRIOR) / (q + qr.PRIOR).sum()
    m = (a + b) / 2
    kl = lambda x: sum(v * math.log2(v / w) for v, w in zip(x, m, strict=True) if v)
    assert math.isclose(qr._distance(p, q), math.sqrt((kl(a) + kl(b)) / 2))
    assert qr._distance(p, np.array([3e9, 0, 1e9])) < 1e-4


def plain_histogram(text, lang):
    words = [w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))]
    common = [words.count(w) for w in qr.COMMON_WORDS[lang]]
    common += [0] * (qr.N_COMMON - len(common))
    return [*common, len(words) - sum(common)]


def test_references_are_sums_over_all_documents(documents):
    rows = documents.select("text", "lang").collect()
    found = qr.language_references(documents)
    assert set(found) == {r["lang"] for r in rows}
    for lang, sums in found.items():
        mine = [r["text"] or "" for r in rows if r["lang"] == lang]
        cut = len(textstats.CLASSES)
        assert sums[:cut].sum() == sum(map(len, mine))
        assert sums[cut - 10] == sum(len(re.findall("[A-Z]", t)) for t in mine)
        assert sums[cut:].tolist() == np.sum([plain_histogram(t, lang) for t in mine], axis=0).tolist()


def test_documents(documents, texts):
    for r in qr.judge_documents(documents.select("doc_id", "text", "lang")).collect():
        own = tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
        assert own == plain_base(texts[r["doc_id"]])
        if r["base_failed"]:
            assert not r["kept"]


def test_good_texts_stay_and_junk_goes(spark, small):
    larger = small.replace("0.001", "0.1")
    docs, labels = (spark.read.parquet(f"{larger}/{t}.parquet") for t in ("documents", "labels"))
    rows = qr.judge_documents(docs).join(labels, "doc_id").where("NOT base_failed AND n_words >= 40").select("kept", "quality").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1]
    junk = [r["kept"] for r in rows if r["quality"] == 0]
    assert len(good) > 1000 and np.mean(good) > 0.995
    assert len(junk) > 30 and np.mean(junk) < 0.5


def test_short_texts_are_left_alone(documents):
    references = qr.language_references(documents)
    text = ("zzz " * 4 + "one two three four five six seven eight nine").encode()
    assert qr.judge(text, "en", references)[-1]


def test_odd_rows(odd, empty):
    out = qr.judge_documents(odd)
    rows = out.collect()
    assert len(rows) == odd.count() and [c for c in out.columns if c == "kept"] == ["kept"]
    for r in rows:
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == plain_base(r["text"])
    assert qr.judge_documents(empty).count() == 0
