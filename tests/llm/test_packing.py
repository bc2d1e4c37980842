from __future__ import annotations

import functools
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from logloom.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids_of(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 1]


@functools.cache
def shared_words():
    return packing.WordIds(PATH)


@pytest.fixture(scope="module")
def words():
    return shared_words()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=4))
def test_ids_are_the_tokenizers(texts):
    for text, blob in zip(texts, shared_words().encode([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(blob, np.uint32).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="abTé'.,*|!<>_1\n ÿ-", max_size=60))
def test_words_with_signs(text):
    assert np.frombuffer(shared_words().encode([text.encode()])[0], np.uint32).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_odd_words(words):
    for text in ("The, THE. the's İ Σ ΣΑΣ e\u0301 É <|endoftext|> a\u00a0b \x1c x" + "y" * 200 + ",", "\u0301a \u0301", "ﬁ ① 12345 ... ,, a,b"):
        assert np.frombuffer(words.encode([text.encode()])[0], np.uint32).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def check(docs, pieces, window=2048):
    """Every id in exactly one piece, sequences without gaps, padding only in none at all."""
    whole = Counter()
    for r in docs.select("doc_id", "text").collect():
        whole[(r["doc_id"], tuple(ids_of(r["text"])))] += 1
    got = defaultdict(list)
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
        got[(p["doc_id"], p["doc_tokens"])].append(p)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at == window or (at < window and at & (at - 1) == 0)
    want = defaultdict(list)
    for (doc, ids), n in whole.items():
        want[(doc, len(ids))] += [ids] * n
    assert set(want) == set(got)
    for key, texts in want.items():
        crcs = Counter((p["start"], p["length"], p["ids_crc32"]) for p in got[key])
        assert sum(n * length for (_, length, _), n in crcs.items()) == sum(map(len, texts))
        for (start, length, crc), _ in crcs.items():
            assert any(zlib.crc32(np.array(t[start:start + length], "<u4").tobytes()) == crc for t in texts)
        if len(texts) == 1:
            at = 0
            for start, length, _ in sorted(crcs):
                assert start == at
                at += length


def test_documents(documents):
    check(documents, packing.pack_documents(documents, PATH).collect())


def test_many_segments_and_partitions(documents, monkeypatch):
    monkeypatch.setattr(packing, "SEGMENT_CELLS", 64)
    pieces = packing.pack_documents(documents.repartition(5), PATH).collect()
    check(documents, pieces)
    assert len({p["sequence_id"] >> packing.LOCAL_BITS >> 4 for p in pieces}) > 10


def test_ids_on_request(documents):
    for p in packing.pack_documents(documents.limit(20), PATH, with_ids=True).collect():
        assert len(p["ids"]) == p["length"] and zlib.crc32(np.array(p["ids"], "<u4").tobytes()) == p["ids_crc32"]


def test_full_windows_hold_the_mixture(documents):
    """In every full window a source's cells differ from its share by less than two cells."""
    pieces = packing.pack_documents(documents, PATH).collect()
    tokens = Counter()
    for p in pieces:
        tokens[p["source"]] += p["length"]
    total, windows = sum(tokens.values()), defaultdict(Counter)
    for p in pieces:
        windows[p["sequence_id"]][p["source"]] += p["length"]
    full = [w for i, w in windows.items() if sum(w.values()) == 2048 and i >> packing.LOCAL_BITS & 15 == 7]
    assert len(full) > 20
    for window in full:
        for source, n in tokens.items():
            assert abs(window[source] - 2048 * n / total) < 2 * packing.CELL


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=8), st.integers(1, 16))
def test_deficits_are_carried(queues, per_window):
    """Cumulative service of each queue stays near its share, each window is filled, queues are served in order."""
    window_of = packing.deal_windows(queues, np.zeros(len(queues)), per_window)
    total, first = sum(queues), np.cumsum([0, *queues])
    counts = np.bincount(window_of)
    assert (counts[:-1] == per_window).all() and counts.sum() == total
    for q, n in enumerate(queues):
        own = window_of[first[q]:first[q + 1]]
        assert (np.diff(own) >= 0).all()
        for w in range(len(counts)):
            share = n / total * counts[:w + 1].sum()
            assert abs((own <= w).sum() - share) < len(queues) + 1


@pytest.mark.parametrize("cells", [1 << 15, 256])
def test_windows_hold_target_proportions(spark, documents, monkeypatch, cells):
    """Until a named source runs out, every full window has its target share, in one segment and in many."""
    monkeypatch.setattr(packing, "SEGMENT_CELLS", cells)
    tokens = Counter()
    for r in documents.collect():
        tokens[r["source"]] += len(ids_of(r["text"]))
    (large, n), (small, m) = tokens.most_common(1)[0], tokens.most_common()[-1]
    targets = {large: 0.5, small: 0.05, "not there": 0.1}
    pieces = packing.pack_documents(documents, PATH, targets=targets).collect()
    check(documents, pieces)
    windows = defaultdict(Counter)
    for p in pieces:
        windows[p["sequence_id"]][p["source"]] += p["length"]
    full = sorted((i, w) for i, w in windows.items() if sum(w.values()) == 2048 and i >> packing.LOCAL_BITS & 15 == 7)
    # What isn't there has no share: the others' shares grow.
    rest = 1 - sum(targets.values())
    shares = {large: 0.5 / 0.9, small: 0.05 / 0.9}
    lasts = min(n / shares[large], m / shares[small], (sum(tokens.values()) - n - m) / (rest / 0.9)) / 2048
    before = full[:int(0.8 * lasts)]
    assert len(before) >= 5
    for source, share in shares.items():
        assert all(abs(w[source] - 2048 * share) < 2.5 * packing.CELL for _, w in before)
        assert abs(sum(w[source] for _, w in before) - 2048 * share * len(before)) < 4 * packing.CELL * (1 + len(before) * 16 // cells)


def test_sources_without_a_share_come_last(documents):
    first = documents.first()["source"]
    pieces = packing.pack_documents(documents, PATH, targets={first: 1.0}).collect()
    check(documents, pieces)
    windows = defaultdict(set)
    for p in pieces:
        if p["sequence_id"] >> packing.LOCAL_BITS & 15 == 7:
            windows[p["sequence_id"]].add(p["source"] == first)
    mixed = [i for i, kinds in windows.items() if len(kinds) > 1]
    assert len(mixed) <= 1 and max((i for i, kinds in windows.items() if kinds == {True}), default=-1) < min(i for i, kinds in windows.items() if kinds == {False})


def test_targets_of_odd_rows(odd, empty):
    for targets in ({"s": 0.5}, {"s": 1.0, "t": 0.0}, {"none such": 0.3}):
        check(odd, packing.pack_documents(odd, PATH, targets=targets).collect())
    assert packing.pack_documents(empty, PATH, targets={"s": 0.5}).count() == 0


def test_odd_rows(odd, empty):
    check(odd, packing.pack_documents(odd, PATH).collect())
    assert packing.pack_documents(empty, PATH).count() == 0
