from __future__ import annotations

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from logloom.llm import wordpiece as wp


def plain_count(pieces, word):
    total = at = 0
    while at < len(word):
        for end in range(len(word), at, -1):
            if word[at:end] in pieces:
                total, at = total + pieces[word[at:end]], end
                break
        else:
            total, at = total + len(word[at].encode()), at + 1
    return total


@settings(max_examples=500, deadline=None)
@given(st.sets(st.text(alphabet="abcé", min_size=1, max_size=5), max_size=12), st.lists(st.text(alphabet="abcéx", max_size=14), max_size=8))
def test_counts_are_greedy(vocabulary, words):
    pieces = dict.fromkeys(vocabulary, 1)
    automaton = wp.Automaton(pieces)
    assert [automaton.count(w) for w in words] == [plain_count(pieces, w) for w in words]


def test_documents(documents, texts):
    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces = wp.sentencepiece_vocabulary(path)
    longest = max(map(len, pieces))

    def count(word):
        total = at = 0
        while at < len(word):
            size = next((n for n in range(min(longest, len(word) - at), 0, -1) if word[at:at + n] in pieces), 0)
            total, at = total + (1 if size else len(word[at].encode())), at + max(size, 1)
        return total

    for r in wp.token_counts(documents, path).collect():
        words = (texts[r["doc_id"]] or "").split()
        assert (r["n_words"], r["n_tokens"]) == (len(words), sum(count("▁" + w) for w in words))


def test_odd_rows(odd, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = wp.token_counts(odd, path).collect()
    assert len(rows) == odd.count()
    assert [r["n_tokens"] for r in rows if r["doc_id"] in (0, 1, 2)] == [0, 0, 0]
    assert wp.token_counts(empty, path).count() == 0
