from __future__ import annotations

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from logloom.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    return pieces.MergeModel(PATH)


def check(model, text):
    import numpy as np

    ids = LIBRARY.encode(text, add_eos=True)
    mine = np.frombuffer(model.encode(text) + np.int32(model.end).tobytes(), np.int32)
    assert mine.tolist() == ids
    assert model.decode(mine) == LIBRARY.decode(ids)


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    check(pieces.load(PATH), text)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="thean ing▁\n\té①.", max_size=200))
def test_near_texts(text):
    check(pieces.load(PATH), text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 700), max_size=20))
def test_any_ids_decode(ids):
    import numpy as np

    assert pieces.load(PATH).decode(np.array(ids, np.int64)) == LIBRARY.decode(ids)


def test_heap_and_list_agree(model, texts):
    for text in list(texts.values())[:60]:
        symbols = list("▁" + (text or "").replace(" ", "▁")[:300])
        assert model._by_list(list(symbols)) == model._by_heap(list(symbols))


def test_documents(documents, texts):
    for r in pieces.encode_documents(documents, PATH).collect():
        ids = LIBRARY.encode(texts[r["doc_id"]] or "", add_eos=True)
        assert r["ids"] == ids and r["decoded"] == LIBRARY.decode(ids)


def test_odd_rows(odd, empty):
    rows = pieces.encode_documents(odd, PATH).collect()
    given_ = {r["doc_id"]: r["text"] for r in odd.collect()}
    assert len(rows) == odd.count()
    for r in rows:
        assert r["ids"] == LIBRARY.encode(given_[r["doc_id"]] or "", add_eos=True)
    assert pieces.encode_documents(empty, PATH).count() == 0


def test_small_caches(model, texts, monkeypatch):
    small = pieces.MergeModel(PATH)
    small.first.limit = small.inner.limit = 5
    for text in list(texts.values())[:40]:
        assert small.encode(text or "") == model.encode(text or "")
