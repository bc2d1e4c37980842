from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from logloom.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
#: As the file gives it, without any switch.
LIBRARY = Tokenizer.from_file(PATH)
WORDS = packing.WordIds(PATH)
LITERALS = ("<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof", "text|>", "The end", " ", "\n", "é,", "'s")


def ids_of(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def test_literal_special_tokens():
    texts = ["the end<|endoftext|> of it", "<|startoftext|>", "The<|EndOfText|> end", "plain", ""]
    got = [np.frombuffer(b, np.uint32).tolist() for b in WORDS.encode([t.encode() for t in texts])]
    assert got == [ids_of(t) for t in texts] and 49407 in got[0] and 49407 not in got[2]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(LITERALS), max_size=8).map("".join), max_size=4))
def test_texts_around_literals(texts):
    assert [np.frombuffer(b, np.uint32).tolist() for b in WORDS.encode([t.encode() for t in texts])] == [ids_of(t) for t in texts]


def test_packed_documents(spark):
    docs = spark.createDataFrame([(1, "the end<|endoftext|> of it", "s")], "doc_id bigint, text string, source string")
    want = np.array([*ids_of("the end<|endoftext|> of it"), 1], "<u4")
    pieces = sorted(packing.pack_documents(docs, PATH).collect(), key=lambda p: p["start"])
    assert {p["doc_tokens"] for p in pieces} == {len(want)}
    assert [p["ids_crc32"] for p in pieces] == [zlib.crc32(want[p["start"]:p["start"] + p["length"]].tobytes()) for p in pieces]
