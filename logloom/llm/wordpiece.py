"""Greedy longest-match token counts in linear time, by a trie with failure links and popped-token counts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import TwoAges, arrow_pass, slices, strings, worker_store

#: Marks the start of a word in the vocabulary.
START = "▁"
#: Words whose counts a worker remembers, per generation.
REMEMBERED = 200_000
#: Longer words are counted each time, so the memory of a generation is bounded.
LONGEST_REMEMBERED = 64


class Automaton:
    """Counts the pieces of the greedy longest-match split of a word, one step per character.

    ``pieces`` maps each vocabulary string to the tokens it counts for. A character without a piece of its
    own counts for its UTF-8 bytes (byte fallback); it becomes a trie path of that weight if longer pieces
    pass it, and is counted directly if the trie doesn't know it.

    A node stands for characters read but not yet split. ``fail`` leads to the node of what remains after the
    greedy tokens that a mismatch forces, ``popped`` counts those tokens, ``rest`` all tokens of the node.
    """

    def __init__(self, pieces: dict[str, int]):
        weights = dict(pieces)
        for char in {c for piece in pieces for c in piece}:
            weights.setdefault(char, len(char.encode("utf-8", "surrogatepass")))
        self.next: list[dict[str, int]] = [{}]
        own = [0]
        for piece, weight in weights.items():
            node = 0
            for char in piece:
                step = self.next[node].get(char)
                if step is None:
                    step = self.next[node][char] = len(self.next)
                    self.next.append({})
                    own.append(0)
                node = step
            own[node] = weight
        self.fail, self.popped, self.rest = [-1] * len(self.next), [0] * len(self.next), [0] * len(self.next)
        level = [0]
        while level:
            deeper = []
            for parent in level:
                for char, node in self.next[parent].items():
                    self._link(parent, char, node, own[node])
                    deeper.append(node)
            level = deeper

    def _link(self, parent: int, char: str, node: int, weight: int) -> None:
        if weight:
            self.fail[node], self.popped[node], self.rest[node] = 0, weight, weight
            return
        at, popped = self.fail[parent], self.popped[parent]
        while char not in self.next[at]:  # ends at the root at the latest: every character of the trie is a piece
            popped += self.popped[at]
            at = self.fail[at]
        self.fail[node], self.popped[node] = self.next[at][char], popped
        self.rest[node] = popped + self.rest[self.fail[node]]

    def count(self, word: str) -> int:
        step, fail, popped = self.next, self.fail, self.popped
        node = total = 0
        for char in word:
            while char not in step[node]:
                if node == 0:
                    total += len(char.encode("utf-8", "surrogatepass"))
                    break
                total += popped[node]
                node = fail[node]
            else:
                node = step[node][char]
        return total + self.rest[node]


def sentencepiece_vocabulary(path: str) -> dict[str, int]:
    """Ordinary pieces of a sentencepiece model, each one token."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return {model.id_to_piece(i): 1 for i in range(model.get_piece_size())
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}


def token_counts(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_tokens`` for every row of ``docs``, over the whole text.

    Words are what white space separates (``str.split``). Each gets the start mark in front and is split
    greedily, the longest piece first; a character without a piece counts for its UTF-8 bytes. Null, empty
    and blank texts count zero. Repeated rows give a row each; further columns aren't read. An empty table gives
    an empty table.
    """

    def run(batches):
        store = worker_store("wordpiece")
        if vocabulary_path not in store:
            store[vocabulary_path] = Automaton(sentencepiece_vocabulary(vocabulary_path)), TwoAges(REMEMBERED)
        automaton, cache = store[vocabulary_path]

        def total(words):
            young, old, n = cache.young, cache.old, 0
            for word in words:
                k = young.get(word)
                if k is None:
                    k = old.get(word) or automaton.count(START + word)
                    if len(word) <= LONGEST_REMEMBERED:
                        young[word] = k
                n += k
            cache.turn()
            return n

        for part in slices(batches):
            words, tokens = [], []
            for text in strings(part):
                split = (text or "").split()
                words.append(len(split))
                tokens.append(total(split))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(np.array(words, np.int64)), pa.array(np.array(tokens, np.int64))],
                names=["doc_id", "n_words", "n_tokens"])

    return arrow_pass(docs, ["doc_id", "text"], run, "doc_id bigint, n_words bigint, n_tokens bigint", "wordpiece")
