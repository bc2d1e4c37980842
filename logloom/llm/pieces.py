"""SentencePiece encoding and decoding for merge-type vocabularies, by an agenda of adjacent symbol pairs."""

from __future__ import annotations

import heapq
import re
from array import array
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import TwoAges, arrow_pass, slices, strings, worker_store

SPACE = "▁"
#: Segments whose ids a worker remembers, per generation, and the longest that it remembers.
REMEMBERED = 220_000
LONGEST_REMEMBERED = 64
#: Up to so many symbols the agenda is a plain list, whose minimum is found faster than a heap is kept.
SHORT = 48
#: Every segment that is merged is held against the library in batches, and every row that is not plainly the sum of
#: its segments; of so many other rows, one is held against it whole as well. A difference fails the job.
CHECK_EVERY = 32
NEVER = 1 << 60
_SEGMENT = re.compile(f"{SPACE}+[^{SPACE}]*")


class MergeModel:
    """Pieces of a merge-type (BPE) sentencepiece model with byte fallback, white space kept, prefix space added."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        size = lib.get_piece_size()
        names = [lib.id_to_piece(i) for i in range(size)]
        self.byte_of = {i: int(names[i][3:5], 16) for i in range(size) if lib.is_byte(i)}
        self.byte_ids = {b: i for i, b in self.byte_of.items()}
        special = {i for i in range(size) if lib.is_control(i) or lib.is_unknown(i)} | set(self.byte_of)
        if any(lib.is_unused(i) for i in range(size)) or len(self.byte_ids) != 256:
            raise ValueError("the model has unused pieces or no byte fallback")
        sample = "  a é́ﬁ①  b "
        if lib.decode(lib.encode(sample)) != sample:
            raise ValueError("the model changes texts before it splits them")
        self.ids = {names[i]: i for i in range(size) if i not in special}
        ranks = {s: r for r, s in enumerate(sorted({lib.get_score(i) for i in self.ids.values()}, reverse=True))}
        self.rank = {piece: ranks[lib.get_score(i)] for piece, i in self.ids.items() if len(piece) > 1}
        if any(SPACE in piece.lstrip(SPACE) for piece in self.ids):
            raise ValueError("a piece has a space inside; texts can't be cut at spaces")
        self.line_end = not any("\n" in piece for piece in self.rank)
        self.end = lib.eos_id()
        self.unknown = lib.unk_id()
        # Text of each id. An ASCII byte reads the same whatever stands beside it; other bytes need their run.
        self.text = [names[i].replace(SPACE, " ") for i in range(size)]
        for i in special:
            self.text[i] = ""
        for i, b in self.byte_of.items():
            self.text[i] = chr(b) if b < 128 else ""
        if self.unknown >= 0:
            self.text[self.unknown] = " ⁇ "
        self.wide = np.zeros(size, bool)
        self.wide[[i for i, b in self.byte_of.items() if b >= 128]] = True
        self.spaced = np.array([n.startswith(SPACE) and i not in special for i, n in enumerate(names)])
        self.silent = np.array([bool(lib.is_control(i)) for i in range(size)])
        self.first, self.inner = TwoAges(REMEMBERED), TwoAges(REMEMBERED // 4)
        self.merged: list[tuple[str, bytes]] = []

    def symbols(self, text: str) -> list[str]:
        """The text's symbols after all merges: the best-scored adjacent pair first, the leftmost of equals."""
        return self._by_list(list(text)) if len(text) <= SHORT else self._by_heap(list(text))

    def _by_list(self, symbols: list[str]) -> list[str]:
        rank = self.rank.get
        agenda = [rank(pair, NEVER) for pair in map(add, symbols, symbols[1:])]
        while agenda:
            best = min(agenda)
            if best == NEVER:
                break
            i = agenda.index(best)
            symbols[i:i + 2] = [symbols[i] + symbols[i + 1]]
            del agenda[i]
            if i < len(agenda):
                agenda[i] = rank(symbols[i] + symbols[i + 1], NEVER)
            if i:
                agenda[i - 1] = rank(symbols[i - 1] + symbols[i], NEVER)
        return symbols

    def _by_heap(self, symbols: list[str]) -> list[str]:
        n, rank = len(symbols), self.rank.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [r * n + i for i, r in enumerate(map(rank, map(add, symbols, symbols[1:]))) if r is not None]
        heapq.heapify(agenda)
        while agenda:
            best, i = divmod(heapq.heappop(agenda), n)
            j = after[i]
            if not symbols[i] or j >= n or rank(symbols[i] + symbols[j]) != best:
                continue  # one of the two has merged with another since
            symbols[i] += symbols[j]
            symbols[j] = ""
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := rank(symbols[a] + symbols[b])) is not None:
                    heapq.heappush(agenda, r * n + a)
        return [s for s in symbols if s]

    def _ids(self, text: str) -> bytes:
        out: list[int] = []
        for symbol in self.symbols(text):
            known = self.ids.get(symbol)
            if known is not None:
                out.append(known)
            else:
                out.extend(self.byte_ids[b] for b in symbol.encode())
        return np.array(out, np.int32).tobytes()

    def _segment(self, key: str) -> bytes:
        """Ids of the start mark and ``key``. No merge crosses a line end, so its parts are remembered apart."""
        if not self.line_end or "\n" not in key:
            return self._ids(SPACE + key)
        head, *lines = key.split("\n")
        line_end = np.int32(self.ids.get("\n", self.byte_ids[10])).tobytes()
        out = [self._remembered(self.first, head, SPACE)]
        for line in lines:
            out += [line_end, self._remembered(self.inner, line, "")]
        return b"".join(out)

    def _remembered(self, cache: TwoAges, key: str, mark: str) -> bytes:
        found = cache.young.get(key)
        if found is None:
            found = cache.old.get(key)
            if found is None:
                found = self._ids(mark + key)
            if len(key) <= LONGEST_REMEMBERED:
                cache.young[key] = found
        return found

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a whole text, without an end id."""
        if not text:
            return b""
        keys = text.split(" ")
        plain = not ("" in keys or SPACE in text)
        if not plain:  # runs of spaces are symbols of their own, in front of a word
            keys = [s[1:] for s in _SEGMENT.findall(SPACE + text.replace(" ", SPACE))]
        young, old, out = self.first.young, self.first.old, []
        for key in keys:
            ids = young.get(key)
            if ids is None:
                ids = old.get(key)
                if ids is None:
                    ids = self._segment(key)
                    if plain:
                        self.merged.append((key, ids))
                if len(key) <= LONGEST_REMEMBERED and "\n" not in key:
                    young[key] = ids
            out.append(ids)
        self.first.turn()
        self.inner.turn()
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: byte runs read as UTF-8, each invalid byte as U+FFFD; the prefix space goes."""
        said = ids[~self.silent[ids]]
        if self.wide[said].any():
            parts = [bytes([self.byte_of[i]]) if i in self.byte_of else self.text[i].encode() for i in said.tolist()]
            text = re.sub("[\udc80-\udcff]", "�", b"".join(parts).decode("utf-8", "surrogateescape"))
        else:
            text = "".join(map(self.text.__getitem__, said.tolist()))
        return text[1:] if len(said) and self.spaced[said[0]] else text

    def check_merged(self) -> None:
        """Holds the segments merged since the last call against the library, which encodes them together."""
        merged, self.merged = self.merged, []
        theirs = self.library.encode([key for key, _ in merged], num_threads=1) if merged else []
        for (key, ids), own in zip(merged, theirs, strict=True):
            if array("i", own).tobytes() != ids:
                raise ValueError(f"ids differ from the library's for the segment {key[:60]!r}")

    def check(self, text: str, ids: np.ndarray, decoded: str) -> None:
        theirs = self.library.encode(text, add_eos=True)
        if theirs != ids.tolist() or self.library.decode(theirs) != decoded:
            raise ValueError(f"ids or decoded text differ from the library's for a text that starts {text[:60]!r}")


def load(path: str) -> MergeModel:
    store = worker_store("pieces")
    if path not in store:
        store[path] = MergeModel(path)
    return store[path]


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """``doc_id``, ``ids`` (with the end id) and ``decoded`` for every row of ``docs``, over the whole text.

    Null and empty texts have the end id alone and decode to an empty text. Repeated rows give a row each;
    further columns aren't read; an empty table gives an empty table. Texts are cut at spaces, which no
    piece crosses, and a worker remembers a bounded number of words, so each is merged about once. What is merged
    is encoded by the library too, in batches; rows with runs of spaces, or whose decoded text is not the text
    itself, are encoded and decoded by it whole. A difference is an error.
    """

    def run(batches):
        model, seen = load(model_path), 0
        end = np.int32(model.end).tobytes()
        for part in slices(batches):
            blobs, decoded = [], []
            for text in strings(part):
                text = text or ""
                blob = model.encode(text) + end
                ids = np.frombuffer(blob, np.int32)
                blobs.append(blob)
                decoded.append(model.decode(ids))
                if seen % CHECK_EVERY == 0 or decoded[-1] != text or SPACE in text or "  " in text or text[:1] == " " or text[-1:] == " ":
                    model.check(text, ids, decoded[-1])
                seen += 1
            model.check_merged()
            offsets = np.cumsum([0, *(len(b) // 4 for b in blobs)], dtype=np.int64).astype(np.int32)
            flat = pa.array(np.frombuffer(b"".join(blobs), np.int32))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.ListArray.from_arrays(pa.array(offsets), flat), pa.array(decoded, pa.string())],
                names=["doc_id", "ids", "decoded"])

    return arrow_pass(docs, ["doc_id", "text"], run, "doc_id bigint, ids array<int>, decoded string", "pieces")
