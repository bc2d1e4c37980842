"""Packing of documents into fixed windows by deficit round-robin over source queues."""

from __future__ import annotations

import os
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import stage
from .common import TwoAges, arrow_pass, raw_bytes, slices, worker_store

WINDOW = 2048
#: Tokens of a full cell, the unit that queues hand out. Smaller cells are the powers of two below.
CELL = 128
#: Cells that one task deals out to windows.
SEGMENT_CELLS = 1 << 15
#: Weight of sources that no target share is left for, so that they come last.
LEAST_WEIGHT = 1e-9
#: Low bits of a sequence id count the sequences of a segment.
LOCAL_BITS = 24
#: Words whose ids a worker remembers, per generation, and the longest that it remembers.
REMEMBERED = 200_000
LONGEST_REMEMBERED = 64
#: Signs that may end a word without changing how its letters are split: ASCII punctuation but the apostrophe.
SIGNS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'").encode()


def _byte_signs() -> list[str]:
    """The printable character by which a byte-level vocabulary writes each byte."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


BYTE_SIGNS = _byte_signs()


class WordIds:
    """Ids of whole texts from a tokenizer whose splits never cross white space, word by word.

    Each word is given to the tokenizer about once per worker: words of plain small letters, which its
    normalizer leaves alone, straight to its model, and so the signs that follow them, which its splitter cuts
    off; other letters-only words together in one call, told apart by the end-of-word mark of their last id;
    all others on their own. ASCII capitals are lowered before the lookup, as the tokenizer lowers them anyway.
    A text that may hold a literal special token, such as ``<|endoftext|>``, goes whole and unchanged to the
    tokenizer with its own settings, which makes that token of it.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.literals = [t.content.encode().lower() for t in self.whole.get_added_tokens_decoder().values()]
        # For words of texts without a literal: one that only lowering has made is no token.
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        probe = "One two,three\nFOUR's  5.6 éÀ ß"
        if sum((self._ids(w) for w in probe.split()), []) != self._ids(probe) or self._ids(probe) != self._ids(probe.lower()):
            raise ValueError("the tokenizer's splits cross white space, or it tells capitals apart")
        self.model = self.tokenizer.model
        letters = [c for c in map(chr, (*range(97, 123), *range(0xDF, 0x100))) if self._direct(f"a{c}e") == self._ids(f"a{c}e")]
        self.plain = frozenset(letters)
        self.cache, self.signs = TwoAges(REMEMBERED), {}

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _direct(self, word: str) -> list[int]:
        """Ids of one word from the model alone, past normalizer and splitter."""
        return [t.id for t in self.model.tokenize(word if word.isascii() else "".join(map(BYTE_SIGNS.__getitem__, word.encode())))]

    def _packed(self, word: bytes) -> bytes:
        return array("I", self._direct(word.decode())).tobytes()

    def _simple(self, word: bytes, found: dict[bytes, bytes]) -> bytes | None:
        """Ids of plain letters, signs, or plain letters with signs behind them; None for any other word."""
        letters = word.rstrip(SIGNS)
        if len(letters) == len(word):
            return self._packed(word) if self.plain.issuperset(word.decode()) else None
        ends = word[len(letters):]
        tail = self.signs.get(ends)
        if tail is None:
            tail = self._packed(ends)
            if len(self.signs) < REMEMBERED and len(ends) <= LONGEST_REMEMBERED:
                self.signs[ends] = tail
        if not letters:
            return tail
        head = self.cache.young.get(letters) or self.cache.old.get(letters) or found.get(letters)
        if head is None:
            if not self.plain.issuperset(letters.decode()):
                return None
            head = found[letters] = self._packed(letters)
        elif not self.plain.issuperset(letters.decode()):
            return None
        return head + tail

    def _learn(self, missing: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words that the cache doesn't have."""
        found: dict[bytes, bytes] = {}
        other = []
        for word in missing:
            ids = self._simple(word, found)
            if ids is None:
                other.append(word)
            else:
                found[word] = ids
        plain = [w for w in other if w.decode().isalpha()]
        if plain:
            ids = np.array(self._ids(b" ".join(plain).decode()), np.uint32)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(plain) and cuts[-1] == len(ids):
                found.update(zip(plain, (p.tobytes() for p in np.split(ids, cuts[:-1])), strict=True))
        rest = [w for w in other if w not in found]
        for word, coded in zip(rest, self.tokenizer.encode_batch_fast([w.decode() for w in rest], add_special_tokens=False), strict=True):
            found[word] = array("I", coded.ids).tobytes()
        return found

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        lowered = [t.lower() for t in texts]
        whole = {i: array("I", self.whole.encode(texts[i].decode(), add_special_tokens=False).ids).tobytes()
                 for i, t in enumerate(lowered) if any(x in t for x in self.literals)}
        split = [[] if i in whole else t.split() for i, t in enumerate(lowered)]
        young, old = self.cache.young, self.cache.old
        missing = []
        for word in {w for words in split for w in words}:
            if word not in young:
                known = old.get(word)
                if known is None:
                    missing.append(word)
                elif len(word) <= LONGEST_REMEMBERED:
                    young[word] = known
        fresh = self._learn(missing) if missing else {}
        long = {w: fresh.pop(w) for w in list(fresh) if len(w) > LONGEST_REMEMBERED}
        young.update(fresh)
        get = young.__getitem__
        out = []
        for words in split:
            try:
                out.append(b"".join(map(get, words)))
            except KeyError:
                out.append(b"".join(young.get(w) or long.get(w) or b"" for w in words))
        for i, ids in whole.items():
            out[i] = ids
        self.cache.turn()
        return out


class Cutter:
    """Cuts the token streams of a partition's sources into cells.

    Documents follow one another in their source's stream. Full cells have ``cell`` tokens; what remains of a
    stream at the end is cut into cells of falling powers of two. A cell holds one or more pieces.
    """

    def __init__(self, cell: int):
        self.cell = cell
        self.level = cell.bit_length() - 1
        self.open: dict[str | None, list[tuple]] = {}
        self.filled: dict[str | None, int] = {}
        self.cells: dict[str | None, int] = {}

    def add(self, source: str | None, doc: tuple, tokens: int):
        """Pieces of cells that this document fills: (source, level, cell, offset, document, start, length)."""
        at, filled = 0, self.filled.get(source, 0)
        waiting, number = self.open.setdefault(source, []), self.cells.get(source, 0)
        while tokens - at + filled >= self.cell:
            take = self.cell - filled
            for piece in (*waiting, (filled, doc, at, take)):
                yield source, self.level, number, *piece
            waiting.clear()
            number, at, filled = number + 1, at + take, 0
        if at < tokens:
            waiting.append((filled, doc, at, tokens - at))
        self.filled[source], self.cells[source] = filled + tokens - at, number

    def rest(self):
        """Pieces of what remains of every source."""
        for source, waiting in self.open.items():
            left = [list(p) for p in waiting]
            total = self.filled[source]
            for level in range(self.level - 1, -1, -1):
                if not total >> level & 1:
                    continue
                room, offset = 1 << level, 0
                while room:
                    _, doc, start, length = left[0]
                    take = min(length, room)
                    yield source, level, 0, offset, doc, start, take
                    room, offset = room - take, offset + take
                    if take == length:
                        left.pop(0)
                    else:
                        left[0] = [0, doc, start + take, length - take]


def cut_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, cell: int = CELL, with_ids: bool = False) -> DataFrame:
    """Every document's ids (with the end id) in pieces, each with its place in a cell of its partition's source.

    Columns: doc_id, source, start, length, ids_crc32, doc_tokens, part, level, cell, offset and, if asked
    for, ids. The CRC is taken here, where the ids are, so that ids need not travel with the pieces.
    """
    tail = np.uint32(end_id).tobytes()
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32()]
    names = ["doc_id", "source", "start", "length", "ids_crc32", "doc_tokens", "part", "level", "cell", "offset"]
    schema = ("doc_id bigint, source string, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, part int, level int, "
              "cell bigint, offset int")
    if with_ids:
        kinds, names, schema = [*kinds, pa.list_(pa.int32())], [*names, "ids"], schema + ", ids array<int>"

    def run(batches):
        store = worker_store("packing")
        if tokenizer_path not in store:
            store[tokenizer_path] = WordIds(tokenizer_path)
        words, cutter, part_id = store[tokenizer_path], Cutter(cell), TaskContext.get().partitionId()

        def rows(pieces):
            for source, level, number, offset, (doc_id, blob), start, length in pieces:
                own = blob[4 * start:4 * (start + length)]
                row = (doc_id, source, start, length, zlib.crc32(own), len(blob) // 4, part_id, level, number, offset)
                yield (*row, np.frombuffer(own, np.int32).tolist()) if with_ids else row

        def batch(found):
            columns = list(zip(*found, strict=True)) or [[]] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for part in slices(batches):
            found = []
            blobs = words.encode([t or b"" for t in raw_bytes(part)])
            for doc_id, source, blob in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), blobs, strict=True):
                blob += tail
                found.extend(rows(cutter.add(source, (doc_id, blob), len(blob) // 4)))
            yield batch(found)
        yield batch(list(rows(cutter.rest())))

    ready = docs.select("doc_id", F.col("source").cast("string").alias("source"), "text")
    return arrow_pass(ready, ["doc_id", "source", "text"], run, schema, "packing")


def deal_windows(queues: list[int], carried: np.ndarray, per_window: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Window of each cell, cells listed queue by queue, by deficit round-robin.

    In every window each queue earns its share of the window's cells, on top of what earlier windows (and the
    segment before, ``carried``) left; queues with the largest deficit are served first, whole cells only,
    and what a queue got too much is charged to its next windows. Shares are those of all cells or, with
    ``weights``, of the weights of the queues that have cells left.
    """
    left, total = np.array(queues, np.int64), int(sum(queues))
    share = left / max(total, 1)
    deficit, served = carried.astype(float).copy(), np.zeros(len(left), np.int64)
    first = np.concatenate([[0], np.cumsum(left)[:-1]])
    window_of = np.zeros(total, np.int64)
    for window in range(-(-total // per_window)):
        room = min(per_window, total - window * per_window)
        if weights is not None:
            share = np.where(left > 0, weights, 0.0)
            share /= share.sum()
        deficit += share * room
        take = np.minimum(np.maximum(np.floor(deficit), 0), left).astype(np.int64)
        order = np.argsort(-(deficit - np.where(left > 0, 0, np.inf)), kind="stable")
        before = np.cumsum(take[order]) - take[order]
        take[order] = np.clip(room - before, 0, take[order])
        while (short := room - int(take.sum())) > 0:
            open_ = np.flatnonzero(left > take)
            take[open_[np.argsort(-(deficit - take)[open_], kind="stable")[:short]]] += 1
        for q in np.flatnonzero(take):
            window_of[first[q] + served[q]:first[q] + served[q] + take[q]] = window
        served, left, deficit = served + take, left - take, deficit - take
    return window_of


class _Course:
    """How far each source is served when so many cells of a level have been dealt, if sources have target shares.

    At time t a source of weight w has had min(w t, its cells). ``steps`` are (w, time at which it runs out); sources
    that are not named count as one, whose share goes by their tokens.
    """

    def __init__(self, cells: dict[str | None, int], targets: dict[str, float]):
        rest = max(1.0 - sum(targets.values()), LEAST_WEIGHT)
        self.weight = {name: max(targets.get(name, rest), LEAST_WEIGHT) for name, n in cells.items() if n}
        self.cells = {name: n for name, n in cells.items() if n}
        self.steps = [(self.weight[name], n / self.weight[name]) for name, n in self.cells.items()]
        self.times = np.array([0.0, *sorted(end for _, end in self.steps)])
        self.dealt = sum(w * np.minimum(self.times, end) for w, end in self.steps)

    def time(self, dealt: float) -> float:
        return float(np.interp(dealt, self.dealt, self.times))


def _courses(counts: DataFrame, targets: dict[str, float]) -> dict[int, _Course]:
    """Per level, from the cells of each named source and of all others; a row per level and name."""
    name = F.when(F.col("source").isin(*targets), F.col("source")).alias("name")
    cells: dict[int, dict] = {}
    for r in counts.groupBy("level", name).agg(F.sum("cells").alias("n")).collect():
        cells.setdefault(r["level"], {})[r["name"]] = r["n"]
    return {level: _Course(own, targets) for level, own in cells.items()}


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, window: int = WINDOW, cell: int = CELL,
                   with_ids: bool = False, targets: dict[str, float] | None = None) -> DataFrame:
    """Pieces of all documents with ``sequence_id`` and ``offset``: every id in exactly one piece.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source (and ids). Each window of
    ``window`` tokens takes from the sources in the proportions of ``targets`` (source to share, 1 in all at most;
    the other sources have the rest, by their tokens), to within a cell. As every id is packed, a source that has
    run out gives its share to the others, and sources without a share come when all with one have run out. Without
    ``targets`` the proportions are those of the token totals, which hold in every window. A shortfall is carried to the
    next windows, and by arithmetic also to the next segment of windows, which is another task. The last cells of a
    segment make sequences of powers of two, so nothing is padded.
    Null and empty texts have the end id alone. A null source is a source of its own. Repeated rows are packed
    each. Further columns aren't read; an empty table gives an empty table.

    Pieces are cut where documents are tokenised and written once. Only their short descriptions are
    shuffled, by segment; a segment has a bounded number of cells, however the sources are spread.
    """
    pieces = stage(cut_documents(docs, tokenizer_path, end_id, cell, with_ids), "pieces")
    queue = ["source", "level"]
    counts = pieces.groupBy(*queue, "part").agg((F.max("cell") + 1).alias("cells"))
    counts = stage(counts.withColumn("key", F.coalesce(F.xxhash64("source", F.col("source").isNull()), F.lit(0))), "piece-counts")
    # Cells of a queue before each partition: a sum over one row per partition, not per cell.
    running = Window.partitionBy(*queue).orderBy("part")
    places = counts.withColumn("before", F.sum("cells").over(running) - F.col("cells")).withColumn(
        "queue_cells", F.sum("cells").over(Window.partitionBy(*queue)))
    levels = {r["level"]: r["n"] for r in counts.groupBy("level").agg(F.sum("cells").alias("n")).collect()}
    segments = F.create_map(*[F.lit(x) for level, n in sorted(levels.items()) for x in (level, -(-n // SEGMENT_CELLS))]) if levels else None
    if segments is None:
        places = places.withColumn("segments", F.lit(1))
    else:
        places = places.withColumn("segments", segments[F.col("level")])
    # A phase per queue spreads queues of few cells over all segments.
    places = places.withColumn("phase", F.pmod("key", F.lit(1 << 20)) / F.lit(float(1 << 20))).select(
        F.col("source").alias("s"), F.col("level").alias("l"), F.col("part").alias("p"), "before", "queue_cells", "segments", "phase")
    joined = pieces.join(places, pieces["source"].eqNullSafe(F.col("s")) & (pieces["level"] == F.col("l")) & (pieces["part"] == F.col("p")))
    place = (F.col("before") + F.col("cell") + F.col("phase")) / F.col("queue_cells") * F.col("segments")
    weight, courses = F.lit(0.0), _courses(counts, targets) if targets and levels else None
    if courses:
        weights = F.create_map(*[F.lit(x) for level, c in courses.items() for name, w in c.weight.items()
                                 for x in ((f"{level}:{name}", w) if name is not None else (f"{level}", w / c.cells[None]))])
        named = F.concat("level", F.lit(":"), F.col("source"))
        weight = F.coalesce(F.try_element_at(weights, named), F.try_element_at(weights, F.col("level").cast("string")) * F.col("queue_cells"))
        steps = F.create_map(*[x for level, c in courses.items() for x in (
            F.lit(level), F.array(*[F.struct(F.lit(float(w)).alias("w"), F.lit(float(end)).alias("end")) for w, end in c.steps]))])
        time = (F.col("before") + F.col("cell") + F.col("phase")) / weight
        dealt = F.aggregate(F.element_at(steps, F.col("level")), F.lit(0.0), lambda sum_, e: sum_ + e["w"] * F.least(time, e["end"]))
        totals = F.create_map(*[F.lit(x) for level, c in courses.items() for x in (level, float(c.dealt[-1]))])
        place = dealt / F.element_at(totals, F.col("level")) * F.col("segments")
    ready = joined.select(
        "doc_id", "source", "start", "length", "ids_crc32", "doc_tokens", "level", "offset", (F.col("before") + F.col("cell")).alias("nth"),
        "queue_cells", "segments", "phase", weight.alias("weight"), F.least(F.floor(place), F.col("segments") - 1).cast("int").alias("segment"),
        *(["ids"] if with_ids else []))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "source", *(["ids"] if with_ids else [])]
    schema = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, source string, "
              + ("ids array<int>, " if with_ids else "") + "sequence_id bigint, offset bigint")

    def deal(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, sort_keys=[("source", "ascending"), ("nth", "ascending"), ("offset", "ascending")]))
        number = lambda c: table.column(c).to_numpy()
        queue_no = pc.fill_null(table.column("source").combine_chunks().dictionary_encode().indices, -1).to_numpy()
        nth, level, segment, segments = number("nth"), *(int(number(c)[0]) for c in ("level", "segment", "segments"))
        new_queue = np.r_[True, queue_no[1:] != queue_no[:-1]]
        new_cell = new_queue | np.r_[True, nth[1:] != nth[:-1]]
        cell_no = np.cumsum(new_cell) - 1
        queues = np.diff(np.r_[np.flatnonzero(new_queue[new_cell]), cell_no[-1] + 1])
        # What each queue was owed when the segment began: its exact share of earlier segments less what they took.
        all_cells, weights = number("queue_cells")[new_queue], None
        owed = all_cells * (segment / segments)
        if courses:
            weights, course = number("weight")[new_queue], courses[level]
            owed = np.minimum(weights * course.time(course.dealt[-1] * segment / segments), all_cells)
        carried = owed - number("phase")[new_queue] - nth[new_queue]
        per_window = window >> level
        window_of = deal_windows(queues.tolist(), np.clip(carried - carried.mean(), -1, 1), per_window, weights)
        rank = np.empty(len(window_of), np.int64)
        rank[np.argsort(window_of, kind="stable")] = np.arange(len(window_of))
        sequence, inside = _sequences(rank, per_window)
        base = ((segment << 4) | level) << LOCAL_BITS
        return pa.table([*(table.column(c) for c in columns), pa.array(base + sequence[cell_no]),
                         pa.array((inside[cell_no] << level) + number("offset"), pa.int64())], names=[*columns, "sequence_id", "offset"])

    return ready.groupBy("level", "segment").applyInArrow(deal, schema)


def _sequences(rank: np.ndarray, per_window: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and place in it of each cell; the last cells make one sequence per power of two in their number."""
    sequence, inside = rank // per_window, rank % per_window
    full, rest = divmod(len(rank), per_window)
    begin, number = full * per_window, full
    for bit in range(rest.bit_length() - 1, -1, -1):
        if rest >> bit & 1:
            own = (rank >= begin) & (rank < begin + (1 << bit))
            sequence[own], inside[own] = number, rank[own] - begin
            begin, number = begin + (1 << bit), number + 1
    return sequence, inside
