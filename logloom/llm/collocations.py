"""Phrase collocations: words that stand together more often than apart, counted in HAT-tries.

A task reads texts into a shallow trie over word numbers whose leaves are hash containers of phrases. A container that
grows too large bursts into containers by the next word. When the trie is full, its largest subtrees leave whole,
as sorted runs: phrases with their counts, dealt to partitions. Each partition merges the runs it receives; what is
frequent there goes on to scoring, which is plain joins.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import chain, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import stage
from .common import arrow_pass, raw_bytes, slices, strings

#: Entries of a task's trie at which subtrees are spilled, and words it may know before it starts anew.
TRIE_ENTRIES = 800_000
KNOWN_WORDS = 500_000
#: Share of the entries that leave a full trie.
SPILLED = 0.75
#: Entries of a container at which it bursts.
BURST = 16_384
#: Words that are numbered and counted at a time.
WORDS_AT_ONCE = 400_000
#: UTF-8 bytes of text for which there is one partition of the merge: some million entries at most.
PARTITION_BYTES = 1 << 21
#: Runs that leave a task in one Arrow batch.
ROWS_AT_ONCE = 64
#: Parts of a language that are ranked apart before the best of each meet.
SHARES = 64
#: Counts stay below this, so a million times a square fits the 38 digits of a decimal.
LARGEST_COUNT = 10 ** 15

_LANGUAGE = "und"
_END = 0
#: Bits of a word's number; three of them make a key.
_BITS = 21
_LOW = (1 << _BITS) - 1
#: Subtrees below the root, and containers that a burst one becomes.
_SUBTREES, _PARTS = 1024, 64
#: ASCII letters in lower case, tabs as blanks, and every sign that ends a piece as a line feed.
_TABLE = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))


def pieces_of(text: bytes | None) -> list[list[bytes]]:
    """The words of each piece of a UTF-8 text; pieces without words are left out."""
    return [words for piece in (text or b"").translate(_TABLE).split(b"\n") if (words := piece.split())]


class PhraseTrie:
    """Counts of the words (first, second, third) from each position of a piece on.

    Words are numbered per language. The root deals a phrase by the number of its first word to one of its subtrees,
    which is a hash container for a group of words until it bursts into containers by the second word. ``leaf``
    has the containers by subtree and part. Shorter phrases are sums over subtrees.
    """

    def __init__(self, longest: int, burst: int):
        self.longest, self.burst = longest, burst
        self.is_burst = np.zeros(_SUBTREES, bool)
        self.leaf: dict[int, Counter] = {}
        self.forget()

    def forget(self) -> None:
        """Drops all numbers; only for an empty trie."""
        self.next_number = count(1).__next__
        self.numbers: dict[str, defaultdict] = {}

    def words(self) -> int:
        return sum(map(len, self.numbers.values()))

    def add(self, language: str, tokens: list[bytes], start: int, stop: int) -> None:
        """Counts the phrases that begin at positions ``start`` to ``stop`` of a text's words and piece ends."""
        numbers = self.numbers.get(language)
        if numbers is None:
            numbers = self.numbers[language] = defaultdict(self.next_number, {b"\n": _END})
        own = tokens[start:stop + 2]
        ids = np.r_[np.fromiter(map(numbers.__getitem__, own), np.int64, len(own)), _END, _END]
        first, second, third = ids[:stop - start], ids[1:stop - start + 1], ids[2:stop - start + 2]
        third = np.where(second == _END, _END, third) if self.longest > 2 else np.zeros_like(third)
        real = first != _END
        first, second, third = first[real], second[real], third[real]
        if not len(first):
            return
        keys = (first << 2 * _BITS) | (second << _BITS) | third
        group = first % _SUBTREES
        homes = group * _PARTS + np.where(self.is_burst[group], second % _PARTS, 0)
        order = np.argsort(homes, kind="stable")
        homes, keys = homes[order], keys[order].tolist()
        starts = np.flatnonzero(np.r_[True, homes[1:] != homes[:-1]]).tolist()
        for home, a, b in zip(homes[starts].tolist(), starts, [*starts[1:], len(keys)], strict=True):
            box = self.leaf.get(home)
            if box is None:
                box = self.leaf[home] = Counter()
            box.update(keys[a:b])

    def burst_large(self) -> None:
        for number in np.flatnonzero(~self.is_burst).tolist():
            whole = self.leaf.get(number * _PARTS, ())
            if len(whole) > self.burst:
                self.is_burst[number] = True
                del self.leaf[number * _PARTS]
                for key, n in whole.items():
                    self.leaf.setdefault(number * _PARTS + (key >> _BITS & _LOW) % _PARTS, Counter())[key] = n

    def entries(self) -> int:
        return sum(map(len, self.leaf.values()))

    def take(self, share: float) -> tuple[np.ndarray, np.ndarray]:
        """Removes the largest subtrees until ``share`` of all entries is gone; their keys and counts, unsorted."""
        sizes = np.zeros(_SUBTREES, np.int64)
        for home, box in self.leaf.items():
            sizes[home // _PARTS] += len(box)
        largest = np.argsort(-sizes, kind="stable")
        leaving = np.zeros(_SUBTREES, bool)
        leaving[largest[np.cumsum(sizes[largest]) - sizes[largest] < share * sizes.sum()]] = True
        taken = [self.leaf.pop(home) for home in [h for h in self.leaf if leaving[h // _PARTS]]]
        self.is_burst &= ~leaving
        total = sum(map(len, taken))
        keys = np.fromiter(chain.from_iterable(taken), np.int64, total)
        return keys, np.fromiter(chain.from_iterable(box.values() for box in taken), np.int64, total)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _runs(language: str, keys: np.ndarray, n: np.ndarray, numbers: dict[bytes, int], partitions: int, longest: int) -> Iterator[pa.RecordBatch]:
    """One sorted run per partition: the phrases of all lengths among the entries of a language, and their counts."""
    vocabulary = pa.array(list(numbers), pa.large_binary())
    by_rank = pc.sort_indices(vocabulary).to_numpy()
    by_rank = np.r_[0, by_rank[by_rank != 0]]  # the end of a piece, the first word known, goes before all others
    own = np.fromiter(numbers.values(), np.int64, len(numbers))[by_rank]
    rank = np.zeros(own.max() + 1, np.int64)
    rank[own] = np.arange(len(own))
    vocabulary = vocabulary.take(pa.array(by_rank))
    digests = np.fromiter(map(xxhash.xxh64_intdigest, vocabulary.to_pylist()), np.uint64, len(by_rank))
    last = pc.binary_join_element_wise(vocabulary, pa.scalar(b"", pa.large_binary()), pa.scalar(b"\n", pa.large_binary()))
    keys = (rank[keys >> 2 * _BITS] << 2 * _BITS) | (rank[keys >> _BITS & _LOW] << _BITS) | rank[keys & _LOW]
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    seed, blank = np.uint64(xxhash.xxh64_intdigest(language.encode())), pa.scalar(b" ", pa.large_binary())
    texts, counts, homes = [], [], []
    for length in range(1, longest + 1):
        cut = keys >> (3 - length) * _BITS
        real = (cut & _LOW) != _END
        cut, m = cut[real], n[real]
        if not len(cut):
            continue
        starts = np.flatnonzero(np.r_[True, cut[1:] != cut[:-1]])
        cut = cut[starts]
        counts.append(np.add.reduceat(m, starts))
        words = [cut >> (length - 1 - i) * _BITS & _LOW for i in range(length)]
        homes.append(reduce(lambda h, w: _mixed(h + digests[w]), words, np.full(len(cut), seed, np.uint64)) % np.uint64(partitions))
        parts = [vocabulary.take(pa.array(w)) for w in words[:-1]] + [last.take(pa.array(words[-1]))]
        texts.append(parts[0] if length == 1 else pc.binary_join_element_wise(*parts, blank))
    homes, counts, texts = np.concatenate(homes), np.concatenate(counts), pa.concat_arrays(texts)
    order = np.argsort(homes, kind="stable")
    homes, counts, texts = homes[order], counts[order], texts.take(pa.array(order))
    starts = np.r_[np.flatnonzero(np.r_[True, homes[1:] != homes[:-1]]), len(homes)]
    ends, data, pack = np.frombuffer(texts.buffers()[1], np.int64), texts.buffers()[2], pa.Codec("zstd", 1).compress
    counts = counts.astype("<i8")
    for begin in range(0, len(starts) - 1, ROWS_AT_ONCE):
        spans = list(zip(starts[begin:-1], starts[begin + 1:], strict=True))[:ROWS_AT_ONCE]
        yield pa.RecordBatch.from_arrays([
            pa.array([language] * len(spans), pa.string()), pa.array([int(homes[a]) for a, _ in spans], pa.int64()),
            pa.array([int(ends[b] - ends[a]) for a, b in spans], pa.int64()), pa.array([int(b - a) for a, b in spans], pa.int64()),
            pa.array([pack(data.slice(int(ends[a]), int(ends[b] - ends[a])), asbytes=True) for a, b in spans], pa.binary()),
            pa.array([pack(counts[a:b].tobytes(), asbytes=True) for a, b in spans], pa.binary())],
            names=["lang", "home", "size", "entries", "phrases", "counts"])


_RUN = "lang string, home bigint, size bigint, entries bigint, phrases binary, counts binary"


def sorted_runs(docs: DataFrame, partitions: int, longest: int = 3, entries: int = TRIE_ENTRIES, burst: int = BURST) -> DataFrame:
    """Runs of ``lang``, ``home`` (partition), ``phrases`` (one a line) and ``counts`` (8 bytes each), both packed, with their numbers."""

    def run(batches):
        trie = PhraseTrie(longest, burst)

        def spill(share):
            keys, n = trie.take(share)
            if not len(keys):
                return
            language_of = np.zeros(max(max(d.values()) for d in trie.numbers.values()) + 1, np.int64)
            for i, numbers in enumerate(trie.numbers.values()):
                language_of[np.fromiter(numbers.values(), np.int64, len(numbers))] = i
            languages = language_of[keys >> 2 * _BITS]
            for i, (language, numbers) in enumerate(trie.numbers.items()):
                own = languages == i
                if own.any():
                    yield from _runs(language, keys[own], n[own], numbers, partitions, longest)

        for part in slices(batches):
            together: dict[str, list[bytes]] = {}
            for language, text in zip(strings(part, "lang"), raw_bytes(part), strict=True):
                together.setdefault(_LANGUAGE if language is None else language, []).append(text or b"")
            for language, texts in together.items():
                tokens = [t for t in b"\n".join(texts).translate(_TABLE).replace(b"\n", b" \n ").split(b" ") if t]
                for start in range(0, len(tokens), WORDS_AT_ONCE):
                    trie.add(language, tokens, start, min(start + WORDS_AT_ONCE, len(tokens)))
                    trie.burst_large()
                    if trie.words() > KNOWN_WORDS:
                        yield from spill(1.0)
                        trie.forget()
                    elif trie.entries() > entries:
                        yield from spill(SPILLED)
        yield from spill(1.0)

    return arrow_pass(docs, ["lang", "text"], run, _RUN)


def _merged(rows: list[tuple[int, int, bytes, bytes]], least: int) -> tuple[pa.Array, pa.Array, int]:
    """Phrases of at least ``least`` occurrences over all runs, their counts, and the occurrences of single words."""
    unpack = pa.Codec("zstd").decompress
    text = np.concatenate([np.frombuffer(unpack(p, size), np.uint8) for size, _, p, _ in rows])
    counts = np.concatenate([np.frombuffer(unpack(c, 8 * n), "<i8") for _, n, _, c in rows])
    ends = np.flatnonzero(text == 10) + 1
    phrases = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.r_[0, ends]), pa.py_buffer(text)])
    alone = np.add.reduceat(text == 32, np.r_[0, ends[:-1]], dtype=np.int64) == 0
    table = pa.table({"phrase": phrases, "n": counts}).group_by("phrase").aggregate([("n", "sum")])
    table = table.filter(pc.greater_equal(table["n_sum"], least))
    found = pc.binary_slice(table["phrase"].combine_chunks(), 0, -1)
    return found, table["n_sum"].combine_chunks(), int(counts[alone].sum())


def phrase_counts(docs: DataFrame, least: int = 10, longest: int = 3, entries: int = TRIE_ENTRIES, burst: int = BURST) -> DataFrame:
    """``lang``, ``phrase`` and ``n`` of phrases of 1 to ``longest`` words with at least ``least`` occurrences.

    Rows without a phrase hold parts of the number of all words. The number of partitions follows from the bytes of
    text. A phrase's partition comes from a hash of all its words, so neither a frequent word nor a frequent pair
    makes a large one, and each run has a phrase once. Runs of a partition arrive sorted by partition, and
    only those of one partition are in memory.
    """
    if longest not in (2, 3):
        raise ValueError("phrases have two or three words at most")
    size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = max(1, -(-size // PARTITION_BYTES))
    runs = sorted_runs(docs, partitions, longest, entries, burst)

    def merge(batches):
        key, rows = None, []

        def done():
            found, counts, words = _merged(rows, least)
            phrases = pa.concat_arrays([found.cast(pa.large_string()), pa.array([None], pa.large_string())])
            return pa.RecordBatch.from_arrays([
                pa.array([key[1]] * len(phrases), pa.string()), phrases.cast(pa.string()),
                pa.concat_arrays([counts, pa.array([words], pa.int64())])], names=["lang", "phrase", "n"])

        for batch in batches:
            for row in zip(*[batch.column(i).to_pylist() for i in range(6)], strict=True):
                if row[:2] != key and rows:
                    yield done()
                    rows = []
                key = row[:2]
                rows.append(row[2:])
        if rows:
            yield done()

    together = runs.repartition("home", "lang").sortWithinPartitions("home", "lang")
    return arrow_pass(together, ["home", "lang", "size", "entries", "phrases", "counts"], merge, "lang string, phrase string, n bigint")


def score_of(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (l * r)) in decimals of 38 digits, exact for counts below ``LARGEST_COUNT``."""
    wide = lambda c: c.cast("decimal(15,0)")
    upper = (wide(a) * wide(a)).cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    product = (wide(left) * wide(right)).cast("decimal(31,0)")
    return F.call_function("div", upper, product).cast("bigint")


def collocations(docs: DataFrame, least: int = 10, longest: int = 3, cover: int = 50, first: int = 2000,
                 entries: int = TRIE_ENTRIES, burst: int = BURST) -> DataFrame:
    """The ``first`` best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    ``docs`` has ``lang`` and ``text``. A phrase has 2 to ``longest`` words of one piece and ``least`` occurrences
    or more; it goes when a longer one that holds it has ``cover`` percent of its occurrences or more. Its score
    is that of its weakest cut. A null language counts as ``und``; null, empty and blank texts have no
    words; repeated rows count each. Further columns aren't read. An empty table gives an empty table.

    All parts of a frequent phrase are frequent, so the joins see only what the merge let through, written once:
    both sides are plain shuffles, and adaptive execution splits the rows that share one frequent word.
    """
    counted = stage(phrase_counts(docs, least, longest, entries, burst), "phrases")
    totals = counted.where("phrase is null").groupBy("lang").agg(F.sum("n").alias("n"))
    known = counted.where("phrase is not null")
    words = F.split("phrase", " ")
    candidates = known.select("lang", "phrase", F.col("n").alias("a"), words.alias("w")).where(F.size("w") > 1)
    joined = lambda start, length: F.array_join(F.slice("w", start, length), " ")

    cuts = candidates.select("lang", "phrase", "a", "w", F.explode(F.expr("sequence(1, size(w) - 1)")).alias("k")).select(
        "lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("left"), joined(F.col("k") + 1, F.size("w") - F.col("k")).alias("right"))
    side = lambda name, count: known.select("lang", F.col("phrase").alias(name), F.col("n").alias(count))
    cut = stage(cuts.join(side("left", "l"), ["lang", "left"]), "phrase-cuts").join(side("right", "r"), ["lang", "right"])
    cut = cut.withColumn("score", score_of(F.col("a"), F.col("l"), F.col("r")))
    scored = cut.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("weakest"))

    within = "flatten(transform(sequence(2, size(w) - 1), m -> transform(sequence(1, size(w) - m + 1), i -> array_join(slice(w, i, m), ' '))))"
    covers = (candidates.where(F.size("w") > 2).select("lang", F.explode(F.array_distinct(F.expr(within))).alias("phrase"), "a")
              .groupBy("lang", "phrase").agg(F.max("a").alias("longer")))
    left = (scored.join(covers, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < cover * F.col("a")))
            .select("lang", "phrase", "a", "weakest.l", "weakest.r", "weakest.score"))
    # Best of each share of a language first, so that no task sorts all phrases of one.
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    share = left.withColumn("_share", F.pmod(F.xxhash64("phrase"), F.lit(SHARES)))
    leading = share.withColumn("_place", F.row_number().over(Window.partitionBy("lang", "_share").orderBy(*best))).where(F.col("_place") <= first)
    ranked = leading.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= first)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
