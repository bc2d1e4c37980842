"""Document quality by histogram gradient-boosted trees over text statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, arrow_pass, raw_bytes, slices
from .quality_rules import COMMON_WORDS
from .textstats import CLASSES, byte_counts, class_counts, repeated_lines

#: Bound of the labelled rows that training takes, spread evenly by a hash of their id.
MAX_TRAINING_ROWS = 40_000
TREES, DEPTH, BINS, LEARNING_RATE, RIDGE, MIN_ROWS = 80, 4, 64, 0.15, 2.0, 20
#: Words that any language counts as common.
FREQUENT = frozenset(w.encode() for words in COMMON_WORDS.values() for w in words)
FEATURES = ("words", "chars", "word_length", "distinct", "top_word", "same_as_before", "frequent", "capital_words", "marked_words",
            "lines", "line_words", "repeated_lines", "stops_per_line", "entropy", "bars", "exclamations", *CLASSES)


def document_features(text: bytes | None) -> list[float]:
    """Statistics of one UTF-8 text, in the order of ``FEATURES``; an empty text has zeros."""
    text = text or b""
    counts = byte_counts(text)
    classes = class_counts(counts)
    chars = classes.sum()
    if chars == 0:
        return [0.0] * len(FEATURES)
    words = text.split()
    n = max(len(words), 1)
    seen: dict[bytes, int] = {}
    for word in words:
        seen[word] = seen.get(word, 0) + 1
    lines, again = repeated_lines(text)
    share = counts[counts > 0] / len(text)
    stops = classes[CLASSES.index("stop")]
    return [
        np.log1p(len(words)), np.log1p(chars), (chars - classes[CLASSES.index("space")] - classes[CLASSES.index("line_end")]) / n,
        len(seen) / n, max(seen.values(), default=0) / n, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        sum(k for w, k in seen.items() if w.lower() in FREQUENT) / n, sum(k for w, k in seen.items() if w.isupper() and len(w) > 1) / n,
        sum(k for w, k in seen.items() if w[-2:] in (b"**", b"$$", b"##", b"%%", b"&&", b"!!")) / n, lines / n, n / max(lines, 1),
        again / max(lines, 1), stops / max(lines, 1), -float(np.sum(share * np.log2(share))), counts[ord("|")] / chars,
        counts[ord("!")] / chars, *(classes / chars)]


@dataclass
class Trees:
    """All trees as arrays: row t holds tree t, node i has children 2i+1 and 2i+2, leaves fill the last level."""

    feature: np.ndarray
    limit: np.ndarray
    leaf: np.ndarray
    start: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row, all trees at once, one level at a time."""
        rows, trees = np.arange(len(x))[:, None], np.arange(len(self.feature))[None, :]
        node = np.zeros((len(x), len(self.feature)), np.int64)
        depth = int(np.log2(self.leaf.shape[1]))
        for _ in range(depth):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.limit[trees, node])
        raw = self.start + self.leaf[trees, node - self.feature.shape[1]].sum(axis=1)
        return 1 / (1 + np.exp(-raw))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Boost logistic loss; each level of a tree takes its best splits from histograms of binned features."""
    columns = x.shape[1]
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(columns)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    limits = np.full((columns, BINS), np.inf)
    for j, e in enumerate(edges):
        limits[j, :len(e)] = e
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(mean / (1 - mean)))
    raw, inner = np.full(len(y), start), 2 ** depth - 1
    feature, limit, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, 2 ** depth))
    flat = binned + np.arange(columns) * BINS
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        gradient, curve = y - p, p * (1 - p)
        at = np.zeros(len(y), np.int64)
        for level in range(depth):
            width, first = 2 ** level, 2 ** level - 1
            cell = ((at - first) * (columns * BINS))[:, None] + flat
            size = width * columns * BINS
            sums = [np.bincount(cell.ravel(), np.repeat(v, columns), size).reshape(width, columns, BINS).cumsum(axis=2)
                    for v in (gradient, curve, np.ones(len(y)))]
            g, h, n = sums
            gain = (g ** 2 / (h + RIDGE) + (g[..., -1:] - g) ** 2 / (h[..., -1:] - h + RIDGE) - g[..., -1:] ** 2 / (h[..., -1:] + RIDGE))
            gain[(n < MIN_ROWS) | (n[..., -1:] - n < MIN_ROWS)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            split = gain.reshape(width, -1)[np.arange(width), best] > 1e-9
            j, b = best // BINS, best % BINS
            feature[t, first:first + width] = np.where(split, j, 0)
            limit[t, first:first + width] = np.where(split, limits[j, b], np.inf)
            bars = np.where(split, b, BINS)
            at = 2 * at + 1 + (binned[np.arange(len(y)), feature[t, at]] > bars[at - first])
        place = at - inner
        leaf[t] = LEARNING_RATE * np.bincount(place, gradient, 2 ** depth) / (np.bincount(place, curve, 2 ** depth) + RIDGE)
        raw += leaf[t, place]
    return Trees(feature, limit, leaf, start)


def held_out(doc_id: Column) -> Column:
    """A fifth of all ids, by the CRC-32 of their text, never used in training. False without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAINING_ROWS) -> Trees | None:
    """Trees for ``labels.quality`` from labelled documents that are not held out; None without such rows.

    An id's label is that of most of its rows, 0 if as many say so. About ``most`` ids are used, chosen by a hash
    of the id, and one document of each (that of the smallest statistics); only these statistics reach the driver.
    The chosen ids, of that bounded number, are sent to the documents, so no text is shuffled. So neither
    an id with most labels nor one with most documents makes more than one row.
    """
    usable = labels.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
    usable = usable.groupBy(F.col("doc_id").alias("label_id")).agg((2 * F.sum("quality") > F.count("*")).cast("int").alias("quality"))
    total = usable.count()
    if total == 0:
        return None
    parts = 1 << 40
    chosen = usable.where(F.pmod(F.xxhash64("label_id"), F.lit(parts)) < int(parts * min(1.0, most / total)))
    # Bounded: about ``most`` rows, one per id.
    labelled = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))

    def run(batches):
        for part in slices(batches):
            rows = [document_features(t) for t in raw_bytes(part)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "quality", "x"])

    found = arrow_pass(labelled, ["doc_id", "quality", "text"], run, "doc_id bigint, quality int, x array<double>")
    rows = found.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("x").alias("x")).toArrow()
    if rows.num_rows == 0:
        return None
    x = np.array(rows.column("x").to_pylist())
    y, ids = rows.column("quality").to_numpy().astype(float), rows.column("doc_id").to_numpy()
    order = np.argsort(ids)  # the same trees whatever order the rows arrive in
    return fit(x[order], y[order])


def score_documents(docs: DataFrame, trees: Trees | None, bar: float = 0.3) -> DataFrame:
    """All columns of ``docs``, ``score`` (probability of label 1) and ``predicted`` (1 from ``bar`` on).

    Null and empty texts are scored as texts of zero statistics. Without trees every score is 0.5. Repeated
    rows give a row each; a column with the name of a result gives way to it. An empty table gives an empty table.
    """

    def work(part):
        x = np.array([document_features(t) for t in raw_bytes(part)]).reshape(part.num_rows, len(FEATURES))
        scores = trees.scores(x) if trees else np.full(part.num_rows, 0.5)
        return [pa.array(scores), pa.array((scores >= bar).astype(np.int32))]

    return append_columns(docs, work, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
