"""Quality rules: repetition and symbol counts, and distance from language references."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, arrow_pass, raw_bytes, slices, strings
from .textstats import (
    CLASSES,
    CONTINUES,
    SYMBOLS,
    WHITE,
    byte_counts,
    class_counts,
    repeated_lines,
    repeated_window_words,
)

# Frequent words of each language.
COMMON_WORDS = {
    "en": "the of and to in a is that it for was on are as with at be this from by or an have not which".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il avec".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero".split(),
}
LANGUAGES = tuple(COMMON_WORDS)
_PLACES = {lang: {w.encode(): i for i, w in enumerate(words)} for lang, words in COMMON_WORDS.items()}
N_COMMON = max(map(len, COMMON_WORDS.values()))
#: Limits of the two distances for long texts, and what n words add to each, divided by the root of n.
MAX_CLASS_DISTANCE, SHORT_CLASS_SLACK = 0.15, 1.8
MAX_WORD_DISTANCE, SHORT_WORD_SLACK = 0.12, 2.0
#: The distances judge no text with fewer words.
MIN_WORDS = 40
#: Counts that are added to every entry of a reference.
PRIOR = 0.5
FIELDS = [T.StructField(n, t) for n, t in (
    ("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()),
    ("n_repeat_words", T.LongType()), ("class_distance", T.DoubleType()), ("word_distance", T.DoubleType()),
    ("base_failed", T.BooleanType()), ("kept", T.BooleanType()))]


def histogram(words: list[bytes], counts: np.ndarray, lang: str) -> np.ndarray:
    """Character classes, then the language's common words, then all other words."""
    places = _PLACES[lang]
    common = np.zeros(N_COMMON + 1)
    for word in words:
        i = places.get(word)
        if i is not None:
            common[i] += 1
    common[-1] = len(words) - common.sum()
    return np.concatenate([class_counts(counts), common])


def language_references(docs: DataFrame) -> dict[str, np.ndarray]:
    """Per language the histogram of all its documents: one sum per language and entry, over the whole table."""
    entries = len(CLASSES) + N_COMMON + 1

    def run(batches):
        sums = {lang: np.zeros(entries) for lang in LANGUAGES}
        for part in slices(batches):
            for text, lang in zip(raw_bytes(part), strings(part, "lang"), strict=True):
                if text and lang in sums:
                    sums[lang] += histogram(text.lower().split(), byte_counts(text), lang)
        rows = [(lang, i, float(v)) for lang, all_ in sums.items() for i, v in enumerate(all_) if v]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()),
             pa.array([r[2] for r in rows], pa.float64())], names=["lang", "entry", "n"])

    sums = arrow_pass(docs, ["text", "lang"], run, "lang string, entry int, n double")
    found: dict[str, np.ndarray] = {}
    for lang, entry, n in sums.groupBy("lang", "entry").agg(F.sum("n")).collect():
        found.setdefault(lang, np.zeros(entries))[entry] = n
    return found


def _distance(rows: np.ndarray, reference: np.ndarray) -> float:
    """Jensen-Shannon distance (root of the divergence in bits) of two histograms; zero for an empty one."""
    if rows.sum() == 0 or reference.sum() == 0:
        return 0.0
    p, q = rows / rows.sum(), (reference + PRIOR) / (reference + PRIOR).sum()
    m = (p + q) / 2
    part = lambda x: np.sum(np.where(x > 0, x * np.log2(np.where(x > 0, x, 1) / m), 0))
    return float(np.sqrt(max(0.0, (part(p) + part(q)) / 2)))


def judge(text: bytes | None, lang: str | None, references: dict[str, np.ndarray]) -> tuple:
    """The values of ``FIELDS`` for one text."""
    text = text or b""
    words, counts = text.split(), byte_counts(text)
    n = len(words)
    chars = int(counts[~CONTINUES & ~WHITE].sum())
    repeats = repeated_window_words(words)
    failed = n < 10 or 100 * repeats > 20 * n
    small, cut = [w.lower() for w in words], len(CLASSES)
    nearest = (0.0, 0.0)
    if references and n:
        against = [lang] if lang in references else sorted(references)
        pairs = []
        for name in against:
            own = histogram(small, counts, name)
            pairs.append((_distance(own[:cut], references[name][:cut]), _distance(own[cut:], references[name][cut:])))
        nearest = min(pairs, key=sum)
    root = max(n, 1) ** 0.5
    far = n >= MIN_WORDS and (nearest[0] > MAX_CLASS_DISTANCE + SHORT_CLASS_SLACK / root
                              or nearest[1] > MAX_WORD_DISTANCE + SHORT_WORD_SLACK / root)
    return n, chars, int(counts[SYMBOLS].sum()), repeated_lines(text)[1], repeats, *nearest, failed, not failed and not far


def judge_documents(docs: DataFrame, references: dict[str, np.ndarray] | None = None) -> DataFrame:
    """All columns of ``docs`` and those of ``FIELDS``; ``references`` come from ``docs`` itself if not given.

    ``kept`` is false for texts with under 10 words, with over a fifth of their words in repeated 5-word
    windows, or, from ``MIN_WORDS`` words on, at a Jensen-Shannon distance over the limit from the reference
    of their language: character classes or common words. A document of no known language is held against
    the nearest reference. Null and empty texts have no words and fail. Repeated rows give a row each. A
    column with the name of a result gives way to it. An empty table gives an empty table. No document's text
    leaves its task; the references are a few dozen sums per language. References from the judged table itself
    are only as good as most of it is; give fixed ones (``language_references`` of a trusted table) where that is in doubt.
    """
    if references is None:
        references = language_references(docs)

    def work(part):
        rows = [judge(t, lang, references) for t, lang in zip(raw_bytes(part), strings(part, "lang"), strict=True)]
        kinds = {T.LongType(): pa.int64(), T.DoubleType(): pa.float64(), T.BooleanType(): pa.bool_()}
        return [pa.array([r[i] for r in rows], kinds[f.dataType]) for i, f in enumerate(FIELDS)]

    return append_columns(docs, work, FIELDS)
