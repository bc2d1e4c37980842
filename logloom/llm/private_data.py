"""Personal data: base patterns, and a character-level bidirectional LSTM with CRF transitions for what they miss."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_pass, slices, strings

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # kind, start, end in code points

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SEED = re.compile("[0-9@]")
_NOT_DIGIT = re.compile("[^0-9]+")


def luhn(digits: str) -> bool:
    twice = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(twice)) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The run of local-part characters before each ``@`` with a dotted domain; linear in the text."""
    end = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            end = m.end()


def base_spans(text: str) -> list[Span]:
    """Spans by pattern: per kind the leftmost that do not overlap, those that fail the kind's test dropped."""
    spans: list[Span] = []
    if "@" in text:
        spans += [(0, *s) for s in _emails(text)]
    if _SEED.search(text):
        spans += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups())]
        for m in _CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                spans.append((2, *m.span()))
        if "+" in text:
            spans += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]
    return spans


# --- the tagger -------------------------------------------------------------------------------------------------

WINDOW, STRIDE = 96, 48
#: Characters on either side of a digit or ``@`` that are tagged; every kind's spans hold one of the two.
REACH = 24
HIDDEN, STEPS, BATCH, RATE = 16, 220, 48, 0.02
#: Texts that training takes, chosen by hash of their content.
MAX_TRAINING_TEXTS = 1500
#: Windows that are tagged at a time, and windows of texts that are decoded together.
WINDOWS_AT_ONCE = 512
WINDOWS_TOGETHER = 4096
TAGS = 2 * len(KINDS) + 1  # 0: outside; 2k+1: first character of kind k; 2k+2: further ones
_MARKS = "@._%+-()[]{}<>/\\:;,=#*\"'!?|&$~^`"
PAD, SPACE, LINE, DIGIT, LOWER, UPPER, OTHER = range(7)
CLASSES = 7 + len(_MARKS)


def _class_table() -> np.ndarray:
    table = np.full(129, OTHER, np.int64)
    table[[ord(c) for c in " \t"]], table[[10, 13]] = SPACE, LINE
    table[48:58], table[97:123], table[65:91] = DIGIT, LOWER, UPPER
    table[[ord(c) for c in _MARKS]] = 7 + np.arange(len(_MARKS))
    return table


_TABLE = _class_table()


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def classes_of(points: np.ndarray) -> np.ndarray:
    return _TABLE[np.minimum(points, 128)]


def _allowed() -> np.ndarray:
    """Large negative scores where a tag can't follow another: inside a kind only after that kind."""
    bar = np.zeros((TAGS, TAGS), np.float32)
    for inside in range(2, TAGS, 2):
        bar[[t for t in range(TAGS) if t not in (inside, inside - 1)], inside] = -1e4
    return bar


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class Tagger:
    """BiLSTM over character classes with a linear-chain CRF over tags; arrays of shape (time, batch, ...)."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        draw = lambda *s: rng.normal(0, 0.15, s).astype(np.float32)
        self.p = {"out": draw(2 * HIDDEN, TAGS), "bias": np.zeros(TAGS, np.float32), "trans": draw(TAGS, TAGS), "first": draw(TAGS)}
        for side in "fb":
            self.p["in" + side], self.p["rec" + side] = draw(CLASSES, 4 * HIDDEN), draw(HIDDEN, 4 * HIDDEN)
            self.p["in" + side][:, HIDDEN:2 * HIDDEN] += 1  # forget gates begin open

    def _run(self, ids: np.ndarray, side: str, keep: bool):
        steps, batch = ids.shape
        h = c = np.zeros((batch, HIDDEN), np.float32)
        out, trace = np.empty((steps, batch, HIDDEN), np.float32), []
        rec, entry, n = self.p["rec" + side], self.p["in" + side], HIDDEN
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            z = entry[ids[t]] + h @ rec
            gates, g = _sigmoid(z[:, :3 * n]), np.tanh(z[:, 3 * n:])
            before = (h, c)
            c = gates[:, n:2 * n] * c + gates[:, :n] * g
            squashed = np.tanh(c)
            h = gates[:, 2 * n:] * squashed
            out[t] = h
            if keep:
                trace.append((t, *before, gates, g, squashed))
        return out, trace

    def _emissions(self, ids: np.ndarray, keep: bool = False):
        forward, f = self._run(ids, "f", keep)
        backward, b = self._run(ids, "b", keep)
        both = np.concatenate([forward, backward], axis=2)
        return both @ self.p["out"] + self.p["bias"], both, f, b

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Best tag path of each window; ``ids`` and result are (windows, time)."""
        emissions = self._emissions(np.ascontiguousarray(ids.T))[0]
        trans = self.p["trans"] + _allowed()
        score, back = emissions[0] + self.p["first"] + _allowed()[0], np.empty(emissions.shape, np.int8)
        for t in range(1, len(emissions)):
            paths = score[:, :, None] + trans
            back[t] = paths.argmax(axis=1)
            score = paths.max(axis=1) + emissions[t]
        tags = np.empty(emissions.shape[:2], np.int64)
        tags[-1] = score.argmax(axis=1)
        for t in range(len(emissions) - 1, 0, -1):
            tags[t - 1] = back[t][np.arange(tags.shape[1]), tags[t]]
        return tags.T

    def gradients(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of (time, batch) tags, and its gradient."""
        emissions, both, f, b = self._emissions(ids, keep=True)
        steps, batch, rows = *ids.shape, np.arange(ids.shape[1])
        trans, first = self.p["trans"] + _allowed(), self.p["first"] + _allowed()[0]
        alpha, beta = np.empty_like(emissions), np.zeros_like(emissions)
        alpha[0] = first + emissions[0]
        for t in range(1, steps):
            alpha[t] = _logsum(alpha[t - 1][:, :, None] + trans, 1) + emissions[t]
        for t in range(steps - 2, -1, -1):
            beta[t] = _logsum(trans + (emissions[t + 1] + beta[t + 1])[:, None, :], 2)
        total = _logsum(alpha[-1], 1)
        said = first[tags[0]] + emissions[0][rows, tags[0]]
        d_trans = np.zeros_like(trans)
        for t in range(1, steps):
            said = said + trans[tags[t - 1], tags[t]] + emissions[t][rows, tags[t]]
            d_trans += np.exp(alpha[t - 1][:, :, None] + trans + (emissions[t] + beta[t] - total[:, None])[:, None, :]).sum(axis=0)
        np.subtract.at(d_trans, (tags[:-1], tags[1:]), 1)
        d_emit = np.exp(alpha + beta - total[:, None])
        d_first = d_emit[0].sum(axis=0)
        np.subtract.at(d_first, tags[0], 1)
        d_emit[np.arange(steps)[:, None], rows, tags] -= 1
        d_emit /= batch
        grad = {"trans": d_trans / batch, "first": d_first / batch, "bias": d_emit.sum(axis=(0, 1)),
                "out": both.reshape(-1, 2 * HIDDEN).T @ d_emit.reshape(-1, TAGS)}
        d_both = d_emit @ self.p["out"].T
        for side, trace, d_out in (("f", f, d_both[..., :HIDDEN]), ("b", b, d_both[..., HIDDEN:])):
            grad["in" + side], grad["rec" + side] = self._back(ids, side, trace, d_out)
        return float((total - said).mean()), grad

    def _back(self, ids, side, trace, d_out):
        n, rec = HIDDEN, self.p["rec" + side]
        d_in, d_rec = np.zeros_like(self.p["in" + side]), np.zeros_like(rec)
        d_h = d_c = np.zeros((ids.shape[1], n), np.float32)
        for t, h, c, gates, g, squashed in reversed(trace):
            d_h = d_h + d_out[t]
            i, forget, o = gates[:, :n], gates[:, n:2 * n], gates[:, 2 * n:]
            d_c = d_c + d_h * o * (1 - squashed ** 2)
            d_gates = np.concatenate([d_c * g, d_c * c, d_h * squashed], axis=1) * gates * (1 - gates)
            d_z = np.concatenate([d_gates, d_c * i * (1 - g ** 2)], axis=1)
            d_rec += h.T @ d_z
            np.add.at(d_in, ids[t], d_z)
            d_h, d_c = d_z @ rec.T, d_c * forget
        return d_in, d_rec

    def fit(self, examples: list[tuple[str, list[Span]]], steps: int = STEPS, seed: int = 5) -> Tagger:
        """Adam on random batches of labelled texts, cut or padded to a window."""
        rng = np.random.default_rng(seed)
        ids, tags = np.zeros((len(examples), WINDOW), np.int64), np.zeros((len(examples), WINDOW), np.int64)
        for row, (text, spans) in enumerate(examples):
            own = classes_of(code_points(text))[:WINDOW]
            ids[row, :len(own)] = own
            for kind, start, end in spans:
                tags[row, start:end] = 2 * kind + 2
                if start < WINDOW:
                    tags[row, start] = 2 * kind + 1
        mean = {k: np.zeros_like(v) for k, v in self.p.items()}
        square = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(examples), BATCH)
            _, grad = self.gradients(np.ascontiguousarray(ids[pick].T), np.ascontiguousarray(tags[pick].T))
            norm = np.sqrt(sum(float((g ** 2).sum()) for g in grad.values()))
            rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, g in grad.items():
                g = g * min(1.0, 5 / (norm + 1e-9))
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.99 * square[k] + 0.01 * g * g
                self.p[k] -= (rate * (mean[k] / (1 - 0.9 ** step)) / (np.sqrt(square[k] / (1 - 0.99 ** step)) + 1e-6)).astype(np.float32)
        return self


def labelled_examples(texts: list[str], seed: int = 9) -> list[tuple[str, list[Span]]]:
    """Windows with labelled spans: base spans of real texts, and spellings that the patterns miss, set into them."""
    rng = np.random.default_rng(seed)
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    letters = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), n))

    def card() -> str:
        body = str(rng.integers(3, 7)) + digits(14)
        return next(body + str(d) for d in range(10) if luhn(body + str(d)))

    def one() -> tuple[int | None, str]:
        part, host, octets = letters(rng.integers(2, 9)), letters(rng.integers(3, 9)), [str(x) for x in rng.integers(1, 256, 4)]
        number, groups = card(), (digits(3), digits(3), digits(4))
        return [
            (0, f"{part}.{digits(2)}@{host}.example.com"), (0, f"{part} @ {host}.com"), (0, f"{part}@ {host}.org"), (0, f"{part}[@]{host}.net"),
            (1, ".".join(octets)), (1, "[.]".join(octets)), (1, " . ".join(octets)), (1, "(.)".join(octets)),
            (2, number), (2, ".".join(number[i:i + 4] for i in range(0, 16, 4))), (2, "/".join(number[i:i + 4] for i in range(0, 16, 4))),
            (3, f"+1 ({groups[0]}) {groups[1]}-{groups[2]}"), (3, f"({groups[0]}) {groups[1]}-{groups[2]}"), (3, "-".join(groups)), (3, ".".join(groups)),
            (None, f"version {rng.integers(1, 9)}.{rng.integers(0, 9)}"), (None, str(rng.integers(1900, 2100))), (None, digits(rng.integers(1, 7))),
            (None, f"{digits(2)}:{digits(2)}"), (None, f"{digits(4)}-{digits(2)}-{digits(2)}"), (None, f"AKIA{digits(3)}Q{digits(5)}XY"),
            (None, f'token = "{letters(3)}{digits(9)}{letters(2)}{digits(14)}"'), (None, f"@{part}"), (None, f"{digits(3)},{digits(3)}.{digits(2)}"),
        ][rng.integers(0, 24)]

    out = []
    for text in texts:
        text = text[:WINDOW]
        out.append((text, base_spans(text)))
        plain = re.sub("[0-9@+]+", "", text)
        kind, value = one()
        at = int(rng.integers(0, max(1, min(len(plain), WINDOW - 40))))
        lead = plain[:at] + (" " if at else "")
        out.append(((lead + value + " " + plain[at:])[:WINDOW], [] if kind is None else [(kind, len(lead), len(lead) + len(value))]))
    return out


def train(docs: DataFrame, most: int = MAX_TRAINING_TEXTS) -> Tagger:
    """A tagger from windows around digits and ``@`` of at most ``most`` texts, the first by a hash of the window.

    With fewer than 50 such texts, plain lines fill up the list.
    """

    def run(batches):
        for part in slices(batches):
            found = []
            for text in strings(part):
                m = _SEED.search(text) if text else None
                if m:
                    found.append(text[max(0, m.start() - WINDOW // 2):m.start() + WINDOW // 2])
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["window"])

    windows = arrow_pass(docs, ["text"], run, "window string").distinct()
    texts = [r["window"] for r in windows.orderBy(F.xxhash64("window"), "window").limit(most).collect()]
    texts += ["er in the and on ared thion of anest, whe rinte to ander thes is. And at ored es the"] * max(0, 50 - len(texts))
    repeat = max(1, 300 // len(texts))
    return Tagger().fit([e for i in range(repeat) for e in labelled_examples(texts, 9 + i)])


def _plausible(kind: int, value: str) -> bool:
    """What a tagged span must have to count: the parts that make its kind usable."""
    digits = _NOT_DIGIT.sub("", value)
    if kind == 0:
        return bool(re.fullmatch(r"[A-Za-z0-9._%+-]+\W{0,3}@\W{0,3}[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", value))
    if kind == 1:
        parts = re.split(r"[^0-9]+", value)
        return len(parts) == 4 and all(0 < len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        return 16 <= len(digits) <= 19 and luhn(digits)
    return bool(re.fullmatch(r"[+(]?[0-9][0-9 ().-]*[0-9]", value)) and 9 <= len(digits) <= 15 and len(re.findall("[0-9]+", value)) >= 3


def _best_paths(emissions: np.ndarray, bases: np.ndarray, lengths: np.ndarray, tagger: Tagger) -> np.ndarray:
    """Best tag path of each stretch of the flat ``emissions``; all stretches advance together, the longest first."""
    order = np.argsort(-lengths, kind="stable")
    bases, lengths = bases[order], lengths[order]
    trans, first = tagger.p["trans"] + _allowed(), tagger.p["first"] + _allowed()[0]
    back, tags = np.zeros(emissions.shape, np.int8), np.zeros(len(emissions), np.int64)
    score = emissions[bases] + first
    steps = np.arange(int(lengths[0]))
    active = np.searchsorted(-lengths, -steps, side="left")  # stretches that are longer than t
    for t in steps[1:]:
        n = active[t]
        paths = score[:n, :, None] + trans
        back[bases[:n] + t] = paths.argmax(axis=1)
        score[:n] = paths.max(axis=1) + emissions[bases[:n] + t]
    now = score.argmax(axis=1)
    for t in steps[::-1]:
        n, longer = active[t], active[t + 1] if t + 1 < len(steps) else 0
        now[:longer] = back[bases[:longer] + t + 1, now[:longer]]
        tags[bases[:n] + t] = now[:n]
    return tags


def _tagged_some(rows: list[tuple[int, np.ndarray, np.ndarray]], tagger: Tagger) -> Iterator[tuple[int, np.ndarray]]:
    """(row, tag of each character) of texts given as (row, classes, numbers of the windows to be read).

    Neighbouring windows make a stretch. A character's emissions are the mean over the windows that hold it, by its
    distance from their ends; then one path is decoded for the whole stretch.
    """
    inputs, offsets, odd, stretches, total = [], [], [], [], 0
    for row, classes, own in rows:
        padded = np.concatenate([np.zeros(STRIDE, np.int64), classes, np.zeros(WINDOW + STRIDE, np.int64)])
        # Window k starts at (k - 1) * STRIDE of the text.
        inputs.append(np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[own * STRIDE])
        breaks = np.flatnonzero(np.diff(own) > 1) + 1
        for part in np.split(own, breaks):
            offsets.append(total + (part - part[0]) * STRIDE)
            odd.append((part - part[0]) % 2 == 1)
            length = int(part[-1] - part[0]) * STRIDE + WINDOW
            stretches.append((row, (int(part[0]) - 1) * STRIDE, total, length))
            total += length
    inputs, offsets, odd = np.concatenate(inputs), np.concatenate(offsets), np.concatenate(odd)
    weight = np.minimum(np.arange(WINDOW) + 1, WINDOW - np.arange(WINDOW)).astype(np.float32)
    emissions, weights = np.zeros((total, TAGS), np.float32), np.zeros(total, np.float32)
    for a in range(0, len(inputs), WINDOWS_AT_ONCE):
        found = tagger._emissions(np.ascontiguousarray(inputs[a:a + WINDOWS_AT_ONCE].T))[0].transpose(1, 0, 2)
        for half in (False, True):  # every other window of a stretch; these don't overlap
            own = odd[a:a + WINDOWS_AT_ONCE] == half
            at = offsets[a:a + WINDOWS_AT_ONCE][own][:, None] + np.arange(WINDOW)
            emissions[at] += found[own] * weight[:, None]
            weights[at] += weight
    emissions /= weights[:, None]
    bases, lengths = (np.array([s[i] for s in stretches]) for i in (2, 3))
    tags, kept = _best_paths(emissions, bases, lengths, tagger), {row: np.zeros(len(classes), np.int64) for row, classes, _ in rows}
    for row, start, base, length in stretches:
        low, high = max(start, 0), min(start + length, len(kept[row]))
        kept[row][low:high] = tags[base + low - start:base + high - start]
    yield from kept.items()


def tagged_spans(texts: list[str], tagger: Tagger) -> list[list[Span]]:
    """Spans that the tagger finds in whole texts.

    Windows lie on a grid and overlap by half. Those near a digit or ``@`` are read; neighbouring ones are decoded as
    one stretch, so a span is found alike wherever the windows' borders fall. Texts are taken together up to
    ``WINDOWS_TOGETHER`` windows; memory grows with the longest text.
    """
    out: list[list[Span]] = [[] for _ in texts]
    held, count = [], 0
    for row, text in enumerate(texts):
        if text and _SEED.search(text):
            points = code_points(text)
            seeds = np.flatnonzero(((points >= 48) & (points < 58)) | (points == 64))
            own = np.unique((np.clip(np.concatenate([seeds - REACH, seeds, seeds + REACH]), 0, len(points) - 1) + STRIDE // 2) // STRIDE)
            held.append((row, classes_of(points), own))
            count += len(own)
        if held and (count >= WINDOWS_TOGETHER or row == len(texts) - 1):
            for at, tags in _tagged_some(held, tagger):
                out[at] = _runs(tags)
            held, count = [], 0
    return out


def _runs(tags: np.ndarray) -> list[Span]:
    kind = (tags + 1) // 2
    begins = (tags > 0) & ((tags % 2 == 1) | np.r_[True, kind[1:] != kind[:-1]])
    ends = np.r_[(tags[:-1] > 0) & (begins[1:] | (tags[1:] == 0)), tags[-1] > 0]
    return [(int(kind[a]) - 1, int(a), int(b) + 1) for a, b in zip(np.flatnonzero(begins), np.flatnonzero(ends), strict=True)]


def all_spans(texts: list[str], tagger: Tagger) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, spans that the tagger adds) of each text; what overlaps a base span is not added."""
    out = []
    for text, tagged in zip(texts, tagged_spans(texts, tagger), strict=True):
        base = base_spans(text)
        taken = bytearray(len(text) if tagged else 0)
        for _, start, end in base if tagged else ():
            taken[start:end] = b"\1" * (end - start)
        added = [(k, s, e) for k, s, e in tagged if not any(taken[s:e]) and _plausible(k, text[s:e])]
        out.append((base, added))
    return out


def find_private_data(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """``doc_id`` and ``spans``: kind, start, end (code points, end exclusive) and whether a pattern found it.

    Spans are ordered by kind, as in ``KINDS``, then start. Null and empty texts have none. Every row of
    ``docs`` gives a row, an empty table none; further columns aren't read.
    """

    def run(batches):
        for part in slices(batches):
            rows = [[{"kind": KINDS[k], "start": s, "end": e, "base": b}
                     for k, s, e, b in sorted([*((*x, True) for x in base), *((*x, False) for x in added)])]
                    for base, added in all_spans([t or "" for t in strings(part)], tagger)]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, kind)], names=["doc_id", "spans"])

    return arrow_pass(docs, ["doc_id", "text"], run,
                      "doc_id bigint, spans array<struct<kind: string, start: bigint, end: bigint, base: boolean>>")
