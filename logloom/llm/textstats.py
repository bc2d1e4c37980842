"""Counts over the bytes, words and lines of one text, for the quality operators."""

from __future__ import annotations

from collections import Counter

import numpy as np

WHITE = np.zeros(256, bool)
WHITE[[32, *range(9, 14)]] = True
CONTINUES = (np.arange(256) & 0xC0) == 0x80

#: Character classes by first UTF-8 byte.
CLASSES = ("vowel", "consonant", "capital", "digit", "space", "line_end", "stop", "symbol", "mark", "latin", "wide", "control")


def _classes() -> np.ndarray:
    of = np.full(256, CLASSES.index("control"))
    for chars, name in (("abcdefghijklmnopqrstuvwxyz", "consonant"), ("aeiou", "vowel"), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "capital"),
                        ("0123456789", "digit"), (" \t", "space"), ("\n\r\v\f", "line_end"), (".,;:!?", "stop"), ("#*$%&|<>", "symbol"),
                        ("\"'()-/@[\\]^_`{}~+=", "mark")):
        of[[ord(c) for c in chars]] = CLASSES.index(name)
    of[128:] = CLASSES.index("wide")
    of[0xC2:0xC6] = CLASSES.index("latin")
    return of


CLASS_OF = _classes()
SYMBOLS = np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>"])


def byte_counts(text: bytes) -> np.ndarray:
    return np.bincount(np.frombuffer(text, np.uint8), minlength=256)


def class_counts(counts: np.ndarray) -> np.ndarray:
    """Characters per class; continuation bytes belong to the character before."""
    return np.bincount(CLASS_OF, weights=np.where(CONTINUES, 0, counts), minlength=len(CLASSES))


#: From so many words on, windows are compared by numbers, not by tuples, to save memory.
LONG_TEXT = 4096


def repeated_window_words(words: list[bytes], width: int = 5) -> int:
    """Words that lie in a window of ``width`` words found twice or more in the text, the first included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    if len(words) >= LONG_TEXT:
        twice = _repeated_by_number(words, width)
    else:
        windows = list(zip(*(words[i:] for i in range(width)), strict=False))
        counts = Counter(windows)
        if len(counts) == n:
            return 0
        twice = np.fromiter((counts[w] > 1 for w in windows), bool, n)
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, np.flatnonzero(twice), 1)
    np.add.at(cover, np.flatnonzero(twice) + width, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def _repeated_by_number(words: list[bytes], width: int) -> np.ndarray:
    """For each window whether it occurs again; equal windows get equal numbers, exactly, one word at a time."""
    place: dict[bytes, int] = {}
    ids = np.fromiter((place.setdefault(w, len(place)) for w in words), np.int64, len(words))
    window, n = ids, len(words) - width + 1
    for step in range(1, width):
        window = window[:len(words) - step] * len(place) + ids[step:]
        _, window = np.unique(window, return_inverse=True)
    return np.bincount(window)[window[:n]] > 1


def repeated_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word, and those among them that equal an earlier line."""
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    return len(lines), len(lines) - len(set(lines))
