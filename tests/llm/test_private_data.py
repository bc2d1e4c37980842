from __future__ import annotations

import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from logloom.llm import private_data as pd


def plain_spans(text):
    """The patterns as written, with the standard matcher."""
    found = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()]
        total = sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d)))
        if 16 <= len(d) <= 19 and total % 10 == 0:
            found.append((2, *m.span()))
    return found + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="a1.@+-() 0259%_é\n", max_size=60))
def test_base_spans_follow_the_patterns(text):
    assert pd.base_spans(text) == plain_spans(text)


def test_base_spans_of_long_runs():
    text = "a" * 50000 + " " + "1" * 20000 + " " + "1." * 9000 + " x@" * 5000 + " +1" + " " * 9000
    assert pd.base_spans(text) is not None
    card = "4111 1111-1111 1111"
    assert pd.base_spans(card) == plain_spans(card) and pd.base_spans(card)[0][0] == 2


def test_documents_have_the_base_spans(texts):
    for text in texts.values():
        assert pd.base_spans(text or "") == plain_spans(text or "")


@pytest.fixture(scope="module")
def tagger(documents):
    return pd.train(documents)


def test_gradients():
    tagger, rng = pd.Tagger(), np.random.default_rng(0)
    tagger.p = {k: v.astype(float) for k, v in tagger.p.items()}
    ids, tags = rng.integers(0, pd.CLASSES, (9, 3)), np.zeros((9, 3), int)
    tags[2:5, 0], tags[0:3, 1] = [1, 2, 2], [3, 4, 4]
    _, grad = tagger.gradients(ids, tags)
    for name, g in grad.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        tagger.p[name][at] += 1e-3
        up = tagger.gradients(ids, tags)[0]
        tagger.p[name][at] -= 2e-3
        down = tagger.gradients(ids, tags)[0]
        tagger.p[name][at] += 1e-3
        assert abs((up - down) / 2e-3 - g[at]) < 1e-3 * max(1, abs(g[at])) + 2e-3, name


def test_decode_is_the_best_path(tagger):
    """Against all paths of a short window, scored one by one."""
    ids = np.random.default_rng(1).integers(0, pd.CLASSES, (1, 4))
    emissions = tagger._emissions(np.ascontiguousarray(ids.T))[0][:, 0]
    trans = tagger.p["trans"] + pd._allowed()
    first = tagger.p["first"] + pd._allowed()[0]
    paths = np.stack(np.meshgrid(*[np.arange(pd.TAGS)] * 4, indexing="ij"), -1).reshape(-1, 4)
    scores = first[paths[:, 0]] + sum(emissions[t][paths[:, t]] for t in range(4)) + sum(trans[paths[:, t - 1], paths[:, t]] for t in range(1, 4))
    assert paths[scores.argmax()].tolist() == tagger.decode(ids)[0].tolist()


def test_stretches_of_one_window_are_decoded_like_windows(tagger):
    """Paths of stretches of several lengths at once, against each window alone and against one long path."""
    rng = np.random.default_rng(3)
    ids = rng.integers(0, pd.CLASSES, (40, pd.WINDOW))
    emissions = tagger._emissions(np.ascontiguousarray(ids.T))[0].transpose(1, 0, 2)
    lengths = rng.integers(1, pd.WINDOW + 1, 40)
    bases = np.cumsum(lengths) - lengths
    flat = np.concatenate([e[:n] for e, n in zip(emissions, lengths, strict=True)])
    tags = pd._best_paths(flat, bases, lengths, tagger)
    trans, first = tagger.p["trans"] + pd._allowed(), tagger.p["first"] + pd._allowed()[0]

    def value(e, path):
        return first[path[0]] + e[np.arange(len(path)), path].sum() + trans[path[:-1], path[1:]].sum()

    for e, n, b, own in zip(emissions, lengths, bases, ids, strict=True):
        path = tags[b:b + n]
        if n == pd.WINDOW:
            assert path.tolist() == tagger.decode(own[None])[0].tolist()
        score, best = first + e[0], None
        for t in range(1, n):
            score = (score[:, None] + trans).max(axis=0) + e[t]
        best = score.max()
        assert abs(value(e[:n], path) - best) < 1e-2


@pytest.mark.parametrize(("body", "value"), [("call (555) 123-4567 now", "(555) 123-4567"), ("write to anna . berg @ mail . example . com now", None),
                                             ("from 12[.]34[.]56[.]78 on", "12[.]34[.]56[.]78")])
def test_added_spans_at_every_shift(tagger, body, value):
    """Wherever the windows' borders fall in a text, the same span is added, whole."""
    filler = "er in the and on ared thion of anest whe rinte to ander thes is and at ored es the " * 5
    found = []
    for shift in range(0, 2 * pd.WINDOW, 3):
        text = filler[:shift] + " " + body + " " + filler[:100]
        found.append(tuple(text[s:e] for _, s, e in pd.all_spans([text], tagger)[0][1]))
    common = max(set(found), key=found.count)
    assert value is None or common == (value,)
    assert found.count(common) > 0.97 * len(found)


def test_many_texts_together_change_nothing(tagger, texts, monkeypatch):
    some = [t or "" for t in list(texts.values())[:40]]
    together = pd.tagged_spans(some, tagger)
    monkeypatch.setattr(pd, "WINDOWS_TOGETHER", 1)
    assert sum(a != b for a, b in zip(together, pd.tagged_spans(some, tagger), strict=True)) == 0


def test_held_out_spans(tagger, texts):
    """Spans of spellings and texts that training did not see."""
    windows = sorted({t[max(0, m.start() - 48):m.start() + 48] for t in texts.values() if t and (m := re.search("[0-9@]", t))})
    right = total = extra = 0
    for text, spans in pd.labelled_examples(windows * 3, seed=1234):
        found = set(pd.tagged_spans([text], tagger)[0])
        right, total, extra = right + len(found & set(spans)), total + len(spans), extra + len(found - set(spans))
    assert right > 0.8 * total and extra < 0.2 * total


def test_spans_across_windows(tagger):
    """What a span is found as doesn't depend on where the windows lie."""
    body = "write to abc.12@mail3.example.com or call +1 (555) 555-0123 now"
    for shift in range(0, 200, 7):
        text = "word " * (shift // 5) + "x" * (shift % 5) + " " + body
        assert len(pd.base_spans(text)) == 2
        tagged = [text[s:e] for k, s, e in pd.tagged_spans([text], tagger)[0] if k == 0]
        assert any("abc.12@mail3.example.com" in t or t in "abc.12@mail3.example.com" for t in tagged)


def test_added_spans_do_not_touch_base_spans(tagger, texts):
    for base, added in pd.all_spans([t or "" for t in texts.values()], tagger):
        assert not any(s < e2 and e > s2 for _, s, e in added for _, s2, e2 in base)
    found = [a for _, a in pd.all_spans(["er in the (555) 123-4567 on ared", "thion of 12[.]34[.]56[.]78 anest"], tagger)]
    assert sum(map(len, found)) >= 1


def test_odd_rows(odd, empty, tagger):
    rows = pd.find_private_data(odd, tagger).collect()
    assert len(rows) == odd.count() and all(r["spans"] == [] for r in rows)
    assert pd.find_private_data(empty, tagger).count() == 0
    assert pd.train(empty) is not None
