from __future__ import annotations

import numpy as np
import pytest

from logloom.llm import secrets

PLANTED = {'{"password": "Tr0ub4dor&3x"}': "Tr0ub4dor&3x", '{"api_key": "kJhGfDsAqWeRtYuIoPlM"}': "kJhGfDsAqWeRtYuIoPlM",
           "d['token'] = 'zXcVbNmAsDfG'": "zXcVbNmAsDfG", '"secret" :"qW#7pLz!vT2x", "user": 1': "qW#7pLz!vT2x"}


@pytest.fixture(scope="module")
def forest():
    return secrets.train()


@pytest.mark.parametrize("text", PLANTED)
def test_quoted_keys(forest, text):
    for around in (text, f"some words before {text} and words behind"):
        assert [(f.kind, f.value) for f, s in secrets.judged(around, "src1", forest) if s >= 0.5] == [("name", PLANTED[text])]


def test_quoted_ordinary_values(forest):
    for text in ('{"password": "changeme"}', '{"token": "placeholder"}', "d['secret'] = 'example'", '{"auth": "internation"}'):
        (found, score), = secrets.judged(text, "src1", forest)
        assert found.kind == "name" and score < 0.5


def test_held_out_quoted_findings(forest):
    rows = [r for r in secrets.made_up_findings(seed=77) if r[0].before.rstrip(" =:\"'").endswith(("]",)) or '": ' in r[0].before]
    scores = forest.scores(np.array([secrets.finding_features(f, p) for f, p, _ in rows]))
    labels = np.array([label for _, _, label in rows])
    assert len(rows) > 100 and ((scores >= 0.5) == labels).mean() > 0.95


def test_masked(spark, forest):
    docs = spark.createDataFrame([(i, t, "src1") for i, t in enumerate(PLANTED)], "doc_id bigint, text string, source string")
    out = {r["doc_id"]: r["text"] for r in secrets.mask_secrets(docs, forest).collect()}
    assert out == {i: t.replace(v, secrets.MASK) for i, (t, v) in enumerate(PLANTED.items())}
