from __future__ import annotations

import pytest

#: Texts that every operator has to take: null, empty, blank, repeated, odd characters, very long.
ODD_TEXTS = [None, "", " \n\t ", "one", "one two", "same text here", "same text here", "NBSP\u00a0here \u2028 and ▁ mark", "x" * 30000,
             "a b c d e " * 3000, "ñandú Ärger ﬁ ① \U0001f600 \x00 \ufffd", "  two  spaces \n\n lines\n", "A\u0301 e\u0301 İ Σ ΣΑΣ"]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with null ids, repeated rows, null columns, and columns that clash with results."""
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else "s", len(t or ""), "x", 1.5, 7) for i, t in enumerate(ODD_TEXTS)]
    rows += [(None, "same text here", None, None, None, None, None, None), (5, "same text here", "xx", "s", 14, "y", None, None)]
    return spark.createDataFrame(
        rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, Score string, kept double, component_id int")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}
