from __future__ import annotations

import corpus_pipeline
from llm.test_similar_texts import plain_kept

from logloom.llm import boosting, quality_rules, queries, secrets


def test_stages_one_by_one(spark, documents, small):
    docs = documents
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())

    good = corpus_pipeline.keep_good(spark, docs, small)
    trees = boosting.train(docs, queries.table(spark, small, "labels"))
    assert ids(good) == ids(boosting.score_documents(docs, trees).where("score >= 0.3")) and good.columns == docs.columns

    regular = corpus_pipeline.keep_regular(spark, good, small)
    references = quality_rules.language_references(good)
    judged = {r["doc_id"]: quality_rules.judge((r["text"] or "").encode(), r["lang"], references)[-1] for r in good.collect()}
    assert ids(regular) == sorted(d for d, kept in judged.items() if kept) and regular.columns == docs.columns

    first = corpus_pipeline.keep_first_copies(spark, regular, small)
    rows = [(r["doc_id"], r["text"]) for r in regular.collect()]
    assert ids(first) == plain_kept(rows) and first.columns == docs.columns

    masked = corpus_pipeline.mask_secrets(spark, first, small)
    assert ids(masked) == ids(first) and masked.dtypes == docs.dtypes
    forest = secrets.train()
    for r in masked.collect():
        assert r["n_chars"] == len(r["text"])
        assert not any(s >= 0.5 for _, s in secrets.judged(r["text"], r["source"], forest))

    packed = corpus_pipeline.pack(spark, masked, small).collect()
    assert {p["doc_id"] for p in packed} == set(ids(masked))
    run = corpus_pipeline.run(spark, small)
    assert run.count() == len(packed) and {r["doc_id"] for r in run.select("doc_id").distinct().collect()} == set(ids(masked))


def test_odd_documents(spark, odd, empty, small):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for name, step in corpus_pipeline.STAGES:
        assert step(spark, empty, small).count() == 0, name
        out = step(spark, docs, small)
        assert out.count() >= 0, name
        if name != "packing":
            assert out.columns == docs.columns
