from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import functions as F

from logloom.llm import boosting


def test_trees_learn_and_agree_with_a_plain_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > 0)).astype(float)
    trees = boosting.fit(x[:2000], y[:2000])
    scores = trees.scores(x[2000:])
    assert ((scores > 0.5) == y[2000:]).mean() > 0.95

    def walk(row):
        raw = trees.start
        for feature, limit, leaf in zip(trees.feature, trees.limit, trees.leaf, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > limit[node] else 1)
            raw += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-raw))

    assert np.allclose([walk(r) for r in x[2000:2050]], scores[:50])


def test_held_out_accuracy(spark, documents, small):
    larger = small.replace("0.001", "0.1")
    docs, labels = (spark.read.parquet(f"{larger}/{t}.parquet") for t in ("documents", "labels"))
    trees = boosting.train(docs, labels)
    scored = boosting.score_documents(docs.select("doc_id", "text"), trees).join(labels, "doc_id").where(boosting.held_out(F.col("doc_id")))
    rows = scored.select("predicted", "quality").collect()
    assert len(rows) > 300 and np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.97
    assert sum(r["predicted"] for r in rows if r["quality"] == 1) > 0.98 * sum(r["quality"] for r in rows)


def test_held_out_follows_crc(spark):
    rows = spark.range(500).select("id", boosting.held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in rows)


def test_held_out_labels_are_not_used(spark, documents, small):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    turned = labels.withColumn("quality", F.when(boosting.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = boosting.train(documents, labels), boosting.train(documents, turned)
    assert np.array_equal(a.leaf, b.leaf) and np.array_equal(a.feature, b.feature)


def test_odd_rows(spark, odd, empty, small):
    labels = spark.createDataFrame([(1, 1, None), (None, 0, 1), (3, None, 0), (3, 0, 0), (3, 0, 0), (99, 1, 1)], "doc_id bigint, quality int, toxic int")
    trees = boosting.train(odd, labels)
    rows = boosting.score_documents(odd, trees).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert boosting.train(odd, labels.limit(0)) is None and boosting.train(empty, labels) is None
    assert {r["score"] for r in boosting.score_documents(odd, None).collect()} == {0.5}
    assert boosting.score_documents(empty, trees).count() == 0
