"""Sequences and bursts where one host or source has most events: spread over stretches, results as from a plain loop."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from logloom.operators import detectors, ordering

START = datetime(2025, 1, 1)


def hot_events(spark, seed, n=1500):
    rnd = random.Random(seed)
    rows = [(f"e{i:05d}", START + timedelta(seconds=rnd.randrange(4 * n) / 4), "hot" if rnd.random() < 0.7 else f"h{rnd.randrange(6)}",
             rnd.choice(["a", "b", "c", "x", "x", "x"])) for i in range(n)]
    rows += [("e99999", START, None, "a"), ("e99998", START + timedelta(seconds=1), None, "b"), ("e99997", START + timedelta(seconds=2), None, "c")]
    return rows, spark.createDataFrame(rows, "event_id string, timestamp timestamp, hostname string, kind string")


@pytest.fixture
def many_parts(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 23)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("seed", [0, 1])
def test_sequences_of_a_hot_host(spark, many_parts, seed):
    rows, df = hot_events(spark, seed)
    stages = [(k, F.col("kind") == k) for k in "abc"]
    found = {(r.hostname, tuple(r.related_events)) for r in detectors.sequences(df, stages, 40).collect()}
    want = set()
    for host in {r[2] for r in rows}:
        own = sorted((t, e, k) for e, t, h, k in rows if h == host and k != "x")
        for i, (t, e, k) in enumerate(own):
            ids, place = [e], i
            for wanted in "bc" if k == "a" else "":
                place = next((j for j in range(place + 1, len(own)) if own[j][2] == wanted), None)
                if place is None:
                    break
                ids.append(own[place][1])
            if len(ids) == 3 and (own[place][0] - t).total_seconds() <= 40:
                want.add((host, tuple(ids)))
    assert len(want) > 50 and found == want


@pytest.mark.parametrize(("gap", "seed"), [(2, 0), (30, 1)])
def test_bursts_of_a_hot_source(spark, many_parts, gap, seed):
    rows, df = hot_events(spark, seed)
    df = df.where("hostname is not null").withColumnRenamed("hostname", "source")
    threats, links = detectors.failed_burst(df, F.col("kind") != "x", gap, 3)
    found = sorted((r.source, r.session_start, r.event_count) for r in threats.collect())
    want = []
    for source in {r[2] for r in rows if r[2]}:
        session = []
        for t in [*sorted(t for _, t, h, k in rows if h == source and k != "x"), None]:
            if t is None or session and (t - session[-1]).total_seconds() >= gap:
                if len(session) >= 3:
                    want.append((source, session[0], len(session)))
                session = []
            session.append(t)
    assert found == sorted(want) and want
    assert links.count() == sum(n for _, _, n in want)


def test_a_hot_host_is_spread(spark, many_parts):
    _, df = hot_events(spark, 3)
    parts = ordering.in_stretches(df, ["hostname", "timestamp"]).groupBy("_part", "hostname").count().collect()
    assert max(r["count"] for r in parts) < 1503 / 8 and sum(r["hostname"] == "hot" for r in parts) > 10
