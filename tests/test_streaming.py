"""Streams give what the batch operators give."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from logloom.operators import detectors, stats
from logloom.plans.adapter import load_events
from logloom.plans.all_queries import QUERIES
from logloom.plans.detector_queries import SEQUENCE_LIMIT, attack_stages
from logloom.streaming import jobs
from logloom.workspace import new_path


def test_sequences(spark):
    """The batch detector's rows, most of them from the stream, the last from the closing pass."""
    tables = "/root/testdata/sf0.01"
    batch = detectors.sequences(load_events(spark, tables), attack_stages(), SEQUENCE_LIMIT)
    want = {(r.hostname, ",".join(r.related_events)) for r in batch.collect()}
    got = [(r.hostname, r.related_events) for r in QUERIES["stream_sequence"](spark, tables).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_sequences_out_of_order(spark, tmp_path):
    """Stages that arrive in the wrong order over two runs, ids with commas, and a host that goes quiet."""
    source = tmp_path / "in"
    source.mkdir()
    schema = spark.createDataFrame([], "hostname string, event_id string, timestamp timestamp, event_type string").schema
    out, state = new_path(spark, "order-out"), new_path(spark, "order-state")
    stages = [("x", F.col("event_type") == "x"), ("y", F.col("event_type") == "y")]

    def run(name, *rows):
        text = "".join('{"hostname": "%s", "event_id": "%s", "timestamp": "2025-01-01T%s:00", "event_type": "%s"}\n' % r for r in rows)
        (source / name).write_text(text)
        stream = jobs.sequences(jobs.ingest(spark, str(source), schema), stages, 3600, "1 hour")
        jobs.run_to_files(stream, out, state, rocksdb=True)
        return sorted((r.hostname, list(r.related_events)) for r in spark.read.parquet(out).collect())

    assert run("1.json", ("h", "b,1", "00:10", "y"), ("q", "c", "00:01", "x")) == []
    assert run("2.json", ("h", "a,0", "00:05", "x")) == []
    assert run("3.json", ("z", "d", "05:00", "x")) == [("h", ["a,0", "b,1"])]
    assert run("4.json", ("q", "e", "04:30", "y"), ("z", "f", "09:00", "x")) == [("h", ["a,0", "b,1"])]


class Store:
    """A map or value state that counts what is read."""

    def __init__(self):
        self.kept, self.reads = {}, 0

    def exists(self):
        return bool(self.kept)

    def getValue(self, key):
        self.reads += 1
        return self.kept[key]

    def updateValue(self, key, value):
        self.kept[key] = value

    def removeKey(self, key):
        del self.kept[key]

    def get(self):
        return self.kept[None]

    def update(self, value):
        self.kept[None] = value

    def clear(self):
        self.kept.clear()


def test_a_timer_reads_what_is_due(spark):
    """Random arrivals against a plain loop; buckets that are not due are left alone."""
    import random

    import pandas as pd

    class Handle:
        timers: list = []

        def __init__(self):
            self.stores = {}

        def getMapState(self, name, *_):
            return self.stores.setdefault(name, Store())

        getValueState = getMapState

        def registerTimer(self, at):
            self.timers.append(at)

    class Times:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = lambda: ms

    rnd = random.Random(4)
    events = sorted((rnd.randrange(4_000) * 1_000_000, f"e{i}", rnd.randrange(3)) for i in range(900))
    tracker, handle = jobs.SequenceTracker(3, 200), Handle()
    tracker.init(handle)
    found = []
    for start in range(0, 4000, 100):
        now = [e for e in events if start <= e[0] // 1_000_000 < start + 100]
        rnd.shuffle(now)
        for part in (now[::2], now[1::2]):
            list(tracker.handleInputRows(("h",), iter([pd.DataFrame(part, columns=["micros", "event_id", "stage"])]), None))
        for out in tracker.handleExpiredTimer(("h",), Times(start * 1000), None):
            found += [tuple(ids) for ids in out["related_events"]]
    for out in tracker.handleExpiredTimer(("h",), Times(4_000_000), None):
        found += [tuple(ids) for ids in out["related_events"]]
    want = []
    for i, (t, e, s) in enumerate(events):
        ids, at = [e], i
        for wanted in (1, 2) if s == 0 else ():
            at = next((j for j in range(at + 1, len(events)) if events[j][2] == wanted), None)
            if at is None:
                break
            ids.append(events[at][1])
        if len(ids) == 3 and events[at][0] - t <= 200_000_000:
            want.append(tuple(ids))
    assert len(want) > 100 and sorted(found) == sorted(want)
    # Each arrival is read once, and once more where the watermark stood inside its bucket.
    assert handle.stores["waiting"].reads < 2.5 * 40 * 2 * 9
    far = [(10_000_000_000 + i * 50_000_000, f"f{i}", 0) for i in range(200)]
    list(tracker.handleInputRows(("h",), iter([pd.DataFrame([*far, (5_000_000_000, "n", 0)], columns=["micros", "event_id", "stage"])]), None))
    handle.stores["waiting"].reads = handle.stores["runs"].reads = 0
    list(tracker.handleExpiredTimer(("h",), Times(5_000_001), None))
    assert handle.stores["waiting"].reads == 1 and handle.stores["runs"].reads == 0
    list(tracker.handleExpiredTimer(("h",), Times(9_000_000), None))
    assert not handle.stores["runs"].kept and not handle.stores["runKeys"].kept


def test_closed_windows_equal_batch(spark, small):
    events = load_events(spark, small)
    newest = events.agg(F.max("timestamp")).first()[0]
    batch = events.groupBy(F.date_trunc("hour", "timestamp").alias("bin")).agg(F.count("*").alias("n"))
    closed = batch.filter(F.col("bin") <= F.lit(newest).cast("timestamp") - F.expr("INTERVAL '2' HOUR"))
    assert QUERIES["stream_event_frequency"](spark, small).count() == closed.count()
    assert stats.event_frequency(events).agg(F.sum("n")).first()[0] == events.count()


@pytest.mark.parametrize("per_batch", [1, None])
def test_dedup_across_batches(spark, tmp_path, per_batch):
    """The same ids arrive in two files; a second run over the same checkpoint adds only new rows."""
    source = tmp_path / "in"
    source.mkdir()
    row = '{"event_id": "%s", "timestamp": "2025-01-01T00:00:0%d"}\n'
    (source / "1.json").write_text(row % ("a", 1) + row % ("b", 2))
    (source / "2.json").write_text(row % ("b", 2) + row % ("c", 3))
    schema = spark.createDataFrame([], "event_id string, timestamp timestamp").schema
    out, state = new_path(spark, "dedup-out"), new_path(spark, "dedup-state")

    def run():
        jobs.run_to_files(jobs.deduplicate(jobs.ingest(spark, str(source), schema, max_files=per_batch), "1 hour"), out, state)
        return sorted(r.event_id for r in spark.read.parquet(out).collect())

    assert run() == ["a", "b", "c"]
    (source / "3.json").write_text(row % ("c", 3) + row % ("d", 4))
    assert run() == ["a", "b", "c", "d"]


def test_late_rows_are_dropped(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    row = '{"timestamp": "2025-01-01T%02d:00:00"}\n'
    schema = spark.createDataFrame([], "timestamp timestamp").schema
    out, state = new_path(spark, "late-out"), new_path(spark, "late-state")

    def run():
        counts = jobs.event_frequency(jobs.ingest(spark, str(source), schema), "1 hour", "1 hour")
        jobs.run_to_files(counts, out, state)
        return sorted((r.bin.hour, r.n) for r in spark.read.parquet(out).collect())

    (source / "1.json").write_text(row % 1 + row % 1 + row % 10)
    assert run() == [(1, 2)]
    (source / "2.json").write_text(row % 2 + row % 20)
    assert run() == [(1, 2), (10, 1)]


def test_release_removes_what_was_written(spark):
    from pathlib import Path

    from logloom.workspace import release, shared_root, stage

    stage(spark.range(3), "probe")
    folder = Path(shared_root(spark).removeprefix("file:")) / spark.sparkContext.applicationId
    assert folder.exists()
    release(spark)
    assert not folder.exists()
