"""Incremental jobs. All state lives in the checkpoint folder given by the caller."""

from __future__ import annotations

import threading
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.detectors import sequences as sequences_of

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
# Sessions of a busy key are merged inside the map tasks before the shuffle.
LOCAL_MERGE = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


_starting = threading.Lock()


def run_to_files(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", rocksdb: bool = False) -> None:
    """Process everything available, exactly once, then stop.

    ``rocksdb`` picks that state store for this run: custom state needs it, and big windows
    profit from it because their state leaves the heap.
    """
    spark = stream.sparkSession
    wanted = {LOCAL_MERGE: "true", **({PROVIDER: ROCKSDB} if rocksdb else {})}
    with _starting:  # a started query has settings of its own, so runs side by side don't meet
        before = {key: spark.conf.get(key, None) for key in wanted}
        for key, value in wanted.items():
            spark.conf.set(key, value)
        try:
            query = (
                stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint)
                .trigger(availableNow=True).start(path))
        finally:
            for key, value in before.items():
                if value is None:
                    spark.conf.unset(key)
                else:
                    spark.conf.set(key, value)
    query.awaitTermination()


def ingest(spark: SparkSession, folder: str, schema: T.StructType, fmt: str = "json", glob: str | None = None,
           max_files: int | None = None) -> DataFrame:
    """New files of a folder as a stream."""
    reader = spark.readStream.format(fmt).schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(folder)


def event_frequency(events: DataFrame, width: str, delay: str) -> DataFrame:
    """Counts per window; rows later than ``delay`` are dropped."""
    return (
        events.withWatermark("timestamp", delay).groupBy(F.window("timestamp", width)).agg(F.count("*").alias("n"))
        .select(F.col("window.start").alias("bin"), "n"))


def deduplicate(events: DataFrame, delay: str) -> DataFrame:
    """Drop repeated event ids (chunk overlap repeats them) within the watermark."""
    return events.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(["event_id"])


def scanning(events: DataFrame, width: str, minimum: int, delay: str) -> DataFrame:
    """Sources that meet many destinations in one window.

    Two chained aggregations: one row per (window, source, destination) first, then a count
    per source, so one busy source is shared by many tasks.
    """
    per_destination = (
        events.withWatermark("timestamp", delay)
        .groupBy(F.window("timestamp", width), "source", "destination").agg(F.count("*").alias("n")))
    total = per_destination.groupBy(F.window("window", width), "source").agg(
        F.count("*").alias("distinct_count"), F.sum("n").alias("event_count"))
    return total.filter(F.col("distinct_count") >= minimum).select(
        "source", F.col("window.start").alias("slot"), "distinct_count", "event_count")


def failed_bursts(events: DataFrame, failed: Column, gap: str, minimum: int, delay: str) -> DataFrame:
    """Sessions of failures per source."""
    return (
        events.filter(failed).withWatermark("timestamp", delay)
        .groupBy("source", F.session_window("timestamp", gap)).agg(F.count("*").alias("event_count"))
        .filter(F.col("event_count") >= minimum)
        .select("source", F.col("session_window.start").alias("session_start"), "event_count"))


SEQUENCE_OUT = T.StructType([
    T.StructField("hostname", T.StringType()),
    T.StructField("started", T.TimestampType()),
    T.StructField("finished", T.TimestampType()),
    T.StructField("related_events", T.ArrayType(T.StringType())),
])


class SequenceTracker(StatefulProcessor):
    """Open runs of ordered stages on one host, advanced in event time.

    Rows wait until the watermark has passed them, so late and shuffled arrivals within the delay give what
    the batch detector gives. A timer wakes the host for its next waiting row, and once more when its oldest
    run can't be completed any longer, so an idle host leaves no state behind.

    State is kept by time bucket, a ``PARTS``-th of the limit: waiting rows under (bucket, number of arrival), open runs
    under (stage they wait for, bucket of their start). Two small lists say which keys there are. A timer reads and
    deletes the waiting buckets that are due, reads the runs that wait for a stage which occurs among them, all
    of which advance, and drops buckets of runs that have expired unread. What is not due is not touched.
    """

    PARTS = 16

    def __init__(self, stages: int, limit_seconds: int):
        self.stages = stages
        self.limit = limit_seconds * 1_000_000
        self.width = max(1, self.limit // self.PARTS)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "bucket bigint, arrival bigint", "micros array<bigint>, ids array<string>, stages array<int>")
        self.waiting_keys = handle.getValueState("waitingKeys", "buckets array<bigint>, arrivals array<bigint>, firsts array<bigint>, next bigint")
        self.runs = handle.getMapState("runs", "stage int, bucket bigint", "started array<bigint>, ids array<string>")
        self.run_keys = handle.getValueState("runKeys", "stages array<int>, buckets array<bigint>")

    def _known_waiting(self) -> tuple[list[tuple[int, int, int]], int]:
        """(bucket, arrival, first time) of what waits, and the number of the next arrival."""
        if not self.waiting_keys.exists():
            return [], 0
        buckets, arrivals, firsts, following = self.waiting_keys.get()
        return [(int(b), int(a), int(f)) for b, a, f in zip(buckets, arrivals, firsts, strict=True)], int(following)

    def _wait(self, known: list[tuple[int, int, int]], arrival: int, rows: list[tuple[int, str, int]]) -> None:
        for bucket, group in groupby(sorted(rows), key=lambda r: r[0] // self.width):
            own = list(group)
            self.waiting.updateValue((bucket, arrival), tuple(map(list, zip(*own, strict=True))))
            known.append((bucket, arrival, own[0][0]))
        if known:
            buckets, arrivals, firsts = map(list, zip(*known, strict=True))
            self.waiting_keys.update((buckets, arrivals, firsts, arrival + 1))
        else:
            self.waiting_keys.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrived = [(int(m), str(e), int(s)) for batch in rows for m, e, s in zip(batch["micros"], batch["event_id"], batch["stage"])]
        if arrived:
            self._wait(*self._known_waiting(), arrived)
            self.handle.registerTimer(min(arrived)[0] // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        known, arrival = self._known_waiting()
        due, rest = [], []
        for bucket, number, first in known:
            if first < passed:
                due += [(int(m), str(e), int(s)) for m, e, s in zip(*self.waiting.getValue((bucket, number)), strict=True)]
                self.waiting.removeKey((bucket, number))
            else:
                rest.append((bucket, number, first))
        late = [r for r in due if r[0] >= passed]
        self._wait(rest, arrival, late)
        done = self._advance(sorted(r for r in due if r[0] < passed), passed)
        wake = [first for _, _, first in rest]
        # A bucket's runs are told apart when it is read; the timer waits for the last that may be in it.
        wake += [(bucket + 1) * self.width + self.limit for _, bucket in self._run_keys()]
        if wake:
            self.handle.registerTimer(max(min(wake), passed) // 1000 + 1)
        if done:
            out = pd.DataFrame([(key[0], *d) for d in done], columns=["hostname", "started", "finished", "related_events"])
            for column in ("started", "finished"):
                out[column] = pd.to_datetime(out[column], unit="us", utc=True)
            yield out

    def _run_keys(self) -> set[tuple[int, int]]:
        if not self.run_keys.exists():
            return set()
        stages, buckets = self.run_keys.get()
        return {(int(s), int(b)) for s, b in zip(stages, buckets, strict=True)}

    def _advance(self, due: list[tuple[int, str, int]], passed: int) -> list[tuple[int, int, list[str]]]:
        """Finished runs (start, end, ids) after the due events, in their order."""
        keys = self._run_keys()
        opened: dict[int, list[tuple[int, list[str]]]] = {}
        done, before = [], set(keys)

        def waiting_for(stage: int) -> list[tuple[int, list[str]]]:
            """Runs that wait for ``stage``; read from the state once, and taken from it."""
            if stage not in opened:
                opened[stage] = []
                for own in sorted(k for k in keys if k[0] == stage):
                    started, ids = self.runs.getValue(own)
                    ids = [str(i) for i in ids]
                    opened[stage] += [(int(t), ids[n * stage:(n + 1) * stage]) for n, t in enumerate(started)]
                    self.runs.removeKey(own)
                    keys.discard(own)
            return opened[stage]

        for micros, event, stage in due:
            if stage == 0:
                waiting_for(1).append((micros, [event]))
                continue
            ready, opened[stage] = waiting_for(stage), []
            for started, ids in ready:
                if micros - started > self.limit:
                    continue
                if stage + 1 == self.stages:
                    done.append((started, micros, [*ids, event]))
                else:
                    waiting_for(stage + 1).append((started, [*ids, event]))
        for stage, bucket in [k for k in keys if (k[1] + 1) * self.width + self.limit <= passed]:
            self.runs.removeKey((stage, bucket))
            keys.discard((stage, bucket))
        for stage, runs in opened.items():
            alive = sorted((t, ids) for t, ids in runs if t + self.limit >= passed)
            for bucket, group in groupby(alive, key=lambda r: r[0] // self.width):
                own = list(group)
                self.runs.updateValue((stage, bucket), ([t for t, _ in own], [i for _, ids in own for i in ids]))
                keys.add((stage, bucket))
        if keys:
            stages, buckets = zip(*sorted(keys), strict=True)
            self.run_keys.update((list(stages), list(buckets)))
        elif before:
            self.run_keys.clear()
        return done

    def close(self) -> None:
        pass


def sequences(events: DataFrame, stages: list[tuple[str, Column]], limit_seconds: int, delay: str) -> DataFrame:
    """Ordered stages per host with state; a run is emitted once the watermark has passed its last event."""
    stage_of = F.coalesce(*[F.when(test, F.lit(i)) for i, (_, test) in enumerate(stages)])
    staged = (
        events.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
        .select("hostname", "event_id", "timestamp", F.unix_micros("timestamp").alias("micros"), stage_of.alias("stage"))
        .filter(F.col("stage").isNotNull()).withWatermark("timestamp", delay))
    return staged.groupBy("hostname").transformWithStateInPandas(
        statefulProcessor=SequenceTracker(len(stages), limit_seconds), outputStructType=SEQUENCE_OUT,
        outputMode="Append", timeMode="EventTime")


def finish_sequences(emitted: DataFrame, events: DataFrame, stages: list[tuple[str, Column]], limit_seconds: int, delay: str) -> DataFrame:
    """Runs of a stream that has ended which its last watermark had not passed: hostname and related_events.

    ``events`` are all that the stream was given, ``emitted`` what it returned. Only the last ``limit_seconds`` and
    ``delay`` of them are looked at again, by the batch detector.
    """
    newest = events.agg(F.max("timestamp").cast("timestamp")).scalar()
    open_since = newest - F.expr(f"INTERVAL {delay}") - F.make_dt_interval(secs=F.lit(2 * limit_seconds))
    tail = sequences_of(events.where(F.col("timestamp").cast("timestamp") >= open_since), stages, limit_seconds)
    return tail.select("hostname", "related_events").join(emitted.select("hostname", "related_events"), ["hostname", "related_events"], "left_anti")


__all__ = ["run_to_files", "ingest", "event_frequency", "deduplicate", "scanning", "failed_bursts", "sequences", "finish_sequences"]
