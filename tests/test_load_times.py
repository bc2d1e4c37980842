"""Times of a mixed folder are read once, before its rows are written; small listings and files are dealt evenly."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F
from test_single_pass import plan_of

from logloom.functions import times
from logloom.sources import files, units


def test_times_are_read_before_the_rows_are_written(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"event_id": "a", "timestamp": "2025-03-01T10:20:30", "odd": 1, "host": "h", "_id": "x"}\n'
                                      '{"event_id": "b", "timestamp": "soon"}\n{"event_id": "c"}\n')
    (tmp_path / "b.log").write_text("CEF:0|v|p|1|7|n|5|id=d rt=1740824430000 shost=h\nCEF:0|v|p|1|8|n|5|id=e\n")
    events, rejects = files.load_events(spark, str(tmp_path))
    for frame in (events, rejects.where("reason = 'unreadable time'")):
        assert "gettimestamp" not in plan_of(frame) and "rlike" not in plan_of(frame).lower()
    at = datetime.datetime(2025, 3, 1, 10, 20, 30)
    rows = {r.id: (r.timestamp, r.hostname, r.event_id) for r in events.withColumn(
        "id", F.coalesce(F.try_element_at("fields", F.lit("id")), "event_id")).select("id", "timestamp", "hostname", "event_id").collect()}
    assert rows["a"] == (at, "h", "a") and rows["d"][:2] == (at, "h") and rows["c"][0] is None and rows["e"][0] is None and len(rows) == 4
    assert [r.line for r in rejects.select("line").collect()] == ["soon"]
    assert events.where("event_id = 'a'").select("extra").first().extra == {"odd": "1"}


@pytest.mark.parametrize("said, want", [("2025", "2025-01-01 00:00:00"), ("1740824430\n", "2025-03-01 10:20:30"), ("174082443", None), ("17408244300", None), ("", None),
                                        ("2025-03-01", "2025-03-01 00:00:00"), ("-1740824430", None), ("٢٠٢٥", None)])
def test_digits_are_years_or_epochs(spark, said, want):
    df = spark.createDataFrame([(said,)], "t string")
    assert df.select(F.date_format(times.coerce_timestamp(F.col("t")), "yyyy-MM-dd HH:mm:ss")).first()[0] == want


def test_a_file_of_fewer_units_than_cores_is_cut_smaller(spark):
    listed = spark.createDataFrame([("/a", 64 << 20), ("/b.gz", 64 << 20)], "path string, length long")
    cut = units.units(listed)
    assert cut.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    rows = sorted((r.start, r.stop) for r in cut.where("path = '/a'").collect())
    assert len(rows) > 1 and rows[0][0] == 0 and rows[-1][1] == 64 << 20 and all(a[1] == b[0] for a, b in zip(rows, rows[1:], strict=False))
    assert [(r.start, r.stop) for r in cut.where("path = '/b.gz'").collect()] == [(0, 1 << 62)]
    big = units.units(spark.createDataFrame([("/a", 10 << 30)], "path string, length long"))
    assert big.agg(F.max(F.col("stop") - F.col("start"))).first()[0] == units.UNIT_BYTES
    assert units.units(listed.limit(0)).count() == 0


def test_heads_of_many_short_lists_share_tasks(spark, tmp_path):
    for i in range(100):
        (tmp_path / f"{i}.txt").write_text(f"{i}")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1")
    try:
        listing = files.list_files(spark, str(tmp_path))
        assert listing.rdd.getNumPartitions() == 100
        heads = files.head_sample(listing)
        assert heads.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
        assert sorted(int(r.sample) for r in heads.collect()) == list(range(100))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
