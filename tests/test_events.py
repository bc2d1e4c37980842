"""Normalisation, text functions, order and chunks on hand-made rows."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from logloom.functions import severity, text, times
from logloom.operators import filters, normalize, ordering, stats

EVENTS = [
    ("evt-1", "2025-04-01 12:00:00", "process", "powershell.exe", "powershell.exe -encode ZQ=="),
    ("evt-2", "2025-04-01 12:01:00", "netconn", "powershell.exe", None),
    ("evt-3", "2025-04-01 12:02:00", "filemod", "powershell.exe", None),
    ("evt-4", "2025-04-01 12:03:00", "process", "suspicious.exe", "suspicious.exe /quiet"),
    ("evt-5", "2025-04-01 12:04:00", "netconn", "suspicious.exe", None),
]


@pytest.fixture
def five(spark):
    rows = spark.createDataFrame(EVENTS, "event_id string, timestamp string, event_type string, process_name string, command_line string")
    return normalize.parse_timestamps(rows)


def test_preparation_in_order(spark):
    raw = spark.createDataFrame(
        [("2025-01-01 00:00:02", "ALERT"), ("bad", "process"), ("2025-01-01T00:00:01Z", None)], "`Time` string, `Type` string")
    rows = normalize.normalize_events(raw).orderBy("timestamp").collect()
    assert [(r.event_id, r.event_type, r.severity) for r in rows] == [("evt-0", None, 1), ("evt-1", "ALERT", 8)]


def test_preparation_keeps_given_columns_and_caps_on_request(five):
    ready = normalize.normalize_events(five.withColumn("severity", F.lit(9)), max_events=2)
    assert [(r.event_id, r.severity) for r in ready.orderBy("event_id").collect()] == [("evt-1", 9), ("evt-2", 9)]


def test_numeric_times_are_nanoseconds(spark):
    row = normalize.parse_timestamps(spark.createDataFrame([(1_700_000_000_000_000_000,)], "timestamp long")).first()
    assert row.timestamp.timestamp() == 1_700_000_000


@pytest.mark.parametrize("size,overlap,chunks", [(5, 1, [5]), (3, 1, [3, 3])])
def test_chunk_golden(five, size, overlap, chunks):
    chunked = ordering.overlapping_chunks(ordering.with_ordinal(five, ["timestamp", "event_id"]), size, overlap)
    got = {r.chunk_idx: r.event_count for r in ordering.chunk_bounds(chunked).collect()}
    assert [got[i] for i in sorted(got)] == chunks


def slices(n, size, overlap):
    """Plain model: the slices of a list, stopping at the first that reaches the end."""
    if n <= size:
        return [list(range(n))]
    out = []
    for start in range(0, n, size - overlap):
        out.append(list(range(start, min(start + size, n))))
        if out[-1][-1] == n - 1:
            return out


@pytest.mark.parametrize("n,size,overlap", [(1, 50, 10), (50, 50, 10), (51, 50, 10), (90, 50, 10), (91, 50, 10), (120, 50, 10),
                                            (17, 4, 3), (30, 7, 0)])
def test_chunks_equal_slices(spark, n, size, overlap):
    ordered = spark.range(n).select(F.col("id").alias("ord"))
    got: dict[int, list[int]] = {}
    for row in ordering.overlapping_chunks(ordered, size, overlap).collect():
        got.setdefault(row.chunk_idx, []).append(row.ord)
    assert [sorted(got[i]) for i in sorted(got)] == slices(n, size, overlap)


def test_overlap_must_be_smaller(spark):
    with pytest.raises(ValueError):
        ordering.overlapping_chunks(spark.range(3).select(F.col("id").alias("ord")), 5, 5)


def test_ordinal_with_equal_times(spark):
    rows = [(random.randrange(5), f"e{i:04d}") for i in range(500)]
    df = spark.createDataFrame(rows, "t int, event_id string").repartition(7)
    got = [(r.t, r.event_id) for r in sorted(ordering.with_ordinal(df, ["t", "event_id"]).collect(), key=lambda r: r.ord)]
    assert got == sorted(rows)


def test_exact_quantile(spark):
    values = [float(v) for v in random.sample(range(1000), 101)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for q, place in ((0.0, 0), (0.5, 50), (0.99, 99), (1.0, 100)):
        assert df.limit(1).select(ordering.exact_quantile(df, "v", q)).first()[0] == sorted(values)[place]


def test_severity_scales(spark):
    df = spark.createDataFrame([("High", "warning", "7"), ("Odd", "EMERGENCY", "Medium"), (None, None, None)], "a string, b string, c string")
    rows = df.select(severity.severity_rank(F.col("a")), severity.text_severity(F.col("b")), severity.severity_num(F.col("c"))).collect()
    assert [tuple(r) for r in rows] == [(3, 2, 7.0), (0, 4, 2.0), (0, None, 1.0)]


@pytest.mark.parametrize("record,expected", [
    ({"a": {"b": 1}}, "a::b: 1"),
    ({"list": ["x", 2, None, True]}, "list: [x, 2, null, True]"),
    ({"objs": [{"k": "v"}, 3, None]}, "objs[0]::k: v, objs[1]: 3, objs[2]: null"),
    ({"n": None, "s": 'q"<&>é'}, "n: null, s: q\\\"\\u003C\\u0026\\u003E\\u00e9"),
    ({"z": {}, "e": []}, ", e: []"),
    ({"deep": [[1, 2]]}, "deep[0]: [1, 2]"),
])
def test_flatten(spark, record, expected):
    df = spark.createDataFrame([(json.dumps(record),)], "j string")
    assert df.select(text.flatten_json("j")).first()[0] == expected


def test_wrap_record(spark):
    df = spark.createDataFrame([('{"b": 1, "a": "é"}',), ("null",), ('"<x>"',), ("[1, 2]",)], "j string")
    rows = [r.w for r in df.select(text.wrap_record("j").alias("w")).collect()]
    assert rows[0].original_json == '{"b": 1, "a": "\\u00e9"}' and rows[0].flattened_data == "b: 1, a: \\u00e9"
    assert [r.raw_value for r in rows[1:]] == ["null", "\\u003Cx\\u003E", "[1, 2]"]


def test_first_sentence_and_description(spark):
    long = "x" * 120
    df = spark.createDataFrame([("Short one. Rest", "p", None), (long, None, " c "), (None, None, None)], "t string, p string, c string")
    rows = df.select(text.first_sentence(F.col("t")), text.event_description(F.col("p"), F.col("c"))).collect()
    assert [tuple(r) for r in rows] == [("Short one", "p"), ("x" * 97 + "...", "c"), (None, "")]


def test_timestamp_text(spark):
    df = spark.sql("SELECT explode(array(timestamp'2025-01-01 00:00:00', timestamp'2025-01-01 00:00:00.05')) AS t")
    assert [r[0] for r in df.select(times.timestamp_text(F.col("t"))).collect()] == ["2025-01-01 00:00:00", "2025-01-01 00:00:00.050000"]


def test_event_frequency_bins(spark):
    def bins(*stamps):
        df = spark.createDataFrame([(s,) for s in stamps], "s string").select(F.col("s").cast("timestamp").alias("timestamp"))
        return [r.n for r in stats.event_frequency(df).orderBy("bin").collect()]

    assert bins("2025-01-01 00:00:10", "2025-01-01 00:03:50") == [1, 0, 0, 1]
    assert bins("2025-01-01 00:00:10", "2025-01-01 02:00:00", "2025-01-01 02:30:00") == [1, 0, 2]
    assert bins("2025-01-01 05:00:00", "2025-01-03 06:00:00") == [1, 0, 1]
    assert bins("2025-01-01 05:00:00") == [1]


def test_noise_filter_keeps_marked_and_severe(spark):
    rows = [(f"a{i}", "x", "p", 1, None) for i in range(20)] + [("b", "y", "p", 1, None), ("c", "x", "p", 1, True), ("d", "x", "p", 5, None)]
    df = spark.createDataFrame(rows, "event_id string, event_type string, process_name string, severity int, ioc_match boolean")
    assert sorted(r.event_id for r in filters.filter_noise(df, 0.9).collect()) == ["b", "c", "d"]


def test_telemetry_scalars_only(spark):
    record = {"process": {"name": "p.exe", "pid": 4}, "host": {"name": "h"}, "event": {"type": "start"}, "severity": "odd"}
    numbered = {"id": 7, "type": "t", "process": "plain", "severity": 9}
    df = spark.createDataFrame([(json.dumps(r),) for r in (record, numbered)], "j string").select(F.try_parse_json("j").alias("record"))
    first, second = normalize.normalize_telemetry(df).collect()
    assert (first.process_name, first.process_id, first.hostname, first.event_type, first.severity_level) == ("p.exe", "4", None, "start", 1)
    assert (second.event_id, second.process_name, second.severity_level) == ("7", "plain", 9)


def test_wrap_record_never_fails(spark):
    texts = [None, "", "{broken", "[" * 100000, '{"a": [1, {"b": null}]}', "null", '"x"']
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", text.wrap_record("t").alias("w")).orderBy("i").collect()
    assert tuple(rows[0].w) == (None,) * 4
    assert [r.w.processing_error for r in rows[1:4]] == ["not valid JSON", "not valid JSON", "nested too deep"]
    assert rows[4].w.processing_error is None and rows[4].w.flattened_data.startswith("a")


def test_std_columns_merge(spark):
    df = normalize.std_columns(spark.createDataFrame([(None, 1), (2, 3)], "`Event Id` int, event_id int"))
    assert df.columns == ["event_id"] and [r.event_id for r in df.collect()] == [1, 2]


def test_event_ids_with_maps_and_without_time(spark):
    df = spark.createDataFrame([({"a": "2"},), ({"a": "1"},)], "fields map<string,string>")
    assert {r.fields["a"]: r.event_id for r in normalize.assign_event_id(df).collect()} == {"1": "evt-0", "2": "evt-1"}


@pytest.mark.parametrize("said", ["2025-03-01T10:20:30+0000", "2025-03-01 10:20:30 +0000", "01/Mar/2025:10:20:30 +0000", "Mar 1 2025 10:20:30",
                                  "1740824430", "1740824430000", "1740824430000000", "2025-03-01T10:20:30Z"])
def test_more_time_layouts(spark, said):
    row = spark.createDataFrame([(said,)], "t string").select(F.date_format(times.coerce_timestamp(F.col("t")), "yyyy-MM-dd HH:mm:ss")).first()
    assert row[0] == "2025-03-01 10:20:30"


def test_quantile_of_one_value(spark):
    df = spark.createDataFrame([(5.0,)] * 90 + [(float(i),) for i in range(10, 20)], "v double")
    for q, want in ((0.5, 5.0), (0.9, 5.0), (0.95, 14.0), (1.0, 19.0)):
        assert df.limit(1).select(ordering.exact_quantile(df, "v", q)).first()[0] == want
