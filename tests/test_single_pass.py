"""What a row costs: values that many columns share are worked out once, and the sort carries no more than its input."""

from __future__ import annotations

import contextlib
import io

from pyspark.sql import functions as F

from logloom.operators import ordering, scoring
from logloom.plans import adapter
from logloom.sources import json_logs


def plan_of(df) -> str:
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("simple")
    return text.getvalue()


def raw_events(spark, n=40):
    return spark.range(n).select(
        F.col("id").alias("event_id"), (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=n - F.floor(F.col("id") / 3))).alias("ts"),
        (F.col("id") * 7).alias("user_id"), F.element_at(F.array(*map(F.lit, ("error", "click", "view", "signup"))), (F.col("id") % 4 + 1).cast("int")).alias("event_type"),
        F.col("id").cast("double").alias("value"), F.concat(F.lit('{"k": '), F.col("id") % 90, F.lit("}")).alias("props"))


def test_shared_values_of_an_event_once(spark):
    assert plan_of(adapter.shape_events(raw_events(spark))).count("get_json_object") == 1


def test_events_are_shaped_after_the_sort(spark):
    raw = raw_events(spark)
    early = ordering.with_ordinal(adapter.shape_events(raw), ["timestamp", "event_id"])
    late = ordering.with_ordinal(raw.withColumn("_name", adapter.event_name()), ["ts", "_name"], shape=adapter.shape_events)
    assert late.columns == early.columns
    assert sorted(map(str, late.collect())) == sorted(map(str, early.collect()))


def test_a_reply_is_sliced_and_parsed_once(spark):
    replies = spark.createDataFrame(
        [(0, 'a {"identified_threats": []} b', None), (1, "none", None), (2, '{"a": ', None), (3, None, "late"), (4, "{} {}", None)],
        "chunk_idx bigint, reply string, error string")
    parsed = scoring.parse_replies(replies)
    assert parsed.columns == ["chunk_idx", "reply", "error", "parsing_error", "findings", "raw_text"]
    assert [r["parsing_error"] for r in parsed.orderBy("chunk_idx").collect()] == [
        None, "No JSON found in response", "No JSON found in response", "Processing error: late", "JSON parsing error"]
    plan = plan_of(parsed)
    assert plan.count("regexp_extract") == 1 and plan.count("AS _boxed") == 1


def test_a_record_becomes_text_once(spark):
    records = spark.createDataFrame([('{"event_id": "a", "more": {"k": 1}}',)], "text string").select(F.parse_json("text").alias("record"))
    read = json_logs.known_fields(records)
    assert [(r["event_id"], r["extra"]) for r in read.collect()] == [("a", {"more": '{"k":1}'})]
    assert plan_of(read).count("AS _text") == 1
