"""A telemetry record is parsed once, and its fields come from one pass over its keys."""

from __future__ import annotations

from pyspark.sql import functions as F
from test_single_pass import plan_of

from logloom.operators import normalize
from logloom.sources import json_logs

_TEXTS = ['{"event_id": "a", "severity": "High", "process": {"name": "p", "pid": 3}, "event": {"type": "t"}, "user": "{odd"}',
          '{"id": 1.50, "severity": null, "alert_severity": "low", "host": ["x"], "user": "[a]", "time": 1e3}',
          '{"EventID": true, "Severity": 3, "event_type": "", "category": "c", "host": {}}', "[1]", "null", "{}",
          '{"process": "", "process.name": "[x]", "pid": "{}", "_id": 0.1e-7, "event.type": [1], "event": {"type": {"a": 1}}}']


def test_a_record_is_parsed_once(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"telemetry": [{"id": 1}, {"id": 2}, 3, {"id"}]}')
    (tmp_path / "b.jsonl").write_text('{"id": 1}\n{"id"\n')
    records, rejects = json_logs.read_json_documents(spark, str(tmp_path / "a.json"))
    assert plan_of(records).count("parseJson(") == 2  # whole records and joined fragments
    assert records.count() == 2 and rejects.count() == 2
    lines, broken = json_logs.read_json_lines(spark, str(tmp_path / "b.jsonl"))
    assert plan_of(lines).count("parseJson(") == 1
    assert lines.count() == 1 and broken.count() == 1


def test_fields_from_one_pass_are_those_of_every_path(spark):
    rows = spark.createDataFrame(list(enumerate(_TEXTS)), "n int, text string").select("n", F.try_parse_json("text").alias("record"))
    record, texts = F.col("record"), F.col("texts")

    def fields(source, texts):
        found = {**normalize.unify_fields(source, texts), "event_id": normalize.fallback_event_id(source, texts)}
        return [value.alias(name) for name, value in found.items()]

    each = rows.select("n", *fields(record, None)).orderBy("n").collect()
    at_once = rows.withColumn("texts", normalize.scalar_texts(record)).select("n", *fields(record, texts)).orderBy("n").collect()
    assert at_once == each and each[0].username == "{odd" and each[0].process_name is None
    assert plan_of(normalize.normalize_telemetry(rows)).count("variant_get") < 40
