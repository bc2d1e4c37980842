"""Stored results are listed and read by tasks, with the rows that Spark's reader of whole files gives."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from test_lazy_findings import _events

from logloom.plans import evaluation_queries
from logloom.schemas import RESULT
from logloom.sources import files, results

ODD = {
    "one": b'{"chunk_count": 1, "identified_threats": [{"threat_id": "a", "related_events": ["x"]}]}', "array": b'[{"chunk_count": 1}, {"chunk_count": 2}]',
    "with_null": b'[null, {"chunk_count": 2}]', "with_number": b'[1, {"chunk_count": 2}]', "nested": b'[[{"chunk_count": 1}]]', "no_rows": b" []",
    "bare": b"{}", "empty": b"", "blank": b" \n\t ", "broken": b'{"chunk_count": 1, ', "broken_late": b'{"chunk_count": 1, "limitations": ["a", }',
    "broken_array": b'[{"chunk_count": 1}, {"chunk_count":', "text": b"hello", "number": b"3", "null": b"null", "after": b'{"chunk_count": 1} xyz',
    "two": b'{"chunk_count": 1}\n{"chunk_count": 2}', "kind": b'{"chunk_count": "x", "limitations": ["a"]}', "kind_inside": b'[{"chunk_count": "x", "limitations": ["q"]}, {"chunk_count": 2}]',
    "kind_threat": b'{"identified_threats": [{"threat_id": "a"}, 5], "chunk_count": 3}', "mark": b'\xef\xbb\xbf{"chunk_count": 1}', "mark_only": b"\xef\xbb\xbf",
    "utf16": '{"chunk_count": 16, "limitations": ["é"]}'.encode("utf-16"), "utf16be": b'\x00{\x00}', "utf32": '{"chunk_count": 32}'.encode("utf-32"),
    "bytes": b'{"limitations": ["a\xff"], "chunk_count": 4}', "big": b'{"chunk_count": 99999999999999999999, "limitations": ["z"]}', "line": b'\n\n {"chunk_count": 1}',
}


def _rows(df, *columns):
    return sorted(json.dumps(r.asDict(True), sort_keys=True) for r in df.select(*columns).collect())


@pytest.mark.parametrize("columns", [RESULT.names, ["chunk_count"], ["identified_threats"]])
def test_odd_documents_as_spark_reads_them(spark, tmp_path, columns):
    for n, name in enumerate(ODD):
        (tmp_path / f"{n % 3}").mkdir(exist_ok=True)
        (tmp_path / f"{n % 3}" / f"chunk_result_{name}_{n + 1}.json").write_bytes(ODD[name])
    read = spark.read.schema(RESULT).option("multiLine", True).option("recursiveFileLookup", True).json(str(tmp_path))
    number = F.regexp_extract("_metadata.file_name", r"_(\d+)\.json$", 1).cast("long") - 1
    expected = _rows(read.withColumn("source_chunk", number), "source_chunk", *columns)
    assert _rows(results.load_results(spark, str(tmp_path)), "source_chunk", *columns) == expected


def test_driver_knows_no_chunk_file(spark, tmp_path):
    for n in range(5):
        (tmp_path / f"{n // 2}").mkdir(exist_ok=True)
        (tmp_path / f"{n // 2}" / f"chunk_result_{n + 1}.json").write_text('{"chunk_count": 1}')
    loaded = results.load_results(spark, str(tmp_path))
    assert sorted(r.source_chunk for r in loaded.select("source_chunk").collect()) == list(range(5))
    assert not [f for f in loaded.inputFiles() if "chunk_result" in f]


def test_tree_is_what_spark_lists(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "FOLDERS_PER_TASK", 2)
    for name in ("a.json", "b c%20.json", "_hidden.json", "_d=1.json", ".dot", "_metadata", "x._COPYING_", "in/f", "in/deep/er/g", "_skip/h", "_metadata_2/h", ".skip/h", "_k=1/h", "é/i"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    (tmp_path / "empty").mkdir()
    (tmp_path / "lost").symlink_to(tmp_path / "nowhere")
    (tmp_path / "link").symlink_to(tmp_path / "in")
    for path in (str(tmp_path), f"file://{tmp_path}/", f"{tmp_path}/i*", f"{tmp_path}/a.json", [f"{tmp_path}/in", f"{tmp_path}/é"]):
        millis = F.unix_millis("modification_time").alias("modification_time")
        assert _rows(files.list_tree(spark, path), "path", "length", "modification_time") == _rows(files.list_files(spark, path), "path", "length", millis)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.list_tree(spark, str(tmp_path / "nothing"))


def test_file_system_that_only_spark_reads(spark, tmp_path):
    (tmp_path / "0").mkdir()
    for n in range(3):
        (tmp_path / "0" / f"chunk_result_{n + 1}.json").write_text('{"chunk_count": %d}' % n)
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.results.link./in", f"file://{tmp_path}")
    loaded = results.load_results(spark, "viewfs://results/in")
    assert sorted((r.source_chunk, r.chunk_count) for r in loaded.collect()) == [(0, 0), (1, 1), (2, 2)]


def test_evaluation_lists_no_file_on_the_driver(spark, tmp_path, monkeypatch):
    def fails(*_):
        raise AssertionError("the driver lists files")

    for module in (files, results):
        monkeypatch.setattr(module, "list_files", fails, raising=False)
    report = evaluation_queries.evaluate_results(spark, _events(spark, tmp_path / "e"))
    assert {r.area for r in report.collect()} == {"overall", "context_window", "probabilistic_correlation", "memory", "accuracy"}
