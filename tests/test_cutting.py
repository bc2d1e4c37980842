"""Files cut into records over many blocks, against the json and csv modules on the whole file."""

from __future__ import annotations

import contextlib
import csv
import io
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from logloom.schemas import strings
from logloom.sources import cutting, delimited, files, json_logs


@contextlib.contextmanager
def blocks_of(spark, size):
    """Splits of so many bytes, a task for each."""
    names = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    before = {n: spark.conf.get(n, None) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    try:
        yield
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def odd_value(rng, depth=0):
    texts = ["", "a", '"', "\\", "}", "{", "[,]", 'x"},{"y', "\\\\\"", "é \U0001f600", "a\nb\tc", "}" * 5, "x" * 60]
    kind = rng.randrange(8 if depth < 3 else 4)
    if kind < 4:
        return [rng.choice(texts), rng.randrange(10 ** 6), None, True][kind]
    if kind < 6:
        return [odd_value(rng, depth + 1) for _ in range(rng.randrange(3))]
    return {rng.choice(texts) + str(i): odd_value(rng, depth + 1) for i in range(rng.randrange(4))}


def texts_of(df):
    return [r["text"] for r in sorted(df.collect(), key=lambda r: r["place"])]


@pytest.mark.parametrize(("seed", "size"), [(0, 60), (1, 300), (2, 1 << 20)])
def test_documents_over_blocks(spark, tmp_path, seed, size):
    """Quotes, escapes and brackets inside texts at every place of a block's border, in all three layouts."""
    rng = random.Random(seed)
    rows = [{"n": i, "v": odd_value(rng)} for i in range(25)]
    indent, ascii_ = rng.choice([None, 1, 3]), rng.random() < 0.5
    dump = lambda v: json.dumps(v, indent=indent, ensure_ascii=ascii_)
    before = {"a}]": ["x", {"events": [1]}], "events": {"data": [2]}, "s": '"events": ['}
    layouts = {"list": rows, "key": before | {"data": rows} | {"telemetry": [7], "z": [[1], {}]}, "object": {"one": rows, "two": {"events": []}}}
    for name, value in layouts.items():
        (tmp_path / f"{name}.json").write_text(rng.choice(["", "﻿", " \n"]) + dump(value) + rng.choice(["", "\n", " \n "]))
    with blocks_of(spark, size):
        for name, level in (("list", 1), ("key", 2), ("object", 0)):
            found = cutting.json_records(cutting.pieces(spark, str(tmp_path / f"{name}.json"), "}"))
            assert {(r["level"], r["problem"]) for r in found.collect()} == {(level, None)}
            want = [layouts["object"]] if name == "object" else rows
            assert [json.loads(t) for t in texts_of(found)] == want
        records, rejects = json_logs.read_json_documents(spark, str(tmp_path))
        assert records.count() == 51 and rejects.count() == 0


def test_many_tasks_cut_one_document(spark, tmp_path):
    rows = [{"event_id": str(i), "text": "x" * (i % 50)} for i in range(5000)]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    with blocks_of(spark, 20_000):
        df = json_logs.read_json_array(spark, str(tmp_path / "a.json"), strings("event_id", "text"))
        tasks = cutting.pieces(spark, str(tmp_path / "a.json"), "}").rdd.getNumPartitions()
        assert tasks > 10 and sorted(int(r.event_id) for r in df.collect()) == list(range(5000))


@pytest.mark.parametrize("size", [16, 1 << 20])
def test_broken_documents(spark, tmp_path, size):
    cases = {
        "elements": '[{"a": 1}, 2, "x", {"a": }, {"a" 3}, null, [{"b": 1}], {"a": 4},]',
        "cut": '{"events": [{"a": 1}, {"a": 2}, {"a": {"b": 3}',
        "cut behind": '[{"a": 1}, {"a": 2}',
        "object": '{"a": {"b": 1}',
        "text": 'no json {"a": 1}',
        "empty list": "[ ]", "empty key": '{"data": []}', "blank": "  \n",
    }
    for name, text in cases.items():
        (tmp_path / f"{name}.json").write_text(text)
    with blocks_of(spark, size):
        records, rejects = json_logs.read_json_documents(spark, str(tmp_path))
        name = F.regexp_extract(F.replace("file", F.lit("%20"), F.lit(" ")), r"([^/]+)\.json$", 1)
        good = sorted((r[0], r[1]) for r in records.select(name, F.to_json("record")).collect())
        bad = sorted((r[0], r[1], r[2]) for r in rejects.select(name, F.coalesce("line", F.lit("")), "reason").collect())
    assert good == [("cut", '{"a":1}'), ("cut", '{"a":2}'), ("cut behind", '{"a":1}'), ("elements", '{"a":1}'), ("elements", '{"a":4}')]
    ends, no = "the document ends inside the record", "not a JSON object"
    assert sorted((n, line.strip(), r) for n, line, r in bad) == sorted([
        ("blank", "", "not a JSON document"), ("cut", '{"a": {"b": 3}', ends), ("cut behind", '{"a": 2}', ends), ("object", '{"a": {"b": 1}', ends),
        ("text", "", "not a JSON document"), *[("elements", t, no) for t in ("2", '"x"', '{"a": }', '{"a" 3}', "null", '[{"b": 1}]')]])


def test_record_above_the_limit(spark, tmp_path):
    """A record too large is a reject with its beginning; its neighbours are whole."""
    rows = [{"n": 0}, {"n": 1, "t": "y" * 50_000}, {"n": 2}]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    for size in (1000, 1 << 20):
        with blocks_of(spark, size):
            records, rejects = json_logs.read_json_documents(spark, str(tmp_path / "a.json"), largest=10_000)
            assert sorted(r[0] for r in records.select(F.to_json("record")).collect()) == ['{"n":0}', '{"n":2}']
            (row,) = rejects.collect()
            assert row.reason == "record of more than 10000 bytes" and row.line.strip().startswith('{"n": 1, "t": "yyy') and len(row.line) <= 1000


@pytest.mark.parametrize(("seed", "size"), [(0, 60), (1, 300), (2, 1 << 20)])
def test_csv_over_blocks(spark, tmp_path, seed, size):
    rng = random.Random(seed)
    texts = ["", "a", 'say "x"', "two\nlines", "a,b", '",\n"', '"""', "\n\n", "x\r\ny", "é\U0001f600", "  b ", "q" * 40, "\\", "it's"]
    rows = [[str(i), *(rng.choice(texts) for _ in range(3))] for i in range(30)]
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=rng.choice(["\n", "\r\n"]))
    writer.writerow(["No", "one two", 'th"ree', "fo\nur"])
    writer.writerows(rows)
    (tmp_path / "a.csv").write_text(rng.choice(["", "﻿", "\n \n"]) + out.getvalue(), newline="")
    with blocks_of(spark, size):
        if size >= 100:
            got = delimited.read_csv_by_header(spark, str(tmp_path / "a.csv"))
            assert got.columns == ["no", "one_two", 'th"ree', "fo\nur"]
            assert {r["no"]: tuple(r) for r in got.collect()} == {r[0]: tuple(v or None for v in r) for r in rows}
        found = cutting.csv_records(cutting.pieces(spark, str(tmp_path / "a.csv"), "\n"))
        values = [r["values"] for r in sorted(found.collect(), key=lambda r: r["place"])]
        assert values[1:] == rows and {r["problem"] for r in found.collect()} == {None}


def test_quotes_inside_fields(spark, tmp_path):
    """A quote in the middle of a field is a character; text behind a closing quote belongs to the field."""
    lines = ['a,b,c', '5" disk,x"y,"z"', '"p"q,r,s', 'm,"n""\no",', ',"",""', '"un\n,\n"" closed",1,2']
    (tmp_path / "a.csv").write_text("\n".join(lines))
    with blocks_of(spark, 12):
        found = cutting.csv_records(cutting.pieces(spark, str(tmp_path / "a.csv"), "\n"))
        values = [r["values"] for r in sorted(found.collect(), key=lambda r: r["place"])]
    assert values == list(csv.reader(io.StringIO("\n".join(lines), newline="")))


def test_ragged_rows_and_open_quotes_are_rejects(spark, tmp_path):
    (tmp_path / "a.csv").write_text('timestamp,event_type,hostname,user\n2025-01-01,t,"h\n1",u\n2025-01-02,t,h2\n2025-01-03,t,h3,u,more\n2025-01-04,t,"h4,u\n2025-01-05,t,h5,u\n')
    events, rejects = files.load_events(spark, str(tmp_path))
    assert [(r.hostname, str(r.timestamp)[:10]) for r in events.collect()] == [("h\n1", "2025-01-01")]
    assert sorted((r.reason, r.line.strip()) for r in rejects.collect()) == [
        ("3 values under 4 names", "2025-01-02,t,h2"), ("5 values under 4 names", "2025-01-03,t,h3,u,more"),
        ("the last quote is never closed", '2025-01-04,t,"h4,u\n2025-01-05,t,h5,u')]
    with pytest.raises(Exception, match="more values than names|never closed"):
        delimited.read_csv_by_header(spark, str(tmp_path / "a.csv")).collect()
    (tmp_path / "b.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="expected"):
        delimited.read_csv(spark, str(tmp_path / "b.csv"), strings("a", "c"))


def test_odd_quote_in_a_long_file_is_linear(spark, tmp_path):
    body = "a,b\n" + '1,"odd\n' + "xxxx,yyyy\n" * 400_000
    (tmp_path / "a.csv").write_text(body)
    batch_rows = cutting.csv_heads(cutting.pieces(spark, str(tmp_path / "a.csv"), "\n"))
    batch_rows.collect()
    start = time.time()
    rows = cutting.csv_records(cutting.pieces(spark, str(tmp_path / "a.csv"), "\n")).select("problem", F.length("text").alias("n")).collect()
    assert [(r.problem, r.n) for r in rows if r.problem] == [("the last quote is never closed", cutting.SHOWN)] and time.time() - start < 20


def test_files_with_other_columns_make_one_plan(spark, tmp_path):
    for i in range(30):
        (tmp_path / f"{i:02d}.csv").write_text(f"event_id,c{i},C {i}\n{i},,v{i}\n{i},w{i},\n")
    df = delimited.read_csv_by_header(spark, str(tmp_path / "*.csv"))
    assert len(df.columns) == 61
    got = {r["event_id"]: r for r in df.collect() if r[f"c{r['event_id']}"]}
    assert len(got) == 30 and all(r[f"c{i}"] == f"w{i}" for i, r in got.items()) and all(r[f"c{(int(i) + 1) % 30}"] is None for i, r in got.items())
    assert df._jdf.queryExecution().analyzed().toString().count("Relation [") <= 5
