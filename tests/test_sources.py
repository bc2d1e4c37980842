"""Readers on small files: one good, one bad and one edge case per format."""

from __future__ import annotations

import json
import time

import pytest
from pyspark.sql import functions as F

from logloom.schemas import strings
from logloom.sources import cutting, delimited, files, json_logs, line_formats, results, windows_xml


def lines(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "value string")


def test_syslog(spark):
    df = lines(
        spark, '  Jan  5 01:02:03 host1 sshd[7]: Failed login User="bob smith" src = "10.0.0.1" n=1',
        "Feb 10 11:12:13 h2 cron: a=1 B = x=y hostname=other a=2", "not syslog", "", "Mar 1 00:00:00 h3 app: plain words")
    rows = line_formats.parse_syslog(df, F.lit(2025)).orderBy("timestamp").collect()
    assert [r.hostname for r in rows] == ["host1", "other", "h3"]
    assert rows[0].fields == {"user": "bob smith", "src": "10.0.0.1"} and str(rows[0].timestamp) == "2025-01-05 01:02:03"
    assert rows[1].fields == {"a": "2", "b": "x=y", "hostname": "other"}
    assert (rows[2].fields, rows[2].program, rows[2].message, rows[2].event_type) == ({}, "app", "plain words", "syslog")


def test_leef(spark):
    df = lines(spark, "LEEF:2.0|V|P|1.0|42|src=1.1.1.1\tUsr=bob\tsrc=2.2.2.2", "LEEF:1.0|V|P|1.0|43", "LEEF:1.0|V|P", "x LEEF:1|a|b|c|d",
               "LEEF:1|V|P|1|44|a=1|b=2")
    rows = line_formats.parse_leef(df).orderBy("event_id").collect()
    assert [(r.event_id, r.fields) for r in rows] == [("42", {"src": "2.2.2.2", "usr": "bob"}), ("43", {}), ("44", {"a": "1|b=2"})]
    assert (rows[0].leef_version, rows[0].vendor, rows[0].event_type) == ("2.0", "V", "leef")


def test_cef(spark):
    df = lines(spark, "CEF:0|V|P|1|100|Name|High|src=1 msg=two words severity=9", "CEF:0|V|P|1|101|N|3", "CEF:0|V|P|1|102|N", "none")
    rows = line_formats.parse_cef(df).orderBy("signature_id").collect()
    assert [(r.signature_id, r.severity, r.fields) for r in rows] == [
        ("100", "9", {"src": "1", "msg": "two", "severity": "9"}), ("101", "3", {})]


EVENT = """<Event{ns}><System><Provider Name='P'/><EventID Qualifiers="3">{n}</EventID>
<Computer>c</Computer></System><EventData><Data Name="Image">a.exe</Data><Data>free</Data></EventData></Event>"""


@pytest.mark.parametrize("form", ["bare", "namespaced", "document"])
def test_windows_xml(spark, tmp_path, form):
    ns = ' xmlns="http://schemas.microsoft.com/win/2004/08/events/event"' if form == "namespaced" else ""
    body = "\n".join(EVENT.format(ns=ns, n=n) for n in (1, 2)) + "\n<Event><System><broken></Event>\n"
    if form == "document":
        body = f"<?xml version='1.0'?>\n<Events>\n{body}</Events>\n"
    (tmp_path / "a.xml").write_text(body)
    rows = windows_xml.read_windows_xml(spark, str(tmp_path)).collect()
    assert sorted(r.fields["eventid"] for r in rows) == ["1", "2"]
    assert rows[0].fields == {"provider_name": "P", "eventid": rows[0].fields["eventid"], "eventid_qualifiers": "3",
                              "computer": "c", "image": "a.exe", "data_6": "free"}


def test_json_roots(spark, tmp_path):
    rows = [{"event_id": "1", "severity": 3}, {"event_id": "2", "extra": {"a": 1}}]
    for name, value in (("array", rows), ("events", {"events": rows}), ("data", {"data": rows}), ("object", rows[0])):
        (tmp_path / f"{name}.json").write_text(json.dumps(value, indent=1))

    def ids(df):
        return sorted(r.event_id for r in df.collect())

    assert ids(json_logs.read_json_array(spark, str(tmp_path / "array.json"))) == ["1", "2"]
    assert ids(json_logs.read_json_wrapped(spark, str(tmp_path / "events.json"), "events")) == ["1", "2"]
    assert ids(json_logs.read_json_wrapped(spark, str(tmp_path / "data.json"), "data")) == ["1", "2"]
    assert ids(json_logs.read_json_object(spark, str(tmp_path / "object.json"))) == ["1"]


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text('[\n  {"event_id": "1"},\n\n{"event_id": "2"}\n{oops,\n42\n{"a": 1} tail\n]\n')
    records, rejects = json_logs.read_json_lines(spark, str(tmp_path))
    assert sorted(r.line for r in records.collect()) == ["42", '{"event_id": "1"}', '{"event_id": "2"}']
    assert sorted(r.line for r in rejects.collect()) == ['{"a": 1} tail', "{oops"]


def test_telemetry_roots(spark, tmp_path):
    for i, doc in enumerate(([{"id": 1}, {"id": 2}], {"telemetry": [{"id": 3}]}, {"telemetry_events": [{"id": 4}]}, {"events": [{"id": 5}]}, {"id": 6})):
        (tmp_path / f"{i}.json").write_text(json.dumps(doc))
    records = json_logs.read_telemetry(spark, str(tmp_path))
    assert sorted(r[0] for r in records.select(F.try_variant_get("record", "$.id", "int")).collect()) == [1, 2, 3, 4, 5, 6]


def test_flow_csv(spark, tmp_path):
    (tmp_path / "f.csv").write_text("a,b,allow\nc,d,deny\n")
    rows = delimited.read_flows(spark, str(tmp_path), F.lit("2025-01-01 00:00:00").cast("timestamp")).orderBy("event_id").collect()
    assert [(r.event_id, r.source, r.action, str(r.timestamp)) for r in rows] == [
        ("evt-1", "a", "allow", "2025-01-01 00:00:00"), ("evt-2", "c", "deny", "2025-01-01 00:00:01")]


def test_directory_of_csv_files(spark, tmp_path):
    """Columns go by name, also when files order them differently; the cap keeps the first by time."""
    (tmp_path / "a.csv").write_text("event_id,timestamp,event_type\n1,2025-01-02,x\n")
    (tmp_path / "b.csv").write_text("Timestamp,Event ID\n2025-01-01,2\n2025-01-03,3\n")
    (tmp_path / "c.txt").write_text("other")
    schema = strings("event_id", "timestamp", "event_type")
    rows = delimited.read_directory(spark, str(tmp_path), "csv", schema, max_events=2).collect()
    assert [tuple(r) for r in rows] == [("2", "2025-01-01", None), ("1", "2025-01-02", "x")]
    with pytest.raises(ValueError):
        delimited.read_directory(spark, str(tmp_path), "xml", schema)


HEADS = {
    "a.json": ('[{"a": 1}]', "json-array"),
    "b.json": ('{"events": [{"a": 1}]}', "json-events"),
    "c.json": ('{"a": 1}', "json-object"),
    "d.csv": ("timestamp,event_type,x,y\n1,2,3,4\n", "csv"),
    "e.log": ("noise\nJan  5 01:02:03 host sshd: x\n", "syslog"),
    "f.xml": ("<EventLog></EventLog>", "xml-eventlog"),
    "g.json": ('{"telemetry": []}', "custom-telemetry"),
    "h.jsonl": ('{"a": 1}\n{"a": 2}\n', "jsonl"),
    "i.json": ('{"@timestamp": "x", "host": {}}', "elastic-ecs"),
    "j.log": ("LEEF:1.0|a|b|c|d|x=1\n", "leef"),
    "k.log": ("CEF:0|a|b|c|d|e|f|x=1\n", "cef"),
    "l.txt": ("nothing here", "unknown"),
    "m.csv": ("one,two,three,four\n1,2,3,4\n", "unknown"),
}


def test_detect_formats(spark, tmp_path):
    for name, (content, _) in HEADS.items():
        (tmp_path / name).write_text(content)
    got = {r.path.rsplit("/", 1)[-1]: r["format"] for r in files.detect_formats(spark, str(tmp_path)).collect()}
    assert got == {name: kind for name, (_, kind) in HEADS.items()}
    with pytest.raises(ValueError, match="unsupported"):
        files.load_auto(spark, str(tmp_path))


def test_load_auto_mixes_formats(spark, tmp_path):
    for name in "abcdefghijk":
        for file, (content, _) in HEADS.items():
            if file.startswith(name):
                (tmp_path / file).write_text(content)
    loaded = files.load_auto(spark, str(tmp_path))
    assert {r["format"] for r in loaded.select("format").distinct().collect()} >= {"csv", "syslog", "leef", "cef", "jsonl", "json-array"}


def test_load_results_precedence(spark, tmp_path):
    def result(n):
        return json.dumps({"chunk_count": n, "identified_threats": [{"threat_id": f"t{n}"}]})

    for i in (1, 2, 10):
        (tmp_path / f"chunk_result_{i}.json").write_text(result(i))
    rows = results.result_threats(results.load_results(spark, str(tmp_path))).orderBy("source_chunk").collect()
    assert [(r.source_chunk, r.threat_id) for r in rows] == [(0, "t1"), (1, "t2"), (9, "t10")]
    (tmp_path / "analysis_results_1.json").write_text(result(20))
    time.sleep(1.1)
    (tmp_path / "analysis_results_0.json").write_text(result(21))
    assert results.load_results(spark, str(tmp_path)).first().chunk_count == 21
    (tmp_path / "aggregated_results.json").write_text(result(30))
    assert results.load_results(spark, str(tmp_path)).first().chunk_count == 30
    empty = tmp_path / "empty"
    empty.mkdir()
    with pytest.raises(FileNotFoundError):
        results.load_results(spark, str(empty))


def test_pending_inputs(spark, tmp_path):
    (tmp_path / "a").write_text("one")
    (tmp_path / "b").write_text("two")
    manifest = spark.createDataFrame(files.head_hash(files.list_files(spark, str(tmp_path))).collect())
    (tmp_path / "b").write_text("three")
    (tmp_path / "c").write_text("new")
    now = files.head_hash(files.list_files(spark, str(tmp_path)))
    assert sorted(r.path[-1] for r in files.pending_inputs(now, manifest).collect()) == ["b", "c"]


def test_unlisted_fields_survive(spark, tmp_path):
    rows = [{"event_id": "1", "custom_field": {"a": [1]}, "md5": "x"}]
    (tmp_path / "a.json").write_text(json.dumps(rows, indent=2))
    (tmp_path / "b.json").write_text(json.dumps({"data": rows}))
    for df in (json_logs.read_json_array(spark, str(tmp_path / "a.json")), json_logs.read_json_wrapped(spark, str(tmp_path / "b.json"), "data")):
        assert df.first().extra == {"custom_field": '{"a":[1]}', "md5": "x"}
    xml = '<Event><System><EventID>1</EventID><Odd A="1&lt;2">v &amp; w</Odd><Empty/></System></Event>'
    (tmp_path / "c.xml").write_text(xml)
    fields = windows_xml.read_windows_xml(spark, str(tmp_path / "c.xml")).first().fields
    assert fields == {"eventid": "1", "odd": "v & w", "odd_a": "1<2"}


def test_awkward_file_names(spark, tmp_path):
    for i, name in enumerate(("my log.log", "100%.log", "a#b.log", "x[1]{2}*.log", "q?.log")):
        (tmp_path / name).write_text(f"CEF:0|v|p|1|{i}|n|5|src={i}\n")
    assert files.head_hash(files.list_files(spark, str(tmp_path))).count() == 5
    loaded = files.load_auto(spark, str(tmp_path))
    assert sorted(r.fields["src"] for r in loaded.collect()) == ["0", "1", "2", "3", "4"]
    for i, name in enumerate(("c [1].csv", "c%20.csv")):
        (tmp_path / name).write_text(f"timestamp,event_type,hostname,user\n2025-01-01,t,h{i},u\n")
    assert sorted(r.hostname for r in delimited.read_csv_by_header(spark, str(tmp_path / "c*")).collect()) == ["h0", "h1"]


def test_long_headers_are_told_apart(spark, tmp_path):
    """Headers that agree in their first 20,000 characters, and one with a line break inside quotes."""
    wide = ",".join(f"column_{i:05d}" for i in range(1500))
    (tmp_path / "a.csv").write_text(f"{wide},first\n{',' * 1500}1\n")
    (tmp_path / "b.csv").write_text(f"{wide},second\n{',' * 1500}2\n")
    (tmp_path / "c.csv").write_text('third,"odd\nname"\n3,x\n')
    heads = {r.file[-5:]: r.header for r in cutting.csv_heads(cutting.pieces(spark, str(tmp_path), "\n")).collect()}
    assert heads["a.csv"][-1] == "first" and heads["b.csv"][-1] == "second" and heads["c.csv"] == ["third", "odd\nname"]
    rows = delimited.read_csv_by_header(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]).select("first", "second").collect()
    assert sorted((r.first or "", r.second or "") for r in rows) == [("", "2"), ("1", "")]


def test_documents_and_rejects_in_dispatch(spark, tmp_path):
    (tmp_path / "data.json").write_text(json.dumps({"data": [{"event_id": "1", "timestamp": "2025-01-01T00:00:00Z"}, {"event_id": "2", "timestamp": "2025-01-02T00:00:00Z"}]}))
    (tmp_path / "ecs.json").write_text(json.dumps({"@timestamp": "2025-01-03T00:00:00Z", "event": {"type": "t"}, "id": "3", "odd": 1}, indent=2))
    (tmp_path / "log.log").write_text("Jan  5 01:02:03 host app: id=4\nnoise\n\n")
    (tmp_path / "lines.jsonl").write_text('{"event_id": "5", "timestamp": "never"}\n{"event_id": "6"}\n{cut\n')
    (tmp_path / "x.txt").write_text("plain words")
    events, rejects = files.load_events(spark, str(tmp_path), year=2025, strict=False)
    rows = {r.event_id: r for r in events.collect()}
    assert set(rows) == {"1", "2", "3", "evt-3", "6"} and str(rows["evt-3"].timestamp) == "2025-01-05 01:02:03"
    assert rows["3"].extra["odd"] == "1" and rows["6"].timestamp is None
    assert sorted(r.reason for r in rejects.collect()) == ["not a JSON line", "not a syslog line", "unknown format", "unreadable time"]
