"""Source and sink queries. Each writes the event table in one format to the shared folder,
reads it back through the reader under test, and returns rows that SQL gets from the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import normalize
from ..operators.scoring import parse_replies
from ..schemas import strings
from ..sources import delimited, files, json_logs, line_formats, results, units, windows_xml
from ..workspace import new_path, stage
from .adapter import load_events, shape_events
from .catalog import query, stamp, stamp_sql
from .event_queries import telemetry_record
from .rule_findings import load_replies

DOCUMENT_EVENTS = 1000  # events per JSON document
INPUT_EVENTS = 100  # events per file whose change is looked for
INPUT_FILES = 1000  # such files per folder, and chunk results

_FIELDS = ["event_id", "event_type", "process_name", "hostname", "username", "source", "destination", "action"]
_FIELD_SQL = "SELECT " + ", ".join(_FIELDS) + ", '{\"k\":' || k || '}' AS unlisted FROM ev"


def _unlisted(df: DataFrame) -> DataFrame:
    """The known fields, and a nested key that the schema doesn't list."""
    return df.select(*_FIELDS, F.try_element_at("extra", F.lit("more")).alias("unlisted"))


def _write_documents(documents: DataFrame, label: str) -> str:
    """One text document per file."""
    path = new_path(documents.sparkSession, label)
    documents.select(documents.columns[0]).write.option("maxRecordsPerFile", 1).text(path)
    return path


def _arrays(spark, sf_dir, record: Column | None = None) -> DataFrame:
    """``items``: JSON array text of DOCUMENT_EVENTS events each; a document is bounded by its id range."""
    events = load_events(spark, sf_dir)
    item = record if record is not None else F.struct(*_FIELDS, F.struct("k").alias("more"))
    group = F.floor(F.col("event_no") / F.lit(DOCUMENT_EVENTS))
    return events.groupBy(group.alias("doc")).agg(F.to_json(F.collect_list(item)).alias("items"))


@query("src_json_array", _FIELD_SQL, "ev")
def src_json_array(spark, sf_dir):
    path = _write_documents(_arrays(spark, sf_dir).select("items"), "json-array")
    return _unlisted(json_logs.read_json_array(spark, path))


@query("src_json_events", _FIELD_SQL, "ev")
def src_json_events(spark, sf_dir):
    wrapped = _arrays(spark, sf_dir).select(F.concat(F.lit('{"host": "a", "events": '), "items", F.lit("}")))
    return _unlisted(json_logs.read_json_wrapped(spark, _write_documents(wrapped, "json-events"), "events"))


@query("src_json_data", _FIELD_SQL, "ev")
def src_json_data(spark, sf_dir):
    wrapped = _arrays(spark, sf_dir).select(F.concat(F.lit('{"data": '), "items", F.lit("}")))
    return _unlisted(json_logs.read_json_wrapped(spark, _write_documents(wrapped, "json-data"), "data"))


@query("src_json_object", f"""SELECT 'block-' || (event_no // {DOCUMENT_EVENTS}) AS event_id, CAST(count(*) AS VARCHAR) AS bytes, 'v' AS other
  FROM ev GROUP BY event_no // {DOCUMENT_EVENTS}""", "ev")
def src_json_object(spark, sf_dir):
    """One object per file, here the size of a block of events."""
    blocks = load_events(spark, sf_dir).groupBy(F.floor(F.col("event_no") / F.lit(DOCUMENT_EVENTS)).alias("b")).agg(
        F.count("*").alias("n"))
    text = F.to_json(F.struct(F.concat(F.lit("block-"), "b").alias("event_id"), F.col("n").alias("bytes"), F.lit("v").alias("other")))
    return json_logs.read_json_object(spark, _write_documents(blocks.select(text), "json-object")).select(
        "event_id", "bytes", F.try_element_at("extra", F.lit("other")).alias("other"))


@query("src_json_lines", """SELECT event_id, event_type, hostname, false AS rejected FROM ev WHERE k % 10 <> 3
  UNION ALL SELECT event_id, NULL, NULL, true FROM ev WHERE k % 10 = 3""", "ev")
def src_json_lines(spark, sf_dir):
    """Lines with indents, trailing commas and lone brackets; one in ten is cut off."""
    k = F.col("k") % 10
    body = F.to_json(F.struct(*_FIELDS))
    line = (
        F.when(k == 0, F.concat(F.lit("  "), body, F.lit(",  "))).when(k == 1, F.concat(body, F.lit(",")))
        .when(k == 2, F.concat(F.lit("[\n"), body, F.lit("\n]\n"))).when(k == 3, F.concat(F.lit('{"event_id": "'), "event_id", F.lit('"')))
        .otherwise(body))
    path = new_path(spark, "json-lines")
    load_events(spark, sf_dir).select(line).write.text(path)
    records, rejects = json_logs.read_json_lines(spark, path)
    good = json_logs.typed(records).select("event_id", "event_type", "hostname", F.lit(False).alias("rejected"))
    none = F.lit(None).cast("string")
    bad = rejects.select(F.regexp_extract("line", r"(evt-\d+)", 1).alias("event_id"), none.alias("event_type"),
                         none.alias("hostname"), F.lit(True).alias("rejected"))
    return good.union(bad)


@query("src_csv", """SELECT event_id, event_type, hostname, CASE WHEN k % 5 = 0 THEN command_line || chr(10) || '"x", ' || k ELSE command_line END AS command_line,
  k, round(bytes, 2) AS bytes FROM ev""", "ev")
def src_csv(spark, sf_dir):
    """One in five values has a line break, quotes and a comma."""
    path = new_path(spark, "csv")
    columns = ["event_id", "event_type", "hostname", "command_line", "k", "bytes"]
    broken = F.concat("command_line", F.lit('\n"x", '), "k")
    rows = load_events(spark, sf_dir).select(*columns).withColumn("command_line", F.when(F.col("k") % 5 == 0, broken).otherwise(F.col("command_line")))
    rows.write.option("header", True).option("escape", '"').csv(path)
    return delimited.read_csv(spark, path, rows.schema).withColumn("bytes", F.round("bytes", 2))


@query("src_flow_csv", """SELECT 'evt-' || (row_number() OVER (ORDER BY event_no)) AS event_id, source, destination, action,
  strftime(TIMESTAMP '2025-01-01 00:00:00' + to_seconds(row_number() OVER (ORDER BY event_no) - 1), '%Y-%m-%d %H:%M:%S.%f') AS timestamp_text
  FROM ev""", "ev")
def src_flow_csv(spark, sf_dir):
    """Headerless flows; range-sorted files keep the order of the event numbers."""
    path = new_path(spark, "flows")
    load_events(spark, sf_dir).repartitionByRange("event_no").sortWithinPartitions("event_no").select(
        "source", "destination", "action").write.csv(path)
    start = F.lit("2025-01-01 00:00:00").cast("timestamp")
    return delimited.read_flows(spark, path, start).select(
        "event_id", "source", "destination", "action", stamp("timestamp").alias("timestamp_text"))


@query("src_parquet", f"""SELECT event_id, {stamp_sql('"timestamp"')} AS timestamp_text, event_type, severity FROM ev""", "ev")
def src_parquet(spark, sf_dir):
    """The driver's own Parquet table through the reader, prepared column by column."""
    return shape_events(delimited.read_parquet(spark, f"{sf_dir}/events.parquet")).select(
        "event_id", stamp("timestamp").alias("timestamp_text"), "event_type", "severity")


@query("src_directory", "SELECT event_id, event_type, action AS other FROM ev", "ev")
def src_directory(spark, sf_dir):
    """All JSON files of a folder, with a key that the schema doesn't list."""
    item = F.struct("event_id", stamp("timestamp").alias("timestamp"), "event_type", F.col("action").alias("other"))
    folder = new_path(spark, "directory")
    named = _arrays(spark, sf_dir, item).select(
        F.col("items").alias("value"), F.concat(F.lit("part-"), "doc", F.lit(".json")).alias("name"))
    _write_named(named, folder)
    return delimited.read_directory(spark, folder, "json", strings("event_id", "timestamp", "event_type")).select(
        "event_id", "event_type", F.try_element_at("extra", F.lit("other")).alias("other"))


def _samples() -> list[tuple[str, Column]]:
    """A file head in every format, built from one event."""
    record = F.to_json(F.struct("event_id", "hostname"))
    at = F.date_format("timestamp", "MMM dd HH:mm:ss")

    def text(*parts) -> Column:
        return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])

    host, source = F.col("hostname"), F.col("source")
    return [
        ("json-array", text("[", record, "]")),
        ("json-events", text('{"events": [', record, "]}")),
        ("json-object", record),
        ("csv", text("timestamp,event_type,hostname,user\n", host, ",a,b,c\n")),
        ("syslog", text(at, " ", host, " sshd[1]: user=", F.col("username"), "\n")),
        ("xml-eventlog", text('<Event xmlns="http://x"><System><Computer>', host, "</Computer></System></Event>")),
        ("custom-telemetry", text('{"telemetry": [', record, "]}")),
        ("jsonl", text(record, "\n", record, "\n")),
        ("elastic-ecs", text('{"@timestamp": "x", "event": {"id": "', F.col("event_id"), '"}}')),
        ("leef", text("LEEF:1.0|V|P|1|", F.col("event_id"), "|src=", source, "\n")),
        ("cef", text("CEF:0|V|P|1|7|n|5|src=", source, "\n")),
        ("unknown", text("plain words about ", host)),
    ]


_FORMATS = ["json-array", "json-events", "json-object", "csv", "syslog", "xml-eventlog", "custom-telemetry", "jsonl",
            "elastic-ecs", "leef", "cef", "unknown"]


@query("detect_format", "SELECT (k % 12) || ' of ' || (event_no // 1000) AS name, any_value([" + ", ".join(f"'{f}'" for f in _FORMATS) +
       "][k % 12 + 1]) AS format FROM ev GROUP BY 1", "ev")
def detect_format(spark, sf_dir):
    """Files in twelve formats, one per format and thousand events, with spaces in their names."""
    samples = F.array(*[text for _, text in _samples()])
    case, block = F.col("k") % 12, F.floor(F.col("event_no") / F.lit(1000))
    named = load_events(spark, sf_dir).select(
        F.element_at(samples, case + 1).alias("value"), F.concat(case, F.lit(" of "), block).alias("name"))
    folder = new_path(spark, "formats")
    _write_named(named.groupBy("name").agg(F.min("value").alias("value")), folder)
    return files.detect_formats(spark, folder).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "format")


@query("src_telemetry", f"""SELECT CASE WHEN k % 4 = 2 THEN CAST(event_no AS VARCHAR) ELSE event_id END AS event_id, event_type, process_name,
  CASE WHEN k % 4 = 3 THEN NULL ELSE hostname END AS hostname, username, {stamp_sql('"timestamp"')} AS timestamp_text FROM ev""", "ev")
def src_telemetry(spark, sf_dir):
    """Documents with the four possible roots, holding events in four dialects."""
    lines = telemetry_record(load_events(spark, sf_dir))
    docs = lines.groupBy(F.floor(F.col("event_no") / F.lit(DOCUMENT_EVENTS)).alias("doc")).agg(
        F.concat(F.lit("["), F.array_join(F.collect_list("json"), ","), F.lit("]")).alias("items"))
    root = F.element_at(F.array(*[F.lit(w) for w in ("telemetry", "telemetry_events", "events", "")]), F.col("doc").cast("int") % 4 + 1)
    text = F.when(root == "", F.col("items")).otherwise(F.concat(F.lit('{"'), root, F.lit('": '), "items", F.lit("}")))
    records = json_logs.read_telemetry(spark, _write_documents(docs.select(text), "telemetry"))
    return normalize.normalize_telemetry(records).select(
        "event_id", "event_type", "process_name", "hostname", "username", F.col("timestamp").alias("timestamp_text"))


@query("parse_syslog", """SELECT event_id, hostname, 'app[' || k || ']' AS program, username AS user_field,
  CASE WHEN k % 3 = 0 THEN 'a b' ELSE destination END AS dst, CASE WHEN k % 3 = 2 THEN NULL ELSE action END AS action_field,
  strftime("timestamp", '%Y-%m-%d %H:%M:%S') AS second_text FROM ev""", "ev")
def parse_syslog(spark, sf_dir):
    """Quoted pairs, plain pairs, and plain pairs with spaces around the sign."""
    k = F.col("k") % 3
    head = F.concat(F.date_format("timestamp", "MMM d HH:mm:ss"), F.lit(" "), "hostname", F.lit(" app["), "k", F.lit("]: "))
    quoted = F.concat(F.lit('id="'), "event_id", F.lit('" User="'), "username", F.lit('" dst="a b" act="'), "action", F.lit('" x=1'))
    plain = F.concat(F.lit("done id="), "event_id", F.lit(" USER="), "username", F.lit(" dst="), "destination", F.lit(" act="), "action")
    spaced = F.concat(F.lit("id = "), "event_id", F.lit(" user = "), "username", F.lit(" dst = 0 dst = "), "destination")
    lines = load_events(spark, sf_dir).select(
        F.concat(F.lit("  "), head, F.when(k == 0, quoted).when(k == 1, plain).otherwise(spaced)).alias("value"))
    parsed = line_formats.parse_syslog(lines, F.lit(2024))

    def field(name):
        return F.try_element_at("fields", F.lit(name))

    return parsed.select(
        field("id").alias("event_id"), "hostname", "program", field("user").alias("user_field"), field("dst").alias("dst"),
        field("act").alias("action_field"), F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("second_text"))


@query("parse_leef", """SELECT event_id, hostname AS vendor, CASE WHEN k % 4 = 0 THEN NULL ELSE source END AS src,
  CASE WHEN k % 4 = 0 THEN NULL ELSE username END AS usr, 'leef' AS event_type FROM ev WHERE k % 4 <> 1""", "ev")
def parse_leef(spark, sf_dir):
    """Without attributes, too short to count, and with tab-separated attributes."""
    k = F.col("k") % 4
    head = F.concat(F.lit("LEEF:2.0|"), "hostname", F.lit("|agent|1|"), "event_id")
    attributes = F.concat(F.lit("|src="), "source", F.lit("\tUsr="), "username", F.lit("\tnote=a|b"))
    lines = load_events(spark, sf_dir).select(
        F.when(k == 0, head).when(k == 1, F.lit("LEEF:2.0|a|b|c")).otherwise(F.concat(head, attributes)).alias("value"))
    return line_formats.parse_leef(lines).select(
        "event_id", "vendor", F.try_element_at("fields", F.lit("src")).alias("src"),
        F.try_element_at("fields", F.lit("usr")).alias("usr"), "event_type")


@query("parse_cef", """SELECT event_id AS signature_id, action AS name, CAST(severity AS VARCHAR) AS severity, source AS src, destination AS dst
  FROM ev WHERE k % 4 <> 1""", "ev")
def parse_cef(spark, sf_dir):
    k = F.col("k") % 4
    line = F.concat(F.lit("CEF:0|vendor|product|1|"), "event_id", F.lit("|"), "action", F.lit("|"), F.col("severity"),
                    F.lit("|src="), "source", F.lit(" DST="), "destination", F.lit(" msg=one two"))
    lines = load_events(spark, sf_dir).select(F.when(k == 1, F.lit("CEF:0|vendor|product")).otherwise(line).alias("value"))
    return line_formats.parse_cef(lines).select(
        "signature_id", "name", "severity", F.try_element_at("fields", F.lit("src")).alias("src"),
        F.try_element_at("fields", F.lit("dst")).alias("dst"))


@query("src_xml_eventlog", """SELECT CAST(event_no AS VARCHAR) AS eventid, hostname AS computer, 'agent' AS provider_name, '7' AS eventid_qualifiers,
  process_name AS image, username AS data_11, action AS odd, 'a&b' AS odd_kind, 'windows_event' AS event_type FROM ev""", "ev")
def src_xml_eventlog(spark, sf_dir):
    """Namespaced events; a child of System is not in the schema, the second data element has no name."""
    text = F.concat(
        F.lit('<Event xmlns="http://schemas.microsoft.com/win/2004/08/events/event"><System><Provider Name="agent"/>'
              '<EventID Qualifiers="7">'), F.col("event_no"), F.lit("</EventID><Level>4</Level><TimeCreated SystemTime=\""),
        stamp("timestamp"), F.lit('"/><EventRecordID>1</EventRecordID><Computer>'), "hostname",
        F.lit('</Computer><Odd Kind="a&amp;b">'), "action", F.lit('</Odd></System><EventData><Data Name="Image">'), "process_name", F.lit("</Data><Data>"), "username",
        F.lit("</Data></EventData></Event>"))
    path = new_path(spark, "xml")
    load_events(spark, sf_dir).select(text).write.text(path)
    parsed = windows_xml.read_windows_xml(spark, path)
    names = ["eventid", "computer", "provider_name", "eventid_qualifiers", "image", "data_11", "odd", "odd_kind"]
    return parsed.select(*[F.try_element_at("fields", F.lit(n)).alias(n) for n in names], "event_type")


@query("load_auto", """SELECT 'cef' AS format, source AS src, NULL AS hostname FROM ev WHERE k % 3 = 0
  UNION ALL SELECT 'leef', source, NULL FROM ev WHERE k % 3 = 1
  UNION ALL SELECT 'syslog', source, hostname FROM ev WHERE k % 3 = 2""", "ev")
def load_auto(spark, sf_dir):
    """One folder with files in three formats, told apart by their first characters."""
    events, path = load_events(spark, sf_dir), new_path(spark, "mixed")
    tail = F.concat(F.lit("src="), F.col("source"))
    lines = {
        0: F.concat(F.lit("CEF:0|v|p|1|"), "event_id", F.lit("|n|5|"), tail),
        1: F.concat(F.lit("LEEF:1.0|v|p|1|"), "event_id", F.lit("|"), tail),
        2: F.concat(F.date_format("timestamp", "MMM dd HH:mm:ss"), F.lit(" "), "hostname", F.lit(" app: "), tail),
    }
    for case, line in lines.items():
        events.filter(F.col("k") % 3 == case).select(line).write.mode("append").text(path)
    loaded = files.load_auto(spark, path)
    return loaded.select("format", F.try_element_at("fields", F.lit("src")).alias("src"), "hostname")


_MIXED = ["json-array", "json-events", "json-object", "jsonl", "jsonl", "csv", "syslog", "leef", "cef", "xml-eventlog"]


def _mixed_folder(spark, sf_dir) -> str:
    """A folder of files in all formats, a tenth of the events in each; in every hundred one line or time is broken."""
    events, path = load_events(spark, sf_dir), new_path(spark, "all-formats")
    case, at = F.col("event_no") % 10, F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss")
    broken = F.col("event_no") % 100 < 10
    block = F.floor(F.col("event_no") / F.lit(DOCUMENT_EVENTS))
    flat = F.struct("event_id", at.alias("timestamp"), "event_type", "hostname", F.struct("k").alias("more"))
    ecs = F.struct(at.alias("@timestamp"), F.struct(F.col("event_type").alias("type")).alias("event"), F.col("event_id").alias("id"),
                   F.struct(F.col("hostname").alias("name")).alias("host"))
    lists = events.filter(case <= 2).groupBy(case.alias("case"), block.alias("block")).agg(
        F.to_json(F.collect_list(flat), {"pretty": "true"}).alias("items"))
    root = F.when(F.col("block") % 2 == 0, F.lit("events")).otherwise(F.lit("telemetry_events"))
    wrapped = F.when(F.col("case") == 0, F.col("items")).when(
        F.col("case") == 1, F.concat(F.lit('{"'), root, F.lit('":\n'), "items", F.lit("}"))).otherwise(
        F.concat(F.lit('{\n"data": '), "items", F.lit("}")))
    named = lists.select(wrapped.alias("value"), F.concat(F.lit("block #"), "block", F.lit(" [a] {b} 100% "), "case", F.lit(".json")).alias("name"))
    _write_named(named, path)
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    host, event, kind = F.col("hostname"), F.col("event_id"), F.col("event_type")
    lines = {
        3: F.to_json(ecs),
        4: F.when(broken, text('{"event_id": "', event)).otherwise(F.to_json(flat)),
        6: F.when(broken, text("-- mark --")).otherwise(text(
            F.date_format("timestamp", "MMM dd HH:mm:ss"), " ", host, ' app[1]: id="', event, '" kind="', kind, '"')),
        7: F.when(broken, text("LEEF:1.0|v")).otherwise(text("LEEF:1.0|v|p|1|", event, "|devTime=", at, "\tkind=", kind, "\thostname=", host)),
        8: F.when(broken, text("CEF:0|v")).otherwise(text("CEF:0|v|p|1|", event, "|n|5|id=", event, " rt=", F.unix_millis(F.col("timestamp").cast("timestamp")), " hostname=", host)),
        9: text("<Event xmlns=\"http://x\"><System><EventRecordID>", event, "</EventRecordID><TimeCreated SystemTime=\"", at, "\"/><Computer>", host,
                "</Computer>", F.when(broken, F.lit("<open>")).otherwise(F.lit("")), "</System></Event>"),
    }
    for number, line in lines.items():
        events.filter(case == number).select(line).write.mode("append").text(path)
    record = F.when(F.col("event_no") % 100 == 15, text(event, ",", at)).otherwise(
        text(event, ",", F.when(broken, F.lit("soon")).otherwise(at), ",", kind, ",", host, ',"', F.col("username"), '\n""of"" ', kind, '"'))
    sheets = events.filter(case == 5).groupBy(block.alias("block")).agg(F.array_join(F.array_sort(F.collect_list(record)), "\n").alias("rows"))
    _write_named(sheets.select(text("event_id,timestamp,event_type,hostname,username\n", F.col("rows")).alias("value"),
                               text("block ", F.col("block"), ".csv").alias("name")), path)
    return path


@query("load_events", "SELECT event_id AS id, ([" + ", ".join(f"'{f}'" for f in _MIXED) + """])[event_no % 10 + 1] AS format, hostname,
  strftime("timestamp", '%Y-%m-%d %H:%M:%S') AS second_text FROM ev WHERE event_no % 10 <= 3 OR event_no % 100 >= 10 AND event_no % 100 <> 15""", "ev")
def load_all_formats(spark, sf_dir):
    """Normalised events of a folder that mixes all formats."""
    events = files.load_events(spark, _mixed_folder(spark, sf_dir), year=2024).records
    field = lambda name: F.try_element_at("fields", F.lit(name))
    return events.select(
        F.coalesce(field("id"), field("eventrecordid"), "event_id").alias("id"),
        F.replace("format", F.lit("custom-telemetry"), F.lit("json-events")).alias("format"),
        F.coalesce("hostname", F.get_json_object(F.try_element_at("extra", F.lit("host")), "$.name")).alias("hostname"), F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("second_text"))


_REASONS = {4: "not a JSON line", 5: "unreadable time", 6: "not a syslog line", 7: "not a LEEF line", 8: "not a CEF line", 9: "not well-formed XML", 15: "2 values under 5 names"}


@query("load_rejects", "SELECT CASE event_no % 100 " + " ".join(f"WHEN {n} THEN '{r}'" for n, r in _REASONS.items()) +
       f" END AS reason, count(*) AS n FROM ev WHERE event_no % 100 IN ({', '.join(map(str, _REASONS))}) GROUP BY 1", "ev")
def load_rejects(spark, sf_dir):
    """What could not be read of the same folder, by reason."""
    rejects = files.load_rejects(spark, _mixed_folder(spark, sf_dir), year=2024)
    return rejects.groupBy("reason").agg(F.count("*").alias("n"))


def _processes(spark, sf_dir) -> DataFrame:
    """Process records with their events; one record holds one block of event numbers."""
    event = F.struct("event_type", stamp("timestamp").alias("timestamp"), F.col("action").alias("detail"))
    return load_events(spark, sf_dir).groupBy(F.floor(F.col("event_no") / 100).alias("block")).agg(
        F.min("process_name").alias("process_name"), F.collect_list(event).alias("events")).select(
        F.concat(F.lit("p-"), "block").alias("id"), "process_name", F.lit(None).cast("string").alias("start_time"),
        F.lit(None).cast("string").alias("last_update"), "events")


@query("explode_process_events", f"""SELECT 'p-' || (event_no // 100) AS id, event_type, {stamp_sql('"timestamp"')} AS timestamp_text, '' AS start_time,
  '{{"event_type":"' || event_type || '","timestamp":"' || {stamp_sql('"timestamp"')} || '","detail":"' || action || '"}}' AS event_data FROM ev""", "ev")
def explode_process_events(spark, sf_dir):
    path = new_path(spark, "processes")
    _processes(spark, sf_dir).write.json(path)
    return json_logs.read_processes(spark, path).select(
        "id", "event_type", F.col("timestamp").alias("timestamp_text"), "start_time", "event_data")


@query("sink_events_parquet", """SELECT strftime("timestamp", '%Y-%m-%d') AS day, count(*) AS n, min(event_id) AS first_id FROM ev GROUP BY 1""", "ev")
def sink_events_parquet(spark, sf_dir):
    path = new_path(spark, "events")
    results.write_events(load_events(spark, sf_dir), path, max_records=100_000)
    return delimited.read_parquet(spark, path).groupBy(F.date_format("event_date", "yyyy-MM-dd").alias("day")).agg(
        F.count("*").alias("n"), F.min("event_id").alias("first_id"))


def _chunk_results(spark, sf_dir) -> DataFrame:
    parsed = parse_replies(load_replies(spark, sf_dir))
    return parsed.select("chunk_idx", "findings.*")


@query("sink_chunk_results", """SELECT chunk_idx, coalesce(n, 0) AS threats FROM (SELECT DISTINCT chunk_idx FROM ce)
  LEFT JOIN (SELECT chunk_idx, count(*) AS n FROM raw_threats GROUP BY 1) USING (chunk_idx)""", "raw_threats", "ce")
def sink_chunk_results(spark, sf_dir):
    path = new_path(spark, "chunk-results")
    results.write_chunk_results(_chunk_results(spark, sf_dir), path)
    stored = spark.read.schema(_chunk_results(spark, sf_dir).schema).json(path)
    count = F.greatest(F.coalesce(F.size("identified_threats"), F.lit(0)), F.lit(0))
    return stored.select("chunk_idx", count.cast("long").alias("threats"))


@query("load_results", """SELECT chunk_idx AS source_chunk, threat_type, severity, count(*) AS n FROM raw_threats GROUP BY ALL""", "raw_threats")
def load_results(spark, sf_dir):
    """Chunk results stored as one file each, named by number, read back with their chunk."""
    return results.result_threats(results.load_results(spark, store_results(spark, sf_dir))).groupBy(
        "source_chunk", "threat_type", "severity").agg(F.count("*").alias("n"))


def store_results(spark, sf_dir) -> str:
    """One file per chunk result, in folders of a bounded number each, which tasks can list."""
    path = new_path(spark, "results")
    stored = _chunk_results(spark, sf_dir)
    folder = F.floor(F.col("chunk_idx") / F.lit(INPUT_FILES))
    text = stored.select(
        F.to_json(F.struct(*[c for c in stored.columns if c != "chunk_idx"])).alias("value"),
        F.concat(folder, F.lit("/chunk_result_"), F.col("chunk_idx") + 1, F.lit(".json")).alias("name"))
    _write_named(text, path)
    return path


def _write_named(text: DataFrame, folder: str) -> None:
    """One file per row under its own name, written by the tasks. A name may begin with a folder."""

    def write(batches):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder.removeprefix("file:"))
        system.create_dir(base, recursive=True)
        made = set()
        for batch in batches:
            for value, name in zip(batch["value"], batch["name"]):
                inner = name.rpartition("/")[0]
                if inner and inner not in made:
                    system.create_dir(f"{base}/{inner}", recursive=True)
                    made.add(inner)
                with system.open_output_stream(f"{base}/{name}") as out:
                    out.write(value.encode())
            yield batch[["name"]]

    text.mapInPandas(write, "name string").write.format("noop").mode("overwrite").save()


@query("pending_inputs", f"""SELECT 'block-' || (event_no // {INPUT_EVENTS}) AS block, count(*) AS events FROM ev
  GROUP BY event_no // {INPUT_EVENTS} HAVING (event_no // {INPUT_EVENTS}) % 2 = 1""", "ev")
def pending_inputs(spark, sf_dir):
    """Files of every other block are in the manifest; the rest are pending."""
    path = new_path(spark, "inputs")
    block = F.floor(F.col("event_no") / F.lit(INPUT_EVENTS))
    held = load_events(spark, sf_dir).groupBy(block.alias("block")).agg(F.concat(F.array_join(F.collect_list("event_id"), "\n"), F.lit("\n")).alias("value"))
    folder = F.floor(F.col("block") / F.lit(INPUT_FILES))
    # Events without a number share a file that belongs to no block.
    name = F.coalesce(F.concat(folder, F.lit("/block="), "block", F.lit(".csv")), F.lit("unnumbered.csv"))
    _write_named(held.select("value", name.alias("name")), path)
    listing = stage(files.head_hash(files.list_files(spark, path)), "listing")
    number = F.regexp_extract("path", r"block=(\d+)", 1).try_cast("long")
    pending = files.pending_inputs(listing, listing.filter(number % 2 == 0))
    rows = units.lines(pending.where(number.isNotNull()).select("path", "length"))
    return rows.withColumnRenamed("file", "path").groupBy(F.concat(F.lit("block-"), number).alias("block")).agg(
        F.count("*").alias("events"))
