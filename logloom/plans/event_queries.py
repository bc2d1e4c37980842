"""Queries over the event table: normalisation, filters, statistics, order and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import severity as sev
from ..functions import text
from ..operators import filters, normalize, ordering, stats
from .adapter import load_events
from .catalog import query, stamp, stamp_sql
from .rule_findings import chunked_events

TS = stamp_sql('"timestamp"')


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


# --- normalisation ---------------------------------------------------------------------


@query("std_columns", "SELECT event_id AS event_number, event_type AS type, user_id AS user_number FROM events")
def std_columns(spark, sf_dir):
    raw = _raw(spark, sf_dir).select(
        F.col("event_id").alias("Event Number"), F.col("event_type").alias("TYPE"), F.col("user_id").alias("User Number"))
    return normalize.std_columns(raw)


@query("require_columns", f"SELECT event_id, {stamp_sql('ts')} AS timestamp_text, event_type FROM events")
def require_columns(spark, sf_dir):
    raw = _raw(spark, sf_dir).select("event_id", F.col("ts").alias("time"), F.col("event_type").alias("type"))
    return normalize.require_columns(raw).select("event_id", stamp("timestamp").alias("timestamp_text"), "event_type")


@query("coerce_timestamp", f"""SELECT event_id, {TS} AS timestamp_text FROM ev WHERE k % 5 <> 4""", "ev")
def coerce_timestamp(spark, sf_dir):
    """Times written in four layouts, and in the fifth case as a text that is no time."""
    at, k = F.col("timestamp"), F.col("k") % 5
    written = (
        F.when(k == 0, stamp(at)).when(k == 1, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
        .when(k == 2, F.concat(stamp(at), F.lit("+00:00"))).when(k == 3, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
        .otherwise(F.concat(F.lit("not a time "), F.col("k"))))
    raw = load_events(spark, sf_dir).select("event_id", written.alias("timestamp"))
    return normalize.parse_timestamps(raw).select("event_id", stamp("timestamp").alias("timestamp_text"))


@query("default_severity", "SELECT event_id, event_type, severity FROM ev", "ev")
def default_severity(spark, sf_dir):
    raw = load_events(spark, sf_dir).select("event_id", "event_type")
    return normalize.add_default_severity(raw)


@query("assign_event_id", f"""SELECT 'evt-' || (row_number() OVER (ORDER BY ts, event_id) - 1) AS event_id,
  {stamp_sql('ts')} AS timestamp_text, event_id AS source_number FROM events""")
def assign_event_id(spark, sf_dir):
    raw = _raw(spark, sf_dir).select(F.col("ts").alias("timestamp"), F.col("event_id").alias("source_number"))
    return normalize.assign_event_id(raw).select("event_id", stamp("timestamp").alias("timestamp_text"), "source_number")


def telemetry_record(events: DataFrame) -> DataFrame:
    """Events as JSON text in four telemetry dialects."""
    k = F.col("k") % 4
    words = F.element_at(F.array(*[F.lit(w) for w in ("info", "Warning", "HIGH", "critical", "odd")]), F.col("k") % 5 + 1)
    at = stamp("timestamp")
    plain = F.to_json(F.struct(
        "event_id", at.alias("timestamp"), "event_type", "process_name", "hostname", "username", "severity"))
    vendor = F.to_json(F.struct(
        F.col("event_id").alias("id"), at.alias("event_time"), F.col("event_type").alias("eventType"),
        F.col("process_name").alias("ImageName"), F.col("hostname").alias("Computer"), F.col("username").alias("UserName"),
        words.alias("alert_severity")))
    windows = F.to_json(F.struct(
        F.col("event_no").alias("EventID"), at.alias("timeGenerated"), F.col("event_type").alias("category"),
        F.col("process_name").alias("ProcessName"), F.col("hostname").alias("device_name"), F.col("username").alias("User"),
        words.alias("Severity")))
    nested = F.to_json(F.struct(
        F.col("event_id").alias("_id"), at.alias("@timestamp"), F.struct(F.col("event_type").alias("type")).alias("event"),
        F.struct(F.col("process_name").alias("name"), F.col("event_no").alias("pid")).alias("process"),
        F.struct(F.col("hostname").alias("name")).alias("host"), F.col("username").alias("user"),
        F.col("k").alias("severity_level")))
    return events.select("event_no", F.when(k == 0, plain).when(k == 1, vendor).when(k == 2, windows).otherwise(nested).alias("json"))


_WORDS = "CASE k % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 ELSE 1 END"


def _telemetry(spark, sf_dir) -> DataFrame:
    return telemetry_record(load_events(spark, sf_dir)).select("event_no", F.try_parse_json("json").alias("record"))


@query("unify_fields", f"""SELECT event_no, {TS} AS timestamp_text, CASE WHEN k % 4 = 3 THEN NULL ELSE event_type END AS event_type,
  CASE WHEN k % 4 = 3 THEN NULL ELSE process_name END AS process_name,
  CASE WHEN k % 4 = 3 THEN NULL ELSE hostname END AS hostname, username FROM ev""", "ev")
def unify_fields(spark, sf_dir):
    """Nested process and host objects are not names, so those fields stay empty here."""
    fields = normalize.unify_fields(F.col("record"))
    return _telemetry(spark, sf_dir).select(
        "event_no", fields["timestamp"].alias("timestamp_text"), *[fields[c].alias(c) for c in
        ("event_type", "process_name", "hostname", "username")])


@query("fallback_event_id", """SELECT event_no, CASE WHEN k % 4 = 2 THEN CAST(event_no AS VARCHAR) ELSE event_id END AS event_id
  FROM ev""", "ev")
def fallback_event_id(spark, sf_dir):
    return _telemetry(spark, sf_dir).select("event_no", normalize.fallback_event_id(F.col("record")).alias("event_id"))


@query("lift_nested", """SELECT event_no, event_type, process_name,
  CASE WHEN k % 4 = 3 THEN CAST(event_no AS VARCHAR) END AS process_id FROM ev""", "ev")
def lift_nested(spark, sf_dir):
    record = F.col("record")
    fields = normalize.lift_nested(record, normalize.unify_fields(record))
    return _telemetry(spark, sf_dir).select("event_no", *[fields[c].alias(c) for c in ("event_type", "process_name", "process_id")])


@query("text_severity", f"""SELECT event_no, CASE k % 4 WHEN 0 THEN severity WHEN 3 THEN k ELSE {_WORDS} END AS severity_level
  FROM ev""", "ev")
def text_severity(spark, sf_dir):
    """Words by table; numbers, in the first and last dialect, untouched."""
    return normalize.normalize_telemetry(_telemetry(spark, sf_dir)).select("event_no", "severity_level")


@query("stringify_complex", """SELECT event_id, '{"name":"' || process_name || '","level":' || k || '}' AS process,
  '[{"to":"' || destination || '"}]' AS flows, hostname || ',' || username AS tags FROM ev""", "ev")
def stringify_complex(spark, sf_dir):
    nested = load_events(spark, sf_dir).select(
        "event_id", F.struct(F.col("process_name").alias("name"), F.col("k").alias("level")).alias("process"),
        F.array(F.struct(F.col("destination").alias("to"))).alias("flows"), F.array("hostname", "username").alias("tags"))
    return text.stringify_complex(nested).withColumn("tags", F.array_join("tags", ","))


def _nested_json(spark, sf_dir) -> DataFrame:
    record = F.struct(
        F.col("event_id").alias("id"), F.struct("hostname", F.struct("username", "k").alias("actor")).alias("a<b"),
        F.array("source", "destination").alias("flow"),
        F.array(F.struct(F.col("event_type").alias("type")), F.struct(F.col("action").alias("type"))).alias("steps"),
        F.lit(True).alias("ok"))
    return load_events(spark, sf_dir).select("event_id", "k", F.to_json(record).alias("json"))


_FLAT = r"""'id: ' || event_id || ', a' || chr(92) || 'u003Cb::hostname: ' || hostname || ', a' || chr(92) || 'u003Cb::actor::username: ' || username ||
  ', a' || chr(92) || 'u003Cb::actor::k: ' || k || ', flow: [' || source || ', ' || destination || '], steps[0]::type: ' || event_type ||
  ', steps[1]::type: ' || action || ', ok: True'"""


@query("flatten_json", f"SELECT event_id, {_FLAT} AS flattened FROM ev", "ev")
def flatten_json(spark, sf_dir):
    return _nested_json(spark, sf_dir).select("event_id", text.flatten_json("json").alias("flattened"))


@query("wrap_record", f"""SELECT event_id, CASE WHEN k % 10 >= 5 THEN {_FLAT} WHEN k % 10 = 3 THEN 'Error processing: not valid JSON'
    WHEN k % 10 = 4 THEN 'Error processing: nested too deep' END AS flattened_data,
  CASE k % 10 WHEN 3 THEN 'not valid JSON' WHEN 4 THEN 'nested too deep' END AS processing_error,
  CASE WHEN k % 10 = 3 THEN 5 WHEN k % 10 = 4 THEN 200000 WHEN k % 10 >= 5 THEN length(event_id) + length(hostname) + length(username) + length(CAST(k AS VARCHAR))
    + length(source) + length(destination) + length(event_type) + length(action) + 138 END AS original_length,
  CASE k % 10 WHEN 0 THEN 'null' WHEN 1 THEN 'x\\u0026y' END AS raw_value FROM ev""", "ev")
def wrap_record(spark, sf_dir):
    """Objects; in five of ten cases a JSON null, a plain text, no text, a broken text, or far too many brackets."""
    k = F.col("k") % 10
    raw = _nested_json(spark, sf_dir).withColumn(
        "json", F.when(k == 0, F.lit("null")).when(k == 1, F.lit('"x&y"')).when(k == 2, None).when(k == 3, F.lit('{"a":'))
        .when(k == 4, F.repeat(F.lit("["), 200000)).otherwise(F.col("json")))
    return text.wrap_records(raw, "json").select("event_id", "w.flattened_data", "w.processing_error", F.length("w.original_json").cast("long").alias("original_length"),
        "w.raw_value")


@query("escape_text", r"""SELECT doc_id, md5(replace(replace(replace(array_to_string(list_transform(
    string_split(replace(replace(replace(replace(replace(replace(replace(text, '\', '\\'), '"', '\"'),
      chr(10), '\n'), chr(13), '\r'), chr(9), '\t'), chr(8), '\b'), chr(12), '\f'), ''),
    lambda c: array_to_string(list_transform(string_split(c, ''), lambda g:
      CASE WHEN unicode(g) > 65535 THEN '\u' || lpad(lower(to_hex(55296 + ((unicode(g) - 65536) >> 10))), 4, '0')
          || '\u' || lpad(lower(to_hex(56320 + ((unicode(g) - 65536) & 1023))), 4, '0')
        WHEN unicode(g) > 127 OR unicode(g) < 32 THEN '\u' || lpad(lower(to_hex(unicode(g))), 4, '0') ELSE g END), '')), ''),
    '<', chr(92) || 'u003C'), '>', chr(92) || 'u003E'), '&', chr(92) || 'u0026')) AS escaped_md5 FROM documents""")
def escape_text(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return docs.select("doc_id", F.md5(text.escape_text(F.col("text"))).alias("escaped_md5"))


@query("event_description", """SELECT event_id, trim(process_name || ' ' || coalesce(command_line, '')) AS description
  FROM ev""", "ev")
def event_description(spark, sf_dir):
    return load_events(spark, sf_dir).select(
        "event_id", text.event_description(F.col("process_name"), F.col("command_line")).alias("description"))


@query("first_sentence", """SELECT doc_id, CASE WHEN length(s) > 100 THEN left(s, 97) || '...' ELSE s END AS sentence
  FROM (SELECT doc_id, split_part(text, '.', 1) AS s FROM documents)""")
def first_sentence(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", text.first_sentence(F.col("text")).alias("sentence"))


@query("severity_rank", """SELECT event_id, CASE k % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS rank FROM ev""", "ev")
def severity_rank(spark, sf_dir):
    label = F.element_at(F.array(*[F.lit(w) for w in ("High", "Medium", "Low", "Critical")]), F.col("k") % 4 + 1)
    return load_events(spark, sf_dir).select("event_id", sev.severity_rank(label).alias("rank"))


@query("severity_num", """SELECT event_id, CAST(CASE k % 4 WHEN 0 THEN 3 WHEN 1 THEN k WHEN 2 THEN 1 ELSE 1 END AS DOUBLE)
  AS severity_num FROM ev""", "ev")
def severity_num(spark, sf_dir):
    k = F.col("k")
    value = F.when(k % 4 == 0, "High").when(k % 4 == 1, k.cast("string")).when(k % 4 == 2, "Low").otherwise("other")
    return load_events(spark, sf_dir).select("event_id", sev.severity_num(value).alias("severity_num"))


# --- filters ---------------------------------------------------------------------------


@query("filter_time_window", f"""SELECT event_id, {TS} AS timestamp_text FROM ev
  WHERE "timestamp" BETWEEN (SELECT max("timestamp") FROM ev) - INTERVAL 168 HOUR AND (SELECT max("timestamp") FROM ev)""", "ev")
def filter_time_window(spark, sf_dir):
    """The last week before the newest event."""
    raw = _raw(spark, sf_dir)
    recent = filters.time_window(raw, raw.agg(F.max("ts")).scalar(), 168, "ts")
    return recent.select(F.concat(F.lit("evt-"), "event_id").alias("event_id"), stamp("ts").alias("timestamp_text"))


@query("filter_severity_threshold", "SELECT event_id, event_type, severity FROM ev WHERE severity >= 4", "ev")
def filter_severity_threshold(spark, sf_dir):
    return filters.severity_threshold(load_events(spark, sf_dir).select("event_id", "event_type", "severity"), 4)


@query("filter_noise", """, freq AS (SELECT event_type, process_name, count(*) AS n FROM ev GROUP BY ALL),
  cut AS (SELECT quantile_disc(n, 0.75) AS q FROM freq)
  SELECT ev.event_id FROM ev JOIN freq USING (event_type, process_name) WHERE NOT (severity <= 3
    AND destination NOT LIKE '203.%' AND n >= (SELECT q FROM cut))""", "ev")
def filter_noise(spark, sf_dir):
    """Severity 3 counts as low here, and an outside destination as an indicator mark."""
    events = load_events(spark, sf_dir).withColumn("ioc_match", F.col("destination").startswith("203."))
    return filters.filter_noise(events, 0.75, max_severity=3).select("event_id")


# --- statistics ------------------------------------------------------------------------


@query("event_frequency", f""", span AS (SELECT min("timestamp") AS lo, max("timestamp") AS hi FROM ev),
  bins AS (SELECT unnest(generate_series(date_trunc('day', lo), date_trunc('day', hi), INTERVAL 1 DAY)) AS bin FROM span)
  SELECT {stamp_sql('bin')} AS bin_text, coalesce(n, 0) AS n FROM bins
  LEFT JOIN (SELECT date_trunc('day', "timestamp") AS bin, count(*) AS n FROM ev GROUP BY 1) USING (bin)""", "ev")
def event_frequency(spark, sf_dir):
    return stats.event_frequency(load_events(spark, sf_dir)).select(stamp("bin").alias("bin_text"), "n")


@query("event_type_distribution", "SELECT event_type, count(*) AS n FROM ev GROUP BY event_type", "ev")
def event_type_distribution(spark, sf_dir):
    return stats.event_type_distribution(load_events(spark, sf_dir))


# --- order, limits, chunks -------------------------------------------------------------


@query("event_ordinal", f"SELECT event_id, ord, {TS} AS timestamp_text FROM ordered", "ordered")
def event_ordinal(spark, sf_dir):
    ordered = ordering.with_ordinal(load_events(spark, sf_dir).select("timestamp", "event_id"), ["timestamp", "event_id"])
    return ordered.select("event_id", F.col("ord").cast("long").alias("ord"), stamp("timestamp").alias("timestamp_text"))


@query("sort_by_time", f"SELECT event_id, {TS} AS timestamp_text FROM ev", "ev")
def sort_by_time(spark, sf_dir):
    return normalize.sort_by_time(load_events(spark, sf_dir).select("event_id", "timestamp")).select(
        "event_id", stamp("timestamp").alias("timestamp_text"))


@query("limit_max_events", """SELECT event_id, event_type FROM ev ORDER BY "timestamp", event_id LIMIT 1000""", "ev")
def limit_max_events(spark, sf_dir):
    """The event cap of the default run: a top-k report."""
    return normalize.limit_events(load_events(spark, sf_dir), 1000).select("event_id", "event_type")


@query("overlapping_chunks", "SELECT chunk_idx, ord, event_id FROM ce", "ce")
def overlapping_chunks(spark, sf_dir):
    return chunked_events(spark, sf_dir).select("chunk_idx", F.col("ord").cast("long").alias("ord"), "event_id")


@query("chunk_bounds", """SELECT chunk_idx, count(*) AS event_count, strftime(min("timestamp"), '%Y-%m-%d %H:%M:%S.%f') AS start_text,
  strftime(max("timestamp"), '%Y-%m-%d %H:%M:%S.%f') AS end_text, min(ord) AS start_index, max(ord) AS end_index
  FROM ce GROUP BY chunk_idx""", "ce")
def chunk_bounds(spark, sf_dir):
    return ordering.chunk_bounds(chunked_events(spark, sf_dir)).select(
        "chunk_idx", "event_count", stamp("start_time").alias("start_text"), stamp("end_time").alias("end_text"),
        F.col("start_index").cast("long").alias("start_index"), F.col("end_index").cast("long").alias("end_index"))


@query("union_sources", """SELECT event_id, hostname, CAST(NULL AS VARCHAR) AS destination FROM ev WHERE event_type <> 'netconn'
  UNION ALL SELECT event_id, NULL, destination FROM ev WHERE event_type = 'netconn'""", "ev")
def union_sources(spark, sf_dir):
    events = load_events(spark, sf_dir)
    network = events.filter(F.col("event_type") == "netconn").select("event_id", "destination")
    return normalize.union_sources(events.filter(F.col("event_type") != "netconn").select("event_id", "hostname"), network)

