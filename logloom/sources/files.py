"""Jobs over file listings: format detection, change detection, dispatch to readers."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C
from ..functions.severity import default_severity
from ..functions.text import strip
from ..schemas import RAW_EVENT
from ..workspace import stage
from . import delimited, json_logs, line_formats, windows_xml
from .units import BATCH_PIECES, file_system, first_pieces, lines, open_file, pieces


#: Partitions of a listing whose files a task opens.
LISTS_PER_TASK = 16
#: Folders that a task lists.
FOLDERS_PER_TASK = 16


def list_files(spark: SparkSession, path) -> DataFrame:
    """(path, length, modification_time); contents are not read."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        .select("path", "length", F.col("modificationTime").alias("modification_time")))


_LISTED = "path string, folder boolean, length bigint, modification_time bigint"


def _hidden(name: str, folder: bool) -> bool:
    """Whether Spark's readers pass over a file or folder of this name."""
    unread = name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")
    return unread and not (folder and name.startswith(("_common_metadata", "_metadata")))


def _children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What lies in the folders of ``path``, in the columns of ``_LISTED``."""
    from pyarrow import fs

    schema = pa.schema({"path": pa.string(), "folder": pa.bool_(), "length": pa.int64(), "modification_time": pa.int64()})
    for batch in batches:
        for path in batch.column(0).to_pylist():
            system, inner = file_system(path)
            infos = system.get_file_info(fs.FileSelector(inner, allow_not_found=True))
            for start in range(0, len(infos), BATCH_PIECES):
                rows = [{"path": f"{path.rstrip('/')}/{x.base_name}", "folder": x.type == fs.FileType.Directory, "length": x.size or 0,
                         "modification_time": (x.mtime_ns or 0) // 1_000_000}
                        for x in infos[start:start + BATCH_PIECES] if x.type in (fs.FileType.File, fs.FileType.Directory)]
                yield pa.RecordBatch.from_pylist([r for r in rows if not _hidden(r["path"].rpartition("/")[2], r["folder"])], schema)


def list_tree(spark: SparkSession, path) -> DataFrame:
    """``list_files`` for any number of files in folders of bounded size: tasks list the folders, level by level, and write
    what they find, so that the driver holds no file name. The modification time is in milliseconds.

    A file system that only Spark reads is left to ``list_files``, and so is the error of a path that isn't there.
    """
    roots = []
    for one in [path] if isinstance(path, str) else path:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(one)
        system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found = [(str(f.getPath()), f.isDirectory(), f.getLen(), f.getModificationTime()) for f in system.globStatus(place) or ()]
        if not found or not arrow_opens(found[0][0]):
            return list_files(spark, path)
        roots += found
    level, folders, cores = spark.createDataFrame(roots, _LISTED), sum(r[1] for r in roots), spark.sparkContext.defaultParallelism
    files = level.where(~F.col("folder"))
    while folders:
        tasks = max(min(folders, cores), -(-folders // FOLDERS_PER_TASK))
        level = stage(level.where("folder").select("path").repartition(tasks).mapInArrow(_children, _LISTED), "listed")
        files = files.unionByName(level.where(~F.col("folder")))
        folders = level.where("folder").count()
    return files.drop("folder")


def arrow_opens(path: str) -> bool:
    """Whether tasks can open the path; else only Spark's readers may."""
    try:
        file_system(path)
    except (OSError, ValueError):  # another scheme, or one whose library is missing
        return False
    return True


def _heads(listing: DataFrame, render: Callable, name: str) -> DataFrame:
    """``render`` of every file, opened in the tasks; nothing is fetched but what it reads.

    Spark lists a few dozen small files per task; several such lists share a task here, as long as every core has one.
    """
    tasks = max(listing.sparkSession.sparkContext.defaultParallelism, -(-listing.rdd.getNumPartitions() // LISTS_PER_TASK))
    listing = listing.coalesce(tasks)
    schema = T.StructType([*listing.schema.fields, T.StructField(name, T.StringType())])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def head(path: str) -> str:
            with open_file(path) as handle:
                return render(handle)

        for batch in batches:
            yield batch.assign(**{name: [head(u) for u in batch["path"]]})

    return listing.mapInPandas(read, schema)


def head_sample(listing: DataFrame, chars: int = C.DETECT_SAMPLE_CHARS) -> DataFrame:
    """``sample``: the first characters of each file (a character is at most four bytes)."""
    return _heads(listing, lambda f: f.read(4 * chars).decode("utf-8", "ignore")[:chars], "sample")


def head_hash(listing: DataFrame) -> DataFrame:
    """``head_md5`` of the first megabyte."""
    return _heads(listing, lambda f: hashlib.md5(f.read(1 << 20), usedforsecurity=False).hexdigest(), "head_md5")


def classify_sample(sample: Column) -> Column:
    """Format name of a text sample.

    JSON Lines and elastic events are tested before the JSON root, which would hide them.
    """
    trimmed = F.btrim(sample, F.lit(" \t\n\r"))
    first_line = F.split_part(sample, F.lit("\n"), F.lit(1))
    lines = F.transform(F.slice(F.split(sample, "\n"), 1, 10), lambda s: F.btrim(s, F.lit(" \t\r")))
    objects = F.filter(lines, lambda s: s.startswith("{") & s.endswith("}"))
    in_object, in_array = trimmed.startswith("{"), trimmed.startswith("[")
    root = in_object | in_array

    def has(word: str, text: Column = sample) -> Column:
        return F.contains(text, F.lit(word))

    ecs = has('"@timestamp"') & (has('"event"') | has('"host"'))
    telemetry = has('"telemetry"') | has('"telemetry_events"')
    headers = F.split(F.lower(first_line), ",")
    known = F.filter(headers, lambda h: h.rlike("|".join(C.CSV_HEADER_WORDS)))
    csv = has("\n") & (F.size(headers) >= 4) & (F.size(known) >= 2)
    return (
        F.when(in_object & (F.size(objects) >= 2) & ~ecs, "jsonl")
        .when(in_object & ecs & (F.size(objects) >= 2), "jsonl")
        .when(in_object & ecs, "elastic-ecs")
        .when(in_object & telemetry, "custom-telemetry")
        .when(in_array, "json-array")
        .when(in_object & has('"events"', F.substring(sample, 1, 1000)), "json-events")
        .when(in_object, "json-object")
        .when(csv, "csv")
        .when(sample.rlike(r"(?m)^" + C.SYSLOG_START), "syslog")
        .when(has("<Event xmlns=") | has("<EventLog>"), "xml-eventlog")
        .when(telemetry, "custom-telemetry")
        .when(~root & has("\n") & (F.size(objects) >= 1), "jsonl")
        .when(ecs, "elastic-ecs")
        .when(has("LEEF:"), "leef")
        .when(has("CEF:"), "cef")
        .otherwise("unknown"))


def detect_formats(spark: SparkSession, path) -> DataFrame:
    """(path, length, format), one row per file."""
    sampled = head_sample(list_files(spark, path).select("path", "length"))
    return sampled.select("path", "length", classify_sample(F.col("sample")).alias("format"))


class Loaded(NamedTuple):
    """Rows of a reader with ``file`` and ``place``, and what it could not read: file, line, reason."""

    records: DataFrame
    rejects: DataFrame


def _rejects(rows: DataFrame, reason: str) -> DataFrame:
    return rows.select("file", "line", F.lit(reason).alias("reason"))


def _lines(parse: Callable[..., DataFrame], knows: Callable[[Column], Column], reason: str) -> Callable:
    """Reader of a line format; lines that it doesn't know are rejects, blank ones aside."""

    def read(files: DataFrame, year: int | None) -> Loaded:
        text = lines(files)
        dated = {"year": F.lit(year)} if year is not None and parse is line_formats.parse_syslog else {}
        rest = text.where(~knows(F.col("value")) & (strip(F.col("value")) != ""))
        return Loaded(parse(text, keep=("file", "place"), **dated), _rejects(rest.select("file", F.col("value").alias("line")), reason))

    return read


def _records(records: DataFrame) -> DataFrame:
    from ..operators.normalize import normalize_telemetry

    known = [*C.EVENT_ID_FALLBACKS, *(name for names in C.FIELD_SYNONYMS.values() for name in names)]
    shaped = normalize_telemetry(records.select("record", "file", "place"))
    known_names = F.array(*[F.lit(n) for n in known])
    return shaped.withColumn("extra", F.map_filter(F.from_json(F.to_json("record"), "map<string,string>"),
                                                   lambda k, v: ~F.array_contains(known_names, k) | v.rlike(r"^[\[{]"))).drop("record")


def _documents(files: DataFrame, year: int | None) -> Loaded:
    records, broken = json_logs.parse_documents(pieces(files, "}"))
    return Loaded(_records(records), broken)


def _json_lines(files: DataFrame, year: int | None) -> Loaded:
    records, broken = json_logs.parse_lines(lines(files))
    return Loaded(_records(records), _rejects(broken, "not a JSON line"))


def _csv(files: DataFrame, year: int | None) -> Loaded:
    return Loaded(*delimited.parse_csv(pieces(files, "\n"), first_pieces(files, "\n")))


def _xml(files: DataFrame, year: int | None) -> Loaded:
    events, broken = windows_xml.parse_xml_events(pieces(files, windows_xml.END_TAG).withColumn("place", F.col("at")))
    return Loaded(events, _rejects(broken, "not well-formed XML"))


# Reader per format, from a table of files (path, length) and the year to ``Loaded``; add an entry to plug in another one.
READERS: dict[str, Callable[[DataFrame, int | None], Loaded]] = {
    "json-array": _documents,
    "json-events": _documents,
    "json-object": _documents,
    "custom-telemetry": _documents,
    "elastic-ecs": _documents,
    "jsonl": _json_lines,
    "csv": _csv,
    "syslog": _lines(line_formats.parse_syslog, line_formats.is_syslog, "not a syslog line"),
    "leef": _lines(line_formats.parse_leef, line_formats.is_leef, "not a LEEF line"),
    "cef": _lines(line_formats.parse_cef, line_formats.is_cef, "not a CEF line"),
    "xml-eventlog": _xml,
}


def load_with_rejects(spark: SparkSession, path, readers=None, year: int | None = None, strict: bool = True) -> Loaded:
    """Detect the format of every file, read each with its reader, union by column name.

    The files with their formats are a table; a reader gets its part of it and cuts it into units of bytes
    (``units``), so neither the driver nor the plan knows single files. There is one read per format. Keys without a
    column of their own are in ``fields`` or ``extra``, rows that can't be read in ``rejects``. ``year`` completes
    syslog times. A file of unknown format is an error, or a reject if not ``strict``.
    """
    readers = readers or READERS
    files = stage(detect_formats(spark, path), "formats")
    formats = sorted(r["format"] for r in files.select("format").distinct().collect())
    unknown = files.where(~F.col("format").isin(*readers))
    if strict and (some := unknown.select("path").limit(5).collect()):
        raise ValueError(f"unsupported log format in {[r['path'] for r in some]}")
    if not formats:
        raise ValueError(f"no files found in {path}")
    records, rejects = None, unknown.select(F.col("path").alias("file"), F.lit(None).cast("string").alias("line"), F.lit("unknown format").alias("reason"))
    for name in [f for f in formats if f in readers]:
        own = readers[name](files.where(F.col("format") == name).select("path", "length"), year)
        frame = own.records.withColumn("format", F.lit(name))
        frame = frame.withColumns({c: F.col(c).cast("string") for c in ("timestamp", "severity") if c in frame.columns})
        records = frame if records is None else records.unionByName(frame, allowMissingColumns=True)
        rejects = rejects.unionByName(own.rejects)
    if records is None:
        raise ValueError(f"no file of a known format in {path}")
    return Loaded(records, rejects)


def load_auto(spark: SparkSession, path, readers=None, year: int | None = None) -> DataFrame:
    """The records of ``load_with_rejects``."""
    return load_with_rejects(spark, path, readers, year).records


# Where line and XML formats carry an event's time, host, user and severity, in order.
_FIELD_HOSTS, _FIELD_USERS = ("hostname", "computer", "dvchost", "shost"), ("user", "username", "usr", "usrname", "suser", "duser")
_FIELD_TIMES = ("timestamp", "time", "rt", "start", "end", "devtime", "timecreated_systemtime")
_FIELD_SEVERITIES = ("sev", "level")


def load_events(spark: SparkSession, path, year: int | None = None, strict: bool = True) -> Loaded:
    """Normalised events of a folder of any formats, and all rejects, those with unreadable times included.

    Events get ``event_id`` from their record or their place in the whole input: by time, then file and
    place in the file. Rows that carry no time keep a null timestamp and come last, in source order. The
    parsed rows are written once, since events and rejects both come from them.
    """
    from ..operators.normalize import assign_event_id

    frame, rejects = _load_timed(spark, path, year, strict)
    text = lambda name: F.col(name) if name in frame.columns else F.lit(None).cast("string")
    good = frame.where(~_unreadable()).withColumn("_late", F.col("timestamp").isNull())
    given = F.nullif(text("event_id"), F.lit(""))
    numbered = assign_event_id(good.withColumn("_given", given).drop("event_id"), ["file", "place"], first=["_late", "timestamp"])
    events = numbered.withColumn("event_id", F.coalesce("_given", "event_id")).drop("_given", "_said", "_late")
    filled = F.coalesce("severity", default_severity(F.col("event_type")))
    return Loaded(events.withColumn("severity", filled), rejects)


def load_rejects(spark: SparkSession, path, year: int | None = None, strict: bool = True) -> DataFrame:
    """The rejects of ``load_events``; no event is sorted or numbered for them."""
    return _load_timed(spark, path, year, strict)[1]


def _unreadable() -> Column:
    """Whether an event says a time that no format fits."""
    return F.col("_said").isNotNull() & F.col("timestamp").isNull()


def _load_timed(spark: SparkSession, path, year: int | None, strict: bool) -> tuple[DataFrame, DataFrame]:
    """(rows with their times, read from ``_said``; all rejects). The rows are written once."""
    from ..operators.normalize import std_columns
    from ..functions.times import coerce_timestamp

    records, rejects = load_with_rejects(spark, path, year=year, strict=strict)
    frame = std_columns(records)
    text = lambda name: F.col(name) if name in frame.columns else F.lit(None).cast("string")
    field = lambda name: F.try_element_at("fields", F.lit(name)) if "fields" in frame.columns else F.lit(None).cast("string")
    said = F.nullif(F.coalesce(text("timestamp"), text("time"), *map(field, _FIELD_TIMES)), F.lit(""))
    severity = F.coalesce(text("severity"), *map(field, _FIELD_SEVERITIES)).try_cast("int")
    if "severity_level" in frame.columns:
        severity = F.coalesce(severity, F.col("severity_level"))
    kind = F.coalesce(text("event_type"), text("type"))
    frame = frame.withColumns({
        "hostname": F.coalesce(text("hostname"), *map(field, _FIELD_HOSTS)), "username": F.coalesce(text("username"), *map(field, _FIELD_USERS)),
        "_said": said, "severity": severity, "event_type": kind})
    # Times are read before the rows are written, so that neither the sampling for the order, nor the sort, nor the rejects read them again.
    frame = stage(frame.withColumn("timestamp", coerce_timestamp(F.col("_said"))), "loaded")
    untimed = frame.where(_unreadable()).select("file", F.col("_said").alias("line"), F.lit("unreadable time").alias("reason"))
    return frame, rejects.unionByName(untimed)


def pending_inputs(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that are new or changed since the manifest was written.

    Both sides carry the same columns; with ``head_md5`` on both, the hash counts as well.
    """
    keys = ["path", "length", "modification_time"]
    if "head_md5" in listing.columns and "head_md5" in manifest.columns:
        keys.append("head_md5")
    return listing.join(manifest.select(*keys), keys, "left_anti")


__all__ = ["RAW_EVENT", "READERS", "classify_sample", "delimited", "detect_formats", "head_hash", "head_sample",
           "list_files", "list_tree", "load_auto", "load_events", "load_rejects", "load_with_rejects", "pending_inputs"]
