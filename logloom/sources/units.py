"""Files read by units: rows (path, start, stop) of a table, dealt to tasks by size, so the driver holds no file name.

A unit owns the pieces of text that start in its bytes, as Spark's own text splits do, and reads on to the end of its
last one. Files come from a listing of any number of rows, which may have been filtered or joined before.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a unit, its bytes where there are fewer units than cores, and at most so many units for a task.
UNIT_BYTES, LEAST_UNIT_BYTES, UNITS_PER_TASK = 64 << 20, 4 << 20, 512
#: Bytes read at a time, and pieces of an Arrow batch.
READ_BYTES, BATCH_PIECES = 4 << 20, 8192
CODECS = {"gz": "gzip", "bz2": "bz2", "zst": "zstd", "lz4": "lz4"}


def file_system(path: str):
    """Arrow's file system of a listed path, and the path inside it, whatever characters its name has."""
    from urllib.parse import quote

    from pyarrow import fs

    scheme, colon, rest = path.partition(":")
    if not colon or scheme == "file":
        return fs.LocalFileSystem(), "/" + (rest or path).lstrip("/")
    return fs.FileSystem.from_uri(quote(re.sub("^s3a:", "s3:", path), safe=":/"))


def open_file(path: str):
    """A listed path as an input stream; known codecs are undone."""
    system, inner = file_system(path)
    handle = system.open_input_file(inner)
    codec = CODECS.get(path.rsplit(".", 1)[-1])
    return handle if codec is None else pa.CompressedInputStream(handle, codec)


def documents(files: DataFrame) -> DataFrame:
    """``path`` and ``text`` of the files of ``files`` (path, length), each read whole by a task, hundreds of small ones by one.

    The encoding (UTF-8, UTF-16 or UTF-32) is told as JSON readers do; ``text`` is null if the file isn't text in it.
    """
    size = files.select(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.count("*").alias("files")).first()
    cores = files.sparkSession.sparkContext.defaultParallelism
    tasks = max(-(-size["bytes"] // UNIT_BYTES), -(-size["files"] // UNITS_PER_TASK), min(size["files"], cores), 1)

    def text(path: str) -> str | None:
        with open_file(path) as handle:
            raw = handle.read()
        try:
            # A byte order mark and nothing else is no text.
            return raw.decode(json.detect_encoding(raw)) or (None if raw else "")
        except UnicodeDecodeError:
            return None

    def run(batches):
        for batch in batches:
            paths, texts, held = [], [], 0
            for path in batch.column(0).to_pylist():
                paths.append(path)
                texts.append(text(path))
                held += len(texts[-1] or "")
                if len(paths) >= BATCH_PIECES or held >= READ_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(texts, pa.string())], names=["path", "text"])
                    paths, texts, held = [], [], 0
            if paths:
                yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(texts, pa.string())], names=["path", "text"])

    return files.select("path").repartition(tasks).mapInArrow(run, "path string, text string")


def units(files: DataFrame, unit_bytes: int | None = None) -> DataFrame:
    """``path``, ``bytes`` (of the file), ``start`` and ``stop`` of the units of ``files`` (path, length).

    A compressed file is one unit. There is about one task per ``UNIT_BYTES``, or per ``UNITS_PER_TASK`` small files. Where
    that makes fewer tasks than cores, units are smaller, as with Spark's own splits.
    """
    size = files.select(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.count("*").alias("files")).first()
    if unit_bytes is None:
        share = -(-size["bytes"] // files.sparkSession.sparkContext.defaultParallelism)
        unit_bytes = min(UNIT_BYTES, max(LEAST_UNIT_BYTES, share))
    packed = F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*CODECS)
    last = F.when(packed, F.lit(0)).otherwise(F.floor(F.greatest(F.col("length") - 1, F.lit(0)) / unit_bytes))
    cut = files.select("path", F.col("length").alias("bytes"), packed.alias("packed"), F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("n"))
    start = F.col("n") * unit_bytes
    cut = cut.select("path", "bytes", start.alias("start"), F.when(F.col("packed"), F.lit(1 << 62)).otherwise(
        F.least(start + unit_bytes, F.col("bytes"))).alias("stop"))
    tasks = -(-size["bytes"] // unit_bytes) + -(-size["files"] // UNITS_PER_TASK)
    return cut.repartition(max(1, tasks))


def _pieces_from(handle, start: int, stop: int, separator: bytes) -> Iterator[tuple[int, bytes]]:
    """(first byte, piece) of the pieces that start in [start, stop); every one but a file's last ended with the separator.

    The separator must not overlap itself. A piece is held in memory.
    """
    at = 0
    if start:
        # A piece starts at ``start`` if the separator ends there.
        at = max(0, start - len(separator))
        handle.seek(at)
    held, skipping, ended = b"", bool(start), False
    while not ended:
        more = handle.read(READ_BYTES)
        ended = not more
        held += more
        *whole, rest = held.split(separator)
        for piece in whole:
            if skipping:
                skipping = False
            elif at >= stop:
                return
            else:
                yield at, piece
            at += len(piece) + len(separator)
        held = rest
        if not skipping and at >= stop:
            return
    if held and not skipping:
        yield at, held


def pieces(files: DataFrame, separator: str, unit_bytes: int | None = None) -> DataFrame:
    """The pieces of text of ``files`` (path, length), see ``_read``."""
    return _read(units(files, unit_bytes), separator)


def first_pieces(files: DataFrame, separator: str, first_bytes: int = 1 << 20) -> DataFrame:
    """Those that start in the first bytes of each file, which is all that is read."""
    heads = files.select("path", F.col("length").alias("bytes"), F.lit(0).cast("long").alias("start"), F.lit(first_bytes).cast("long").alias("stop"))
    return _read(heads, separator)


def _read(cut: DataFrame, separator: str) -> DataFrame:
    """``value`` (text up to a separator), its ``file``, first byte ``at``, the first byte of its ``block``, and the file's ``bytes``."""
    sign = separator.encode()

    def run(batches):
        for batch in batches:
            for path, size, start, stop in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                with open_file(path) as handle:
                    rows, held = [], 0
                    for row in _pieces_from(handle, start, stop, sign):
                        rows.append(row)
                        held += len(row[1])
                        if len(rows) >= BATCH_PIECES or held >= READ_BYTES:
                            yield _batch(rows, path, start, size)
                            rows, held = [], 0
                    if rows:
                        yield _batch(rows, path, start, size)

    return cut.select("path", "bytes", "start", "stop").mapInArrow(
        run, "value string, file string, at bigint, block bigint, bytes bigint")


def _batch(rows: list[tuple[int, bytes]], path: str, block: int, size: int) -> pa.RecordBatch:
    n = len(rows)
    at, values = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([
        pa.array([v.decode("utf-8", "replace") for v in values], pa.string()), pa.array([path] * n, pa.string()), pa.array(at, pa.int64()),
        pa.array([block] * n, pa.int64()), pa.array([size] * n, pa.int64())], names=["value", "file", "at", "block", "bytes"])


def lines(files: DataFrame) -> DataFrame:
    """``value``, ``file`` and ``place`` of every line; lines end with a line feed, or carriage return and line feed."""
    return pieces(files, "\n").select(F.regexp_replace("value", "\r$", "").alias("value"), "file", F.col("at").alias("place"))
