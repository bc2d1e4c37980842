"""Records that lines do not delimit, cut out of files of any size: elements of JSON documents, CSV records with line breaks.

Spark's text source splits a file into blocks and its reader deals whole pieces (up to a separator) to tasks. What a
piece means depends on all text before it: whether it begins inside quotes, and how deep. So a first pass sums
up each block as a small function of that state; composed in file order, one row per block, they say how each
block begins; a second pass cuts. A record that lies over several blocks comes as fragments, joined at the end.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..workspace import stage

#: Bytes of a record above which it is a reject. A VARIANT holds 128 MB.
LARGEST_RECORD = 100 << 20
#: Characters of a broken record that its reject shows.
SHOWN = 1000

_WHOLE, _HEAD, _TAIL, _MIDDLE = range(4)
_CUT = "file string, place bigint, kind int, size bigint, text string, level int"


def pieces(spark: SparkSession, path, separator: str) -> DataFrame:
    """``value`` (text up to a separator), its ``file``, the first byte of its ``block``, and the file's ``bytes``."""
    raw = spark.read.option("lineSep", separator).text(path)
    at = lambda name: F.col(f"_metadata.{name}")
    # ``units.pieces`` gives the same for a table of files.
    return raw.select("value", at("file_path").alias("file"), at("file_block_start").alias("block"), at("file_size").alias("bytes"))


def _parts(batches: Iterator[pa.RecordBatch], separator: bytes) -> Iterator[tuple[dict, bytes | memoryview]]:
    """Stretches of one block in the order of the file: its other columns, and the text with its separators.

    A block may come in several stretches, one after the other.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        value = batch.column(batch.schema.get_field_index("value")).cast(pa.large_binary())
        ended = pc.binary_join_element_wise(value, pa.scalar(b"", pa.large_binary()), pa.scalar(separator, pa.large_binary()))
        ends = np.frombuffer(ended.buffers()[1], np.int64)[ended.offset:ended.offset + len(ended) + 1]
        block = batch.column(batch.schema.get_field_index("block")).to_numpy()
        file = batch.column(batch.schema.get_field_index("file")).dictionary_encode().indices.to_numpy()
        starts = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (file[1:] != file[:-1])])
        for a, b in zip(starts, [*starts[1:], len(block)], strict=True):
            row = {n: batch.column(i)[int(a)].as_py() for i, n in enumerate(batch.schema.names) if n != "value"}
            yield row, memoryview(ended.buffers()[2])[int(ends[a]):int(ends[b])]


def _blocks(batches: Iterator[pa.RecordBatch], separator: bytes) -> Iterator[tuple[dict, Iterator[memoryview]]]:
    """Each block once, with its stretches."""
    parts, ahead = _parts(batches, separator), None

    def own(first):
        nonlocal ahead
        yield first[1]
        for row, text in parts:
            if (row["file"], row["block"]) != (first[0]["file"], first[0]["block"]):
                ahead = (row, text)
                return
            yield text

    while True:
        first, ahead = (ahead, None) if ahead is not None else (next(parts, None), None)
        if first is None:
            return
        rest = own(first)
        yield first[0], rest
        for _ in rest:
            pass


class _Cuts:
    """Records of one block between cuts, and what of records lies before the first and behind the last cut.

    With ``fragments``, only the latter are kept, else only the former.
    """

    def __init__(self, row: dict, inside: bool, largest: int, fragments: bool, level: int = 0):
        self.file, self.place, self.level, self.largest, self.fragments = row["file"], row["start"], level, largest, fragments
        self.open, self.begun, self.held, self.size = inside, False, [], 0
        self.rows: list[tuple] = []

    def begin(self, place: int) -> None:
        self.open, self.begun, self.place, self.held, self.size = True, True, place, [], 0

    def add(self, text: bytes | memoryview) -> None:
        if self.open and len(text):
            self.size += len(text)
            if self.size <= self.largest or not self.held:
                self.held.append(bytes(text[:self.largest + 1]))

    def end(self) -> None:
        if self.open:
            self._keep(_WHOLE if self.begun else _HEAD)
        self.open = False

    def finish(self) -> None:
        if self.open:
            self._keep(_TAIL if self.begun else _MIDDLE)

    def _keep(self, kind: int) -> None:
        if (kind != _WHOLE) == self.fragments:
            text = b"".join(self.held) if self.size <= self.largest else self.held[0][:4 * SHOWN]
            self.rows.append((self.file, self.place, kind, self.size, text.decode("utf-8", "replace"), self.level))

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["file", "place", "kind", "size", "text", "level"])


def _joined(parts: DataFrame, largest: int) -> DataFrame:
    """Records file, place, size, text, level and ``ended`` from fragments, of which there are two per block at most.

    A record that is too large keeps its beginning alone. One that no cut ends has ``ended`` false.
    """
    # In a block, what goes on from before comes first; places rise with the file's bytes.
    upto = Window.partitionBy("file").orderBy("place", F.col("kind") == _TAIL).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    owned = parts.withColumn("owner", F.last(F.when(F.col("kind") == _TAIL, F.col("place")), ignorenulls=True).over(upto))
    sized = owned.withColumn("total", F.sum("size").over(Window.partitionBy("file", "owner")))
    shown = F.when(F.col("total") <= largest, F.col("text")).when(F.col("kind") == _TAIL, F.substring("text", 1, SHOWN))
    put = sized.groupBy("file", "owner").agg(
        F.array_sort(F.collect_list(F.struct("place", F.col("kind") != _TAIL, shown.alias("text")))).alias("parts"), F.first("total").alias("size"),
        F.first("level").alias("level"), (F.max((F.col("kind") == _HEAD).cast("int")) == 1).alias("ended"))
    text = F.array_join(F.transform("parts", lambda p: p["text"]), "")
    return put.select("file", F.col("owner").alias("place"), "size", text.alias("text"), "level", "ended")


# JSON documents.

#: Keys under which a document may hold its list of events, in the order they are tried.
WRAPPERS = ("events", "data", "telemetry", "telemetry_events")

_STEP = np.zeros(256, np.int64)
_STEP[[ord("["), ord("{")]], _STEP[[ord("]"), ord("}")]] = 1, -1
_MARK = _STEP != 0
_MARK[ord(",")] = True
_LIST, _OBJECT = ord("["), ord("{")


def _marks(text: np.ndarray, quoted: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Places of brackets and commas, whether each lies inside quotes if the text begins ``quoted``, and the quotes' number.

    A piece ends with a bracket, so no backslash escapes across it.
    """
    quotes = np.flatnonzero(text == 34)
    if len(quotes):
        behind = quotes[(quotes > 0) & (text[quotes - 1] == 92)]
        escaped = []
        for q in behind.tolist():
            run = q - 1
            while run >= 0 and text[run] == 92:
                run -= 1
            if (q - 1 - run) % 2:
                escaped.append(q)
        if escaped:
            quotes = np.setdiff1d(quotes, escaped, assume_unique=True)
    places = np.flatnonzero(_MARK[text])
    return places, (np.searchsorted(quotes, places) + quoted) % 2 == 1, len(quotes)


def _summaries(read: DataFrame) -> DataFrame:
    """Per block: parity of its quotes, change of depth if it begins outside or inside quotes, bytes, first sign."""
    fields = pa.schema([("file", pa.string()), *[(n, pa.int64()) for n in ("block", "bytes", "quotes", "outside", "inside", "size")], ("root", pa.string())])

    def run(batches):
        for row, texts in _blocks(batches, b"}"):
            quotes, depth, size, root = 0, [0, 0], 0, None
            for text in texts:
                data = np.frombuffer(text, np.uint8)
                places, quoted, n = _marks(data, 0)
                step = _STEP[data[places]]
                outside, inside = int(step[~quoted].sum()), int(step[quoted].sum())
                if quotes:
                    outside, inside = inside, outside
                depth = [depth[0] + outside, depth[1] + inside]
                quotes, size = (quotes + n) % 2, size + len(data)
                if root is None:
                    found = re.search(rb"[^\s\xef\xbb\xbf]", text)
                    root = found and found.group().decode("latin-1")
            yield pa.RecordBatch.from_pylist([{"file": row["file"], "block": row["block"], "bytes": row["bytes"], "quotes": quotes,
                                               "outside": depth[0], "inside": depth[1], "size": size, "root": root}], schema=fields)

    return read.select("value", "file", "block", "bytes").mapInArrow(run, "file string, block bigint, bytes bigint, quotes bigint, outside bigint, inside bigint, size bigint, root string")


def _states(read: DataFrame) -> DataFrame:
    """Per block: the byte at which its first piece starts, ``quoted`` and ``depth`` there, the file's ``root`` sign, and its ``real`` bytes.

    The reader does not tell whether a file's last piece ended with the separator; the file's size does. (The
    size of a compressed file does not; a record that is cut off at its end may then look complete.)
    """
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    everywhere = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    known = _summaries(read).withColumn("quoted", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2).cast("int"))
    step = F.when(F.col("quoted") == 0, F.col("outside")).otherwise(F.col("inside"))
    last = F.col("block") == F.max("block").over(everywhere)
    added = last & (F.sum("size").over(everywhere) == F.col("bytes") + 1)
    return known.withColumn("step", step).select(
        "file", "block", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"), "quoted",
        F.coalesce(F.sum("step").over(before), F.lit(0)).alias("depth"),
        F.first("root", ignorenulls=True).over(everywhere).alias("root"), (F.col("size") - added.cast("int")).alias("real"))


def _lists(read: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Per document that is an object: where the list under the first of ``keys`` that has one opens and closes."""
    named = re.compile(rb'\s*"(' + "|".join(map(re.escape, keys)).encode() + rb')"\s*:\s*')

    def run(batches):
        for row, texts in _blocks(batches, b"}"):
            quoted, depth, base, found = row["quoted"], row["depth"], 0, []
            for text in texts:
                data = np.frombuffer(text, np.uint8)
                places, inside, quotes = _marks(data, quoted)
                places = places[~inside]
                sign = data[places]
                after = depth + np.cumsum(_STEP[sign])
                for i in np.flatnonzero((sign == _LIST) & (after == 2)).tolist():
                    # The key stands in the same piece, so the sign before it is in this stretch.
                    key = named.fullmatch(text, int(places[i - 1]) + 1, int(places[i])) if i else None
                    if key:
                        found.append((row["start"] + base + int(places[i]), key.group(1).decode()))
                found += [(row["start"] + base + int(p), None) for p in places[(sign == ord("]")) & (after == 1)]]
                quoted, base = (quoted + quotes) % 2, base + len(data)
                depth = int(after[-1]) if len(after) else depth
            if found:
                at, key = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([row["file"]] * len(at)), pa.array(at, pa.int64()), pa.array(key, pa.string())],
                                                 names=["file", "at", "key"])

    signs = read.where(F.col("root") == "{").mapInArrow(run, "file string, at bigint, key string")
    # Behind the opening sign of a list, the next sign of depth 1 closes it.
    spans = signs.withColumn("till", F.lead("at").over(Window.partitionBy("file").orderBy("at"))).where("key is not null")
    rank = F.array_position(F.array(*map(F.lit, keys)), F.col("key"))
    return spans.groupBy("file").agg(F.min(F.struct(rank.alias("rank"), F.col("at").alias("opens"), F.col("till").alias("closes"))).alias("list")).select(
        "file", "list.opens", "list.closes")


def _cut_documents(read: DataFrame, largest: int, fragments: bool) -> DataFrame:
    """Cuts of each document at its ``level``: 0 a whole object, 1 elements of a list, 2 elements of the list from ``opens`` to ``closes``."""

    def run(batches):
        for row, texts in _blocks(batches, b"}"):
            level, quoted, depth, base, left = row["level"], row["quoted"], row["depth"], row["start"], row["real"]
            inner, first, last = max(level, 1), -1, 1 << 62
            if level == 2:
                first, last = row["opens"], row["closes"] if row["closes"] is not None else last
            cuts = _Cuts(row, depth >= inner and first < base <= last, largest, fragments, level)
            for text in texts:
                text = text[:left]
                left -= len(text)
                data = np.frombuffer(text, np.uint8)
                places, inside, quotes = _marks(data, quoted)
                places = places[~inside]
                sign = data[places]
                after = depth + np.cumsum(_STEP[sign])
                wanted = ((after == inner) & (sign == (_LIST if level else _OBJECT))) | ((after == inner - 1) & (_STEP[sign] < 0))
                if level:
                    wanted |= (after == inner) & (sign == ord(","))
                if level == 2:
                    wanted &= (places + base >= first) & (places + base <= last)
                at, done = places[wanted].tolist(), 0
                if fragments and len(at) > 2:
                    at = [at[0], at[-1]]
                for p in at:
                    opens = data[p] == (_LIST if level else _OBJECT)
                    if not opens:
                        cuts.add(text[done:p + (level == 0)])
                        cuts.end()
                    if opens or data[p] == ord(","):
                        cuts.begin(base + p)
                    done = p + (level > 0 or not opens)
                cuts.add(text[done:])
                quoted, base = (quoted + quotes) % 2, base + len(data)
                depth = int(after[-1]) if len(after) else depth
                yield cuts.batch()
            cuts.finish()
            yield cuts.batch()

    return read.mapInArrow(run, _CUT)


def json_records(read: DataFrame, keys: tuple[str, ...] = WRAPPERS, largest: int = LARGEST_RECORD) -> DataFrame:
    """Texts of the records of JSON documents: file, place, text, ``level`` and ``problem``. ``read`` are their pieces up to ``}``.

    A document that is a list has its elements as records (level 1); one that is an object has the elements of the
    list under the first of ``keys`` that holds one (level 2), else it is a record itself (level 0). Files divide by
    Spark's own blocks, whatever their size and layout; ``place`` rises with the bytes of a file. Texts are UTF-8.

    ``problem`` says why there is no record: the document is neither list nor object (level null), the record has
    more than ``largest`` bytes, or the document ends inside it. Records are not parsed here; a broken one leaves the
    others whole as far as its brackets close.
    """
    # Bounded: one row per block of a file.
    states = stage(_states(read), "json-states")
    lists = read.sparkSession.createDataFrame([], "file string, opens bigint, closes bigint")
    if keys:
        lists = stage(_lists(read.join(F.broadcast(states), ["file", "block"]), keys), "json-lists")
    level = F.when(F.col("root") == "[", 1).when(F.col("root") != "{", None).when(F.col("opens").isNotNull(), 2).otherwise(0)
    states = states.join(lists, "file", "left").withColumn("level", level.cast("int"))
    placed = read.join(F.broadcast(states.where("level is not null")), ["file", "block"])
    joined = _joined(stage(_cut_documents(placed, largest, True), "json-fragments"), largest)
    whole = _cut_documents(placed, largest, False).select("file", "place", "size", "text", "level", F.lit(True).alias("ended"))
    # Between the brackets of an empty list, or behind a last comma, stands nothing.
    found = whole.unionByName(joined).where(~(F.col("ended") & (F.btrim("text", F.lit(" \t\r\n")) == "")))
    problem = F.when(F.col("size") > largest, f"record of more than {largest} bytes").when(~F.col("ended"), "the document ends inside the record")
    none = states.where("level is null").select("file").distinct().select(
        "file", F.lit(0).cast("long").alias("place"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("int").alias("level"),
        F.lit("not a JSON document").alias("problem"))
    return found.select("file", "place", "text", "level", problem.alias("problem")).unionByName(none)


# CSV records.

_FIELDS = re.compile(rb'(?:(?:"[^"]*+(?:""[^"]*+)*+"[^,]*+|[^",][^,]*+)?+(?:,|\Z))*+')
_CLOSED = re.compile(rb'[^"]*+(?:""[^"]*+)*+"')


def ends_quoted(line: bytes, quoted: bool) -> bool:
    """Whether a line that begins inside quotes, or not, ends inside quotes.

    Quotes count at the beginning of a field alone; inside, two stand for one.
    """
    if b'"' not in line:
        return quoted
    start = 0
    if quoted:
        closed = _CLOSED.match(line)
        if not closed:
            return True
        start = line.find(b",", closed.end()) + 1
        if not start:
            return False
    return _FIELDS.match(line, start).end() < len(line)


def _line_states(read: DataFrame) -> DataFrame:
    """Per block: the byte at which its first line starts, ``quoted``, whether that is inside quotes, and ``ends``, whether it ends there.

    A block takes each of the two states to one. What it makes of them is constant, or it keeps or swaps
    them; so the state is that of the last constant block before, swapped as often as blocks between do.
    """

    def run(batches):
        for row, texts in _blocks(batches, b"\n"):
            ends, size = [False, True], 0
            for text in texts:
                data = bytes(text)
                size += len(data)
                if b'"' in data:
                    for line in data.split(b"\n")[:-1]:
                        if b'"' in line:
                            ends = [ends_quoted(line, q) for q in ends] if ends[0] != ends[1] else [ends_quoted(line, ends[0])] * 2
            yield pa.RecordBatch.from_pylist([{"file": row["file"], "block": row["block"], "outside": int(ends[0]), "inside": int(ends[1]), "size": size}])

    known = read.mapInArrow(run, "file string, block bigint, outside bigint, inside bigint, size bigint")
    order = Window.partitionBy("file").orderBy("block")
    before, upto = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swap = (F.col("outside") > F.col("inside")).cast("int")
    known = known.withColumn("swaps", F.sum(swap).over(upto))
    fixed = F.max(F.when(F.col("outside") == F.col("inside"), F.struct("block", "outside", "swaps"))).over(before)
    swapped = F.coalesce(F.max("swaps").over(before), F.lit(0)) - F.coalesce(fixed["swaps"], F.lit(0))
    quoted = ((F.coalesce(fixed["outside"], F.lit(0)) + swapped) % 2).cast("int")
    start = F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start")
    return known.withColumn("quoted", quoted).select("file", "block", start, "quoted", F.when(F.col("quoted") == 0, F.col("outside")).otherwise(F.col("inside")).alias("ends"))


def _values(text: bytes) -> list[str]:
    text = re.sub(rb"\r?\n\Z", b"", text).decode("utf-8", "replace")
    csv.field_size_limit(1 << 31)
    return text.split(",") if '"' not in text else next(csv.reader(io.StringIO(text, newline="")), [""])


def csv_heads(read: DataFrame, largest: int = LARGEST_RECORD) -> DataFrame:
    """``file``, ``place`` and ``header`` (names) of the first record of each file that isn't blank, from its first block of lines.

    A file whose first block or first ``largest`` bytes do not end it has no row.
    """

    def run(batches):
        for row, stretches in _blocks(batches, b"\n"):
            held, quoted, at, done = b"", False, 0, False
            for stretch in stretches:
                text, start = bytes(stretch), 0
                while start < len(text) and not done and len(held) <= largest:
                    end = text.index(b"\n", start) + 1
                    quoted = ends_quoted(text[start:end - 1], quoted)
                    held += text[start:end]
                    start = end
                    done = not quoted and bool(held.strip(b"\xef\xbb\xbf \t\r\n"))
                    if not quoted and not done:
                        at, held = at + len(held), b""
                if done:
                    yield pa.RecordBatch.from_pylist([{"file": row["file"], "place": at, "header": _values(held.removeprefix(b"\xef\xbb\xbf"))}])
                    break

    return read.where(F.col("block") == 0).mapInArrow(run, "file string, place bigint, header array<string>")


def csv_records(read: DataFrame, largest: int = LARGEST_RECORD) -> DataFrame:
    """CSV records of lines: file, place (the first byte), ``values``, ``text`` and ``problem``; blank lines are left out.

    A record goes on over line breaks inside quotes, also from one block of a file to the next. ``problem`` says
    that it has more than ``largest`` bytes or that its last quote is never closed; it then has no values, and ``text``
    is its beginning. The header is a record like others.
    """
    # Bounded: one row per block of a file.
    states = stage(_line_states(read), "csv-states")
    placed = read.join(F.broadcast(states), ["file", "block"])

    def cut(fragments: bool):
        def run(batches):
            for row, stretches in _blocks(batches, b"\n"):
                at, quoted = row["start"], bool(row["quoted"])
                cuts = _Cuts(row, quoted, largest, fragments)
                for stretch in stretches:
                    for line in bytes(stretch).split(b"\n")[:-1]:
                        if not cuts.open:
                            cuts.begin(at)
                        cuts.add(line + b"\n")
                        at += len(line) + 1
                        quoted = ends_quoted(line, quoted)
                        if not quoted:
                            cuts.end()
                    yield cuts.batch()
                cuts.finish()
                yield cuts.batch()

        return run

    def split(batches):
        for batch in batches:
            ended, size = batch.column(batch.schema.get_field_index("ended")).to_pylist(), batch.column(batch.schema.get_field_index("size")).to_pylist()
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            values = [_values(t.encode()) if e and n <= largest else None for t, e, n in zip(texts, ended, size, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.list_(pa.string()))], names=[*batch.schema.names, "values"])

    whole = placed.mapInArrow(cut(False), _CUT).where(F.btrim("text", F.lit(" \t\r\n")) != "")
    crossing = placed.where("quoted = 1 or ends = 1").mapInArrow(cut(True), _CUT)
    columns = ["file", "place", "size", "text", "ended"]
    found = whole.withColumn("ended", F.lit(True)).select(*columns).unionByName(_joined(stage(crossing, "csv-fragments"), largest).select(*columns))
    parsed = found.mapInArrow(split, "file string, place bigint, size bigint, text string, ended boolean, values array<string>")
    problem = F.when(F.col("size") > largest, f"record of more than {largest} bytes").when(~F.col("ended"), "the last quote is never closed")
    shown = F.when(problem.isNull(), F.col("text")).otherwise(F.substring("text", 1, SHOWN))
    return parsed.select("file", "place", "values", shown.alias("text"), problem.alias("problem"))
