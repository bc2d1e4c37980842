"""Files read by units of bytes give the same pieces whatever the size of a unit."""

from __future__ import annotations

import bz2
import gzip
import random

import pytest
from pyspark.sql import functions as F

from logloom.sources import files, units


@pytest.mark.parametrize("separator", ["\n", "}", "</Event>", "ab"])
@pytest.mark.parametrize("size", [1, 3, 7, 50, 1 << 20])
def test_pieces_of_any_unit(tmp_path, monkeypatch, separator, size):
    """Every piece once, by the unit that its first byte lies in; also separators over a border and read in parts."""
    monkeypatch.setattr(units, "READ_BYTES", 5)
    rnd = random.Random(size)
    sign = separator.encode()
    for text in (b"", sign, b"x", sign * 3, b"".join(rnd.choice([b"a", b"b", b"ba", sign, b"xyz", "é".encode()]) for _ in range(60))):
        (tmp_path / "f").write_bytes(text)
        found = []
        for start in range(0, max(len(text), 1), size):
            with units.open_file(str(tmp_path / "f")) as handle:
                found += list(units._pieces_from(handle, start, min(start + size, len(text)), sign))
        want, at = [], 0
        for piece in text.split(sign):
            want.append((at, piece))
            at += len(piece) + len(sign)
        assert found == (want if want[-1][1] else want[:-1])


def test_lines_over_units_and_codecs(spark, tmp_path):
    rows = [f"line {i} é" + "x" * (i % 30) for i in range(3000)]
    body = "\r\n".join(rows).encode()
    (tmp_path / "a b%20[1].log").write_bytes(body)
    (tmp_path / "b.log.gz").write_bytes(gzip.compress(body))
    (tmp_path / "c.log.bz2").write_bytes(bz2.compress(body))
    listing = files.list_files(spark, str(tmp_path)).select("path", "length")
    cut = units.units(listing, 2000)
    assert cut.where(F.col("path").endswith(".log")).count() > 20 and cut.where(~F.col("path").endswith(".log")).count() == 2
    got = units._read(cut, "\n").select(F.regexp_replace("value", "\r$", "").alias("value"), "file", "at").orderBy("file", "at").collect()
    assert [r.value for r in got] == rows * 3
    assert sorted(r.value for r in units.lines(listing).collect()) == sorted(rows * 3)


def test_plan_does_not_grow_with_files(spark, tmp_path):
    def plan(n):
        folder = tmp_path / str(n)
        folder.mkdir()
        for i in range(n):
            (folder / f"{i}.log").write_text(f"CEF:0|v|p|1|{i}|n|5|src={i}\n")
            (folder / f"{i}.csv").write_text(f"timestamp,event_type,hostname,user\n2025-01-01,t,h{i},u\n")
        loaded = files.load_with_rejects(spark, str(folder))
        assert loaded.records.count() == 2 * n
        return loaded.records._jdf.queryExecution().analyzed().toString().count("\n")

    assert plan(2) == plan(40)


def test_compressed_documents_are_detected(spark, tmp_path):
    (tmp_path / "a.json.gz").write_bytes(gzip.compress(b'{"events": [{"event_id": "1"}, {"event_id": "2"}]}'))
    (tmp_path / "b.csv.gz").write_bytes(gzip.compress(b'timestamp,event_type,hostname,user\n2025-01-01,t,"h\n1",u\n'))
    events, rejects = files.load_events(spark, str(tmp_path))
    assert {r.format for r in events.collect()} == {"json-events", "csv"} and events.count() == 3 and rejects.count() == 0
