from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from logloom.llm import shard_order
from logloom.llm.queries import op12_shard_order


def plain_place(number, rows, key=shard_order.KEY):
    """The permutation in plain Python: rounds, and walks while the value is outside."""
    left, right = shard_order.sides(rows)

    def once(x):
        halves = list(divmod(x, right))
        for r in range(shard_order.ROUNDS):
            mixed = int(md5(f"{key}:{r}:{halves[1 - r % 2]}".encode()).hexdigest()[:8], 16)
            halves[r % 2] = (halves[r % 2] + mixed) % (left, right)[r % 2]
        return halves[0] * right + halves[1]

    if rows < 2:
        return number
    number = once(number)
    while number >= rows:
        number = once(number)
    return number


def plain(rows, shards):
    described = sorted(((d, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for d, t in rows),
                       key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    places = [plain_place(i, len(rows)) for i in range(len(rows))]
    return Counter((d, size, crc, "rows", p % shards, p // shards, None) for (d, crc, size), p in zip(described, places, strict=True))


COLUMNS = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def check(got, rows, shards):
    assert got.columns[:7] == COLUMNS
    assert dict(got.dtypes)["slot"] == "bigint" and dict(got.dtypes)["shard"] == "int"
    assert Counter(tuple(r)[:7] for r in got.collect()) == plain(rows, shards)


def test_query_equals_plain_permutation(spark, small, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    got = op12_shard_order(spark, small)
    check(got, rows, 16)
    slots = defaultdict(list)
    for r in got.collect():
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


@pytest.mark.parametrize("rows", [0, 1, 2, 3, 5, 7, 10, 17, 50, 101, 1000, 1001])
def test_permutation_and_its_inverse(spark, rows):
    placed = shard_order.shard_places(spark.range(rows), "id", rows, 7)
    assert sorted(r["slot"] * 7 + r["shard"] for r in placed.collect()) == list(range(rows))
    assert all(r["slot"] * 7 + r["shard"] == plain_place(r["id"], rows) for r in placed.collect())
    assert all(r["id"] == r["row_number"] for r in shard_order.rows_at(placed, rows, 7).collect())


def test_same_shuffle_for_any_partitioning(spark, documents):
    one, other = (shard_order.shard_documents(d, 16) for d in (documents.repartition(1), documents.repartition(13, "text")))
    assert Counter(one.collect()) == Counter(other.collect())
    moved = shard_order.shard_documents(documents, 16, key="another")
    assert Counter(one.collect()) != Counter(moved.collect())


def test_neighbours_part(spark):
    """Consecutive numbers are spread: no shard has many more pairs of neighbours than chance gives."""
    placed = {r["id"]: r["shard"] for r in shard_order.shard_places(spark.range(4000), "id", 4000, 16).collect()}
    together = sum(placed[i] == placed[i + 1] for i in range(3999))
    assert 150 < together < 350


def test_odd_rows(odd, empty):
    check(shard_order.shard_documents(odd, 3), [(r["doc_id"], r["text"]) for r in odd.collect()], 3)
    assert shard_order.shard_documents(empty, 16).collect() == []


def test_clashing_columns_and_written_files(spark, odd, tmp_path):
    df = odd.withColumn("shard", F.lit("x")).withColumn("Slot", F.lit(1.5)).withColumn("value", F.lit(3)).withColumn("_part", F.lit(9))
    placed = shard_order.shuffle_rows(df, ["doc_id", "text"], 4)
    rows = placed.collect()
    assert Counter(r["text"] for r in rows) == Counter(r["text"] for r in odd.collect()) and {r["value"] for r in rows} == {3}
    assert sorted(r["row_number"] for r in rows) == list(range(odd.count()))
    shard_order.write_shards(df, str(tmp_path / "out"), ["doc_id", "text"], 4, file_rows=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter((r["shard"], r["slot"], r["text"]) for r in back.collect()) == Counter((r["shard"], r["slot"], r["text"]) for r in rows)
    assert all(len(list(f.glob("*.parquet"))) == 1 for f in (tmp_path / "out").glob("shard=*/block=*"))


def test_no_python_in_the_plan(documents):
    plan = shard_order.shard_documents(documents, 16)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "InPandas" not in plan
