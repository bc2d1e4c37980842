"""Reproducible shuffle into shards: a Feistel permutation with cycle walking over global row numbers.

The place of a row in the shuffled order is a function of its number, the number of rows and a key. So shard and slot
can be computed for any row number without data, and the row number for any shard and slot. All work is
columns and joins; the driver learns the number of rows and how long the longest walk is.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import with_ordinal
from ..workspace import stage

ROUNDS = 6
KEY = "shard order"
#: Rows that a file of a shard holds at most when shards are written.
FILE_ROWS = 1_000_000


def sides(rows: int) -> tuple[int, int]:
    """Numbers of left and right halves; their product is the domain of the permutation.

    It exceeds ``rows`` by less than the number of left halves, which is about the square root of ``rows``.
    """
    left = isqrt(max(rows, 1) - 1) + 1
    return left, max(1, -(-rows // left))


def _mix(half: Column, round_: int, key: str) -> Column:
    """A round's number from 0 to 2^32 - 1: eight hex digits of the MD5 of key, round and half."""
    text = F.concat(F.lit(f"{key}:{round_}:"), half.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")


def _permute(df: DataFrame, rows: int, key: str, backwards: bool = False) -> DataFrame:
    """``value`` of ``df`` moved once through the domain where ``moving`` holds.

    Even rounds add a number from the right half to the left half, odd rounds the other way round. A round is a
    projection of its own, so that a half is computed once however often later rounds use it.
    """
    left, right = sides(rows)
    kept = [c for c in df.columns if c != "value"]
    now = df.select(*kept, F.expr(f"value div {right}").alias("l"), F.pmod("value", F.lit(right)).alias("r"))
    for round_ in reversed(range(ROUNDS)) if backwards else range(ROUNDS):
        changed, other, width = ("l", "r", left) if round_ % 2 == 0 else ("r", "l", right)
        step = F.when(F.col("moving"), _mix(F.col(other), round_, key)).otherwise(0)
        moved = F.col(changed) - step if backwards else F.col(changed) + step
        now = now.select(*kept, F.pmod(moved, F.lit(width)).alias(changed), other)
    return now.select(*kept, (F.col("l") * right + F.col("r")).alias("value"))


def _walks(spark: SparkSession, rows: int, key: str, backwards: bool = False) -> int:
    """How often a value that left the rows has to be moved on until none is outside.

    Only values outside, about the square root of ``rows``, are looked at: those that a row moves to are followed
    until the last has come back. As rows and values outside form closed cycles, each does.
    """
    left, right = sides(rows)
    outside = spark.range(rows, left * right).select(F.col("id").alias("value"), F.lit(True).alias("moving"))
    entered = _permute(outside.withColumn("at", F.col("value")), rows, key, not backwards).where(F.col("value") < rows)
    now, walks = stage(entered.select(F.col("at").alias("value"), "moving"), "walk"), 0
    while not now.isEmpty():
        walks += 1
        now = stage(_permute(now, rows, key, backwards).where(F.col("value") >= rows), "walk")
    return walks


def _moved(df: DataFrame, rows: int, key: str, backwards: bool = False) -> DataFrame:
    """``value`` (0 to ``rows`` - 1) replaced by its image among the same numbers; all of them differ."""
    if rows < 2:
        return df
    now = _permute(df.withColumn("moving", F.lit(True)), rows, key, backwards)
    for _ in range(_walks(df.sparkSession, rows, key, backwards)):
        now = _permute(now.withColumn("moving", F.col("value") >= rows), rows, key, backwards)
    return now.drop("moving")


def shard_places(numbers: DataFrame, column: str, rows: int, shards: int, key: str = KEY) -> DataFrame:
    """``numbers`` with ``shard`` and ``slot`` of the row number in ``column`` (0 to ``rows`` - 1), computed without data.

    Columns named ``shard`` or ``slot`` give way. A null number has null places.
    """
    packed = numbers.select(F.struct(*numbers.columns).alias("row"), F.col(column).cast("bigint").alias("value"))
    out = _moved(packed, rows, key)
    kept = [f"row.`{c}`" for c in numbers.columns if c.lower() not in ("shard", "slot")]
    return out.select(*kept, F.pmod("value", F.lit(shards)).cast("int").alias("shard"), F.expr(f"value div {shards}").alias("slot"))


def rows_at(places: DataFrame, rows: int, shards: int, key: str = KEY) -> DataFrame:
    """``places`` (columns ``shard`` and ``slot``) with ``row_number``, the number of the row that stands there."""
    packed = places.select(F.struct(*places.columns).alias("row"), (F.col("slot") * shards + F.col("shard")).cast("bigint").alias("value"))
    kept = [f"row.`{c}`" for c in places.columns if c.lower() != "row_number"]
    return _moved(packed, rows, key, backwards=True).select(*kept, F.col("value").alias("row_number"))


def shuffle_rows(df: DataFrame, order_by: list[str], shards: int, key: str = KEY) -> DataFrame:
    """``df`` with ``row_number``, ``shard`` and ``slot``: a shuffle that depends on the rows and ``key`` alone.

    Rows are numbered in the order of ``order_by`` (nulls first), however the input is partitioned; rows equal there
    are interchangeable, so name enough columns to tell apart what has to be. Shards differ by one row at
    most, slots are gapless from 0, and a hot value of any column is spread like all others. Columns of the three
    names give way. An empty table gives an empty table.
    """
    packed = df.select(F.struct(*df.columns).alias("row"), *[F.col(c).alias(f"by{i}") for i, c in enumerate(order_by)])
    ordered = with_ordinal(packed, [f"by{i}" for i in range(len(order_by))], "value")
    rows = ordered.count()
    out = _moved(ordered.select("row", "value", F.col("value").alias("row_number")), rows, key)
    kept = [f"row.`{c}`" for c in df.columns if c.lower() not in ("row_number", "shard", "slot")]
    return out.select(*kept, "row_number", F.pmod("value", F.lit(shards)).cast("int").alias("shard"),
                      F.expr(f"value div {shards}").alias("slot"))


def shard_documents(docs: DataFrame, shards: int, key: str = KEY) -> DataFrame:
    """Shard and slot of every document: doc_id, size, text_crc32, law, shard, slot, grown_shard, row_number.

    The law is ``rows``: shards have equally many documents, or one more. ``size`` counts the UTF-8 bytes and one
    more. Documents are numbered by doc_id, then checksum and size, so repeated and null ids are numbered too;
    rows equal in all three have the same result. Null texts count as empty. Further columns aren't read. An
    empty table gives an empty table. Texts are read once and not shuffled.
    """
    text = F.coalesce("text", F.lit(""))
    described = stage(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
                                  F.crc32(text.cast("binary")).alias("text_crc32")), "sizes")
    placed = shuffle_rows(described, ["doc_id", "text_crc32", "size"], shards, key)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
                         "row_number")


def write_shards(df: DataFrame, path: str, order_by: list[str], shards: int, key: str = KEY, file_rows: int = FILE_ROWS) -> None:
    """``df`` as Parquet in folders ``shard=k/block=j``; a block has the slots of ``file_rows`` rows in order.

    A shard is written by as many tasks as it has blocks, so its size is no task's size.
    """
    placed = shuffle_rows(df, order_by, shards, key).withColumn("block", F.expr(f"slot div {file_rows}"))
    (placed.repartition("shard", "block").sortWithinPartitions("shard", "block", "slot")
     .write.partitionBy("shard", "block").parquet(path))
