"""Global positions and overlapping chunks without a single-task sort."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import stage

_ROW_BITS = (1 << 33) - 1  # low bits of monotonically_increasing_id: row number inside the partition


def with_ordinal(df: DataFrame, order_by: list[str], name: str = "ord", shape: Callable[..., DataFrame] | None = None) -> DataFrame:
    """Add the 0-based global position by ``order_by``.

    Rows are range-partitioned and sorted, then written once with their partition number
    and place, so a lost executor cannot renumber them. A position is the place plus the
    number of rows in earlier partitions; that offsets table has one row per partition.
    ``shape`` (rows, names of columns to keep) turns each sorted row into one other before they are written, so
    that neither the sampling for the ranges nor the shuffle carries what it adds.
    """
    columns = [F.col(c) for c in order_by]
    placed = (
        df.repartitionByRange(*columns)
        .sortWithinPartitions(*columns)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS)))
    )
    staged = stage(shape(placed, "_part", "_place") if shape else placed, "ordered")
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        staged.groupBy("_part").agg(F.count("*").alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"))
    )
    # Bounded: one row per partition of the sort.
    joined = staged.join(F.broadcast(offsets), "_part")
    return joined.withColumn(name, F.col("_offset") + F.col("_place")).drop("_part", "_place", "_offset")


def in_stretches(df: DataFrame, order_by: list[str], label: str = "stretches") -> DataFrame:
    """``df`` written with ``_part``: the number of the stretch of the order that a row lies in.

    Stretches have about as many rows each, whatever the values; a key with a third of all rows has a third
    of the stretches. Groups by (``_part``, key) are therefore bounded, and what they have to tell each other is
    one row for each.
    """
    placed = df.repartitionByRange(*[F.col(c) for c in order_by]).withColumn("_part", F.spark_partition_id())
    return stage(placed, label)


def exact_quantile(df: DataFrame, column: str, q: float) -> Column:
    """Smallest value with at least ``q`` of the rows at or below it, as a scalar subquery.

    Equal values are counted first, so a value that most rows have is one row of the sort.
    """
    counted = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_n"))
    placed = stage(counted.repartitionByRange(column).withColumn("_part", F.spark_partition_id()), "quantile")
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("_part").agg(F.sum("_n").alias("_rows"))
    offsets = sums.select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_part").orderBy(column)
    # Bounded: one row per partition of the sort.
    running = placed.join(F.broadcast(offsets), "_part").withColumn("_upto", F.col("_offset") + F.sum("_n").over(inside))
    total = placed.select(F.sum("_n")).scalar()
    rank = F.greatest(F.ceil(F.lit(q) * total), F.lit(1))
    return running.filter(F.col("_upto") >= rank).select(F.min(column)).scalar()


def overlapping_chunks(ordered: DataFrame, size: int, overlap: int) -> DataFrame:
    """One row per (chunk, event): chunk k holds positions [k*step, k*step + size).

    The last chunk is the first one that reaches the end; rows in an overlap appear twice.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below the chunk size")
    step = size - overlap
    events = F.count("*")
    last = ordered.select(F.when(events <= size, F.lit(0)).otherwise(F.ceil((events - size) / F.lit(step)))).scalar()
    position = F.col("ord")
    first = F.greatest(F.lit(0), F.floor((position - size + step) / F.lit(step)))
    final = F.least(F.floor(position / F.lit(step)), last)
    return ordered.withColumn("chunk_idx", F.explode(F.sequence(first.cast("long"), final.cast("long"))))


def chunk_bounds(chunked: DataFrame) -> DataFrame:
    """Event count, first and last time and position of each chunk."""
    return chunked.groupBy("chunk_idx").agg(
        F.count("*").alias("event_count"),
        F.min("timestamp").alias("start_time"),
        F.max("timestamp").alias("end_time"),
        F.min("ord").alias("start_index"),
        F.max("ord").alias("end_index"),
    )
