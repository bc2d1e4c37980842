"""Combining the findings of many chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POSITION_BITS = 24


def finding_index(df: DataFrame) -> DataFrame:
    """``idx`` orders findings by chunk and place in the chunk, without counting them globally.

    A chunk with 2^24 findings or more would run into the next one, so the job fails there.
    """
    packed = F.col("chunk_idx") * F.lit(1 << POSITION_BITS) + F.col("pos")
    too_many = F.raise_error(F.lit("a chunk has too many findings to number")).cast("long")
    return df.withColumn("idx", F.when(F.col("pos") < F.lit(1 << POSITION_BITS), packed.cast("long")).otherwise(too_many))


def fill_blank_ids(df: DataFrame, id_column: str) -> DataFrame:
    """Blank ids get a name of their own from chunk and place; explicit ids cannot collide with it."""
    made = F.concat(F.lit("gen-"), F.col("chunk_idx"), F.lit("-"), F.col("pos"))
    given = F.nullif(F.col(id_column), F.lit(""))
    return df.withColumn(id_column, F.coalesce(given, made))


def first_by_id(df: DataFrame, id_column: str) -> DataFrame:
    """First occurrence of every id in chunk order.

    A minimum aggregate, so repeated ids shrink before the shuffle and none overloads a task.
    """
    indexed = finding_index(fill_blank_ids(df, id_column))
    rest = [c for c in indexed.columns if c not in (id_column, "idx")]
    first = indexed.groupBy(id_column).agg(F.min_by(F.struct(*rest), F.col("idx")).alias("row"),
                                           F.min("idx").alias("idx"))
    return first.select(id_column, "idx", *[F.col(f"row.{c}").alias(c) for c in rest])


def combine_threats(raw: DataFrame) -> DataFrame:
    return first_by_id(raw, "threat_id").withColumn("source_chunk", F.col("chunk_idx"))


def combine_patterns(raw: DataFrame) -> DataFrame:
    return first_by_id(raw, "pattern_id").withColumn("source_chunk", F.col("chunk_idx"))


def links_of(kept: DataFrame, raw_links: DataFrame, id_column: str) -> DataFrame:
    """Event links of the findings that were kept."""
    return raw_links.join(kept.select("chunk_idx", "pos", id_column, "idx"), ["chunk_idx", "pos"]).drop(
        "chunk_idx", "pos")


def distinct_texts(raw: DataFrame, column: str) -> DataFrame:
    """Set union of a text list over all chunks."""
    return raw.select(F.explode(column).alias("text")).distinct()


def collect_chains(replies: DataFrame) -> DataFrame:
    """Chains the scorer proposed, tagged with their chunk, repeats kept."""
    return replies.select("chunk_idx", F.inline("potential_attack_chains"))
