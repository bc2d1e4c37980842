"""How well a chunked analysis did."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..workspace import stage
from .ordering import with_ordinal

#: Distinct type sets on each side of a tile, and types of a tile that are compared at a time.
TILE_SETS, TILE_TYPES = 1024, 4096


def _ratio(over: Column, under: Column) -> Column:
    return F.coalesce(F.try_divide(over, under), F.lit(0.0))


def threat_span(raw_threats: DataFrame, raw_links: DataFrame) -> DataFrame:
    """Per threat id, over all chunks before repeats are removed: events and chunks it covers."""
    chunks = raw_threats.select("threat_id", "chunk_idx").distinct().groupBy("threat_id").agg(
        F.count("*").alias("chunk_count"))
    events = raw_links.select("threat_id", "event_id").distinct().groupBy("threat_id").agg(
        F.count("*").alias("event_count"))
    zero = F.lit(0).cast("long")
    return chunks.join(events, "threat_id", "left").select(
        "threat_id", "chunk_count", F.coalesce("event_count", zero).alias("event_count"),
        (F.col("chunk_count") > 1).alias("multi_chunk"))


def chain_spans(members: DataFrame) -> DataFrame:
    """Per chain: threats and distinct source chunks."""
    threats = members.groupBy("chain_no").agg(F.count("*").alias("threats"))
    chunks = members.select("chain_no", "source_chunk").distinct().groupBy("chain_no").agg(
        F.count("*").alias("chunks"))
    return threats.join(chunks, "chain_no")


def context_window_metrics(spans: DataFrame, chains: DataFrame, chunk_count: Column) -> DataFrame:
    """How much was linked across chunk borders; 1 means nothing was.

    ``spans`` comes from ``threat_span``, ``chains`` from ``chain_spans``.
    """
    threats = spans.agg(
        F.count("*").alias("total_threats"),
        F.count_if(~F.col("multi_chunk")).alias("single_chunk_threats"),
        F.count_if("multi_chunk").alias("multi_chunk_threats"))
    lengths = chains.agg(
        F.struct(F.coalesce(F.avg("threats"), F.lit(0.0)).alias("avg"),
                 F.coalesce(F.max("threats"), F.lit(0)).alias("max"),
                 F.count_if(F.col("chunks") > 1).alias("cross"))).scalar()
    rate = _ratio(F.col("multi_chunk_threats"), F.col("total_threats"))
    return threats.withColumn("chain", lengths).select(
        chunk_count.alias("total_chunks"), "total_threats", "single_chunk_threats", "multi_chunk_threats",
        rate.alias("cross_chunk_connection_rate"), F.col("chain.avg").alias("avg_chain_length"),
        F.col("chain.max").alias("max_chain_length"), F.col("chain.cross").alias("cross_chunk_chains"),
        (1 - rate).alias("limitation_score"))


def threat_types_by_chunk(threats: DataFrame) -> DataFrame:
    """One row per chunk and type; the types of a chunk are free text, so they aren't gathered into a list."""
    return threats.select("source_chunk", F.coalesce("threat_type", F.lit("Unknown")).alias("threat_type")).distinct()


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Numbers of types that each left and each right set have in common: a product of 0/1 matrices, some types at a time."""
    out = np.zeros((len(left), len(right)), np.int64)
    ends = [np.cumsum([0, *map(len, side)]) for side in (left, right)]
    flat = [np.concatenate(side) for side in (left, right)]
    rows = [np.repeat(np.arange(len(side)), np.diff(e)) for side, e in zip((left, right), ends, strict=True)]
    shared = np.intersect1d(*flat)
    for start in range(0, len(shared), TILE_TYPES):
        types, ones = shared[start:start + TILE_TYPES], []
        for values, row, side in zip(flat, rows, (left, right), strict=True):
            at = np.searchsorted(types, values)
            known = (at < len(types)) & (types[np.minimum(at, len(types) - 1)] == values)
            ones.append(np.zeros((len(side), len(types)), np.float32))
            ones[-1][row[known], at[known]] = 1
        out += (ones[0] @ ones[1].T).astype(np.int64)
    return out


def _tile(table: pa.Table) -> pa.Table:
    """Pairs of one tile counted by (smaller size, larger size, types in common)."""
    block = table.column("block").to_numpy()
    types = np.array([np.array(t, np.int64) for t in table.column("types").to_pylist()] + [None], object)[:-1]
    chunks, sizes = table.column("chunks").to_numpy(), np.array([len(t) for t in types])
    low = block == table.column("low")[0].as_py()
    alone = table.column("low")[0] == table.column("high")[0]
    high = low if alone else ~low
    if not low.any() or not high.any():
        low = high = np.zeros(len(block), bool)
    common = _common(list(types[low]), list(types[high])) if low.any() else np.zeros((0, 0), np.int64)
    # Products of chunk counts may pass 64 bits at very many chunks; then Python's integers count.
    wide = float(chunks.max()) ** 2 * max(1, common.size) >= 2.0 ** 62
    weight = chunks.astype(object if wide else np.int64)
    pairs = weight[low][:, None] * weight[high][None, :]
    if alone:
        pairs[np.tril_indices(len(pairs))] = 0
        np.fill_diagonal(pairs, weight[low] * (weight[low] - 1) // 2)
    a, b = np.minimum.outer(sizes[low], sizes[high]).ravel(), np.maximum.outer(sizes[low], sizes[high]).ravel()
    rows = np.array([a, b, common.ravel()])
    order = np.lexsort(rows)
    rows, pairs = rows[:, order], pairs.ravel()[order]
    starts = np.flatnonzero(np.r_[True, (rows[:, 1:] != rows[:, :-1]).any(axis=0)]) if len(pairs) else np.zeros(0, int)
    sums = np.add.reduceat(pairs, starts) if len(pairs) else pairs
    return pa.table({"a": rows[0, starts], "b": rows[1, starts], "c": rows[2, starts], "pairs": pa.array([str(n) for n in sums], pa.string())})


def chunk_pairs(threats: DataFrame) -> DataFrame:
    """All pairs of chunks, counted by (types_a, types_b, shared types) with types_a <= types_b.

    Pairs are never listed. Chunks with equal type sets collapse to one row with their number. The sets, by size,
    make blocks of ``TILE_SETS``; for every two blocks one task takes the product of their 0/1 matrices, whatever
    the sets' sizes, and returns counts only. A task holds two blocks of sets, their square of counts and
    ``TILE_TYPES`` columns (about 60 MB and the sets themselves); the work grows with the square of the distinct
    sets, as the result depends on all of their pairs.
    """
    kinds = threats.select("source_chunk", F.coalesce("threat_type", F.lit("Unknown")).alias("t")).distinct()
    numbers = stage(kinds.select("t").distinct().withColumn("number", F.monotonically_increasing_id()), "type-numbers")
    chunk_sets = kinds.join(numbers, "t").groupBy("source_chunk").agg(F.array_sort(F.collect_list("number")).alias("types"))
    sets = chunk_sets.groupBy("types").agg(F.count("*").alias("chunks")).withColumn("size", F.size("types"))
    placed = with_ordinal(sets, ["size", "types"]).select("types", "chunks", F.floor(F.col("ord") / TILE_SETS).alias("block"))
    last = placed.agg(F.coalesce(F.max("block"), F.lit(0))).scalar()
    tiles = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last))).select(
        "types", "chunks", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    counted = tiles.groupBy("low", "high").applyInArrow(_tile, "a bigint, b bigint, c bigint, pairs string")
    found = counted.groupBy("a", "b", "c").agg(F.sum(F.col("pairs").cast("decimal(38,0)")).alias("pairs")).where("pairs > 0")
    return found.select(
        F.col("a").alias("types_a"), F.col("b").alias("types_b"), F.col("c").alias("shared_types"), F.col("pairs").cast("long").alias("pairs"),
        (F.col("c") / (F.col("a") + F.col("b") - F.col("c"))).alias("similarity"))


def chunk_similarity(threats: DataFrame) -> DataFrame:
    """Mean Jaccard similarity of the threat types of all chunk pairs."""
    kinds = threats.agg(F.count_distinct(F.coalesce("threat_type", F.lit("Unknown")))).scalar()
    total = threats.agg(F.count("*")).scalar()
    similarity = _ratio(F.sum(F.col("similarity") * F.col("pairs")), F.sum("pairs"))
    return chunk_pairs(threats).agg(similarity.alias("avg_chunk_similarity")).select(
        "avg_chunk_similarity", (1 - F.col("avg_chunk_similarity")).alias("inconsistency_rate"),
        kinds.alias("unique_threat_types"), total.alias("total_threats"))


def detection_accuracy(threats: DataFrame, ground_truth: DataFrame) -> DataFrame:
    """Precision, recall and F1 of the set of detected types against the set of true types."""
    found = threats.select(F.coalesce("threat_type", F.lit("Unknown")).alias("type")).distinct()
    true = ground_truth.select(F.coalesce("type", F.lit("Unknown")).alias("type")).distinct()
    both = found.withColumn("found", F.lit(True)).join(true.withColumn("true", F.lit(True)), "type", "full")
    hits = both.agg(
        F.count_if(F.col("found") & F.col("true")).alias("tp"),
        F.count_if(F.col("found") & F.col("true").isNull()).alias("fp"),
        F.count_if(F.col("true") & F.col("found").isNull()).alias("fn"))
    precision = _ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    recall = _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return hits.select("tp", "fp", "fn", precision.alias("precision"), recall.alias("recall")).withColumn(
        "f1_score", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def type_set_operations(threats: DataFrame, ground_truth: DataFrame) -> DataFrame:
    """Types in both sets, only detected, only true, and in either, as labelled rows."""
    found = threats.select(F.coalesce("threat_type", F.lit("Unknown")).alias("type"))
    true = ground_truth.select(F.coalesce("type", F.lit("Unknown")).alias("type"))
    parts = {
        "intersection": found.intersect(true),
        "only_detected": found.subtract(true),
        "only_true": true.subtract(found),
        "union": found.union(true).distinct(),
    }
    frames = [df.select(F.lit(name).alias("operation"), "type") for name, df in parts.items()]
    result = frames[0]
    for frame in frames[1:]:
        result = result.union(frame)
    return result


def memory_metrics(chains: DataFrame, covered_threats: Column, distinct_threats: Column) -> DataFrame:
    """How far chains reach across chunks; without chains the limitation is 1."""
    totals = chains.agg(
        F.count("*").alias("total_chains"),
        F.coalesce(F.avg("threats"), F.lit(0.0)).alias("avg_chain_length"),
        F.coalesce(F.max("threats"), F.lit(0)).alias("max_chain_length"),
        F.count_if(F.col("chunks") > 1).alias("cross_chunk_chains"),
        F.coalesce(F.max("chunks"), F.lit(0)).alias("max_chunks_per_chain"))
    share = _ratio(F.col("cross_chunk_chains"), F.col("total_chains"))
    return totals.select(
        "total_chains", "avg_chain_length", "max_chain_length", "cross_chunk_chains",
        share.alias("cross_chunk_chains_percent"), "max_chunks_per_chain",
        _ratio(covered_threats, distinct_threats).alias("chain_threat_coverage"),
        (1 - share).alias("memory_limitation_score"))


def limitation_band(score: Column) -> Column:
    band = F
    for upper, text in C.LIMITATION_BANDS:
        band = band.when(score < upper, text)
    return band.otherwise(C.LIMITATION_TOP)


def limitation_report(context_score: Column, inconsistency: Column, memory_score: Column, base: DataFrame) -> DataFrame:
    """The three scores and their mean, each with its band; ``base`` is any one-row frame."""
    overall = (context_score + inconsistency + memory_score) / 3
    named = [("overall", overall), ("context_window", context_score), ("probabilistic_correlation", inconsistency),
             ("memory", memory_score)]
    rows = F.array(*[F.struct(F.lit(n).alias("area"), s.cast("double").alias("score")) for n, s in named])
    return base.select(F.inline(rows)).withColumn("band", limitation_band(F.col("score")))
