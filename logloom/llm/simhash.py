"""Near-duplicate documents by SimHash fingerprints, pigeonhole blocks and Hamming distance."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..workspace import stage
from .common import arrow_pass, raw_bytes, slices, tidy

SEED = 42
#: Blocks of the 64 bits. Fingerprints that differ in at most ``distance`` bits agree in ``BLOCKS - distance`` of them.
BLOCKS = 6
#: Fingerprints of one block key that a task compares; longer keys are cut into chunks and compared chunk by chunk.
CHUNK = 8192
#: Shingle hashes whose bits are counted at a time, so a long text needs no more memory than a short one.
HASHES_AT_ONCE = 65536


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """Unsigned 64-bit SimHash of a UTF-8 text over lower-cased word shingles, repeats included.

    Words are what ASCII white space separates. Fewer than ``width`` words make one shingle; none give zero.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    width = min(width, len(words))
    shingles = zip(*(words[i:] for i in range(width)), strict=False)
    total = len(words) - width + 1
    digest, join = xxhash.xxh64_intdigest, b" ".join
    sizes = (min(HASHES_AT_ONCE, total - start) for start in range(0, total, HASHES_AT_ONCE))
    return majority(np.fromiter((digest(join(next(shingles)), SEED) for _ in range(n)), np.uint64, n) for n in sizes)


def majority(parts: Iterable[np.ndarray]) -> int:
    """The bits that are set in over half of the hashes, as an unsigned number."""
    counts, total = np.zeros(64, np.int64), 0
    for hashes in parts:
        bits = np.unpackbits(hashes.view(np.uint8).reshape(len(hashes), 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
        total += len(hashes)
    return int(np.packbits(2 * counts > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``doc_id`` and ``fp`` (the fingerprint's 64 bits as a long), one row per row of ``docs``."""

    def run(batches):
        for part in slices(batches):
            prints = np.array([fingerprint(t, width) for t in raw_bytes(part)], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])

    return arrow_pass(docs, ["doc_id", "text"], run, "doc_id bigint, fp bigint")


def _masks(distance: int) -> list[int]:
    """Bit masks of every choice of blocks that a close pair can share, as signed longs."""
    edges = np.linspace(0, 64, BLOCKS + 1).round().astype(int)
    blocks = [(1 << int(b)) - (1 << int(a)) for a, b in zip(edges, edges[1:], strict=False)]
    masks = [sum(chosen) for chosen in combinations(blocks, BLOCKS - distance)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def _forest(values: np.ndarray, distance: int) -> list[tuple[int, np.ndarray]]:
    """Links that span the components of ``values`` under the distance: (position, positions joined to it).

    A value that is reached leaves the search, so a dense group costs one comparison per member, not one per pair.
    """
    found, open_ = [], np.arange(len(values))
    while len(open_) > 1:
        first, open_ = open_[0], open_[1:]
        waiting = [first]
        while waiting and len(open_):
            near = np.bitwise_count(values[open_] ^ values[waiting.pop()]) <= distance
            if near.any():
                hits, open_ = open_[near], open_[~near]
                found.append((first, hits))
                waiting.extend(hits)
    return found


def near_links(prints: DataFrame, distance: int = 3) -> DataFrame:
    """Links ``a``, ``b`` between nodes of fingerprints that differ in at most ``distance`` bits.

    ``prints`` has one row per distinct ``fp`` with its ``node``, a struct (missing, id). The links span the
    same components as all close pairs do, but are at most (members - 1) per block key and chunk pair. A
    block key with more than ``CHUNK`` fingerprints is cut into chunks by hash, and every pair of chunks is
    compared in a task of its own, so no group is held whole by one task and no pair is left out.
    """
    keys = F.explode(F.array(*[
        F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(_masks(distance))]))
    keyed = prints.select("fp", "node", keys.alias("key")).select("key.c", "key.k", "fp", "node")
    long_keys = (keyed.groupBy("c", "k").count().where(F.col("count") > CHUNK)
                 .select("c", "k", F.ceil(F.col("count") / CHUNK).cast("int").alias("chunks")))
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    spread = (keyed.join(long_keys, ["c", "k"], "left")
              .withColumn("own", F.when(F.col("chunks").isNull(), 0).otherwise(own))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)))
              .select("c", "k", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp", "node"))
    group = ["c", "k", "i", "j"]
    dealt = (spread.select(*group, "fp", F.col("node.missing").alias("missing"), F.col("node.id").alias("id"))
             .repartition(*group).sortWithinPartitions(*group))

    def run(batches):
        held = None
        for batch in batches:
            now = [batch.column(x).to_numpy(zero_copy_only=False) for x in range(7)]
            now = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            changed = np.any([x[1:] != x[:-1] for x in now[:4]], axis=0)
            cuts = np.concatenate([[0], np.flatnonzero(changed) + 1])
            held = [x[cuts[-1]:] for x in now]
            yield from links_of(now, cuts)
        if held is not None:
            yield from links_of(held, np.array([0, len(held[0])]))

    def links_of(columns, cuts):
        """Links of the groups between consecutive cuts."""
        values, missing, ids = columns[4].view(np.uint64), columns[5], columns[6]
        left, right = [], []
        for a in np.flatnonzero(np.diff(cuts) > 1):
            base = cuts[a]
            for first, hits in _forest(values[base:cuts[a + 1]], distance):
                left.append(np.full(len(hits), base + first))
                right.append(base + hits)
        if left:
            x, y = np.concatenate(left), np.concatenate(right)
            yield pa.RecordBatch.from_arrays(
                [pa.array(missing[x]), pa.array(ids[x]), pa.array(missing[y]), pa.array(ids[y])], names=["am", "ai", "bm", "bi"])

    raw = dealt.mapInArrow(tidy(run), "am boolean, ai bigint, bm boolean, bi bigint")
    node = lambda m, i: F.struct(F.col(m).alias("missing"), F.col(i).alias("id"))
    return raw.select(node("am", "ai").alias("a"), node("bm", "bi").alias("b"))


def near_duplicates(docs: DataFrame, width: int = 3, distance: int = 3) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` for every row of ``docs``.

    ``component_id`` is the smallest doc_id among all documents that links reach, the document included.
    Null and word-less texts have fingerprint zero and link like others. Rows that repeat a doc_id give a row
    each. A row without doc_id links others as well; its component_id is null if no document with an id is
    reached. Further columns of ``docs`` are not read. An empty table gives an empty table.

    Equal fingerprints collapse to one row before any comparison. Fingerprints, links and the rounds of the
    component search are written to the shared folder, so a lost executor costs only its running tasks.
    """
    rows = stage(fingerprints(docs, width), "simhash-rows")
    prints = rows.groupBy("fp").agg(F.min("doc_id").alias("id")).select("fp", F.struct(
        F.col("id").isNull().alias("missing"), F.coalesce("id", "fp").alias("id")).alias("node"))
    prints = stage(prints, "simhash-prints")
    roots = connected_components(near_links(prints, distance))
    labels = (prints.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
              .select("fp", F.when(~F.col("root.missing"), F.col("root.id")).alias("component_id")))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(labels, "fp").select("doc_id", digits.alias("fingerprint"), "component_id")


def keep_one_per_group(docs: DataFrame, width: int = 3, distance: int = 3) -> DataFrame:
    """``docs`` without near duplicates: of each group the row of its smallest doc_id stays.

    Rows that repeat a doc_id count as copies, whichever texts they have; the one with the smallest text
    stays. Rows without doc_id cannot be named by a group and stay.
    """
    from pyspark.sql import Window

    heads = near_duplicates(docs.where(F.col("doc_id").isNotNull()), width, distance)
    heads = heads.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    named = docs.where(F.col("doc_id").isNotNull()).withColumn("_place", first).where(F.col("_place") == 1).drop("_place")
    return named.join(heads, "doc_id", "left_semi").select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))
