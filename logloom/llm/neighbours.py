"""Exact nearest neighbours by cosine: int8 product tiles with error bounds, then doubles, then heaps."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..workspace import stage
from .common import tidy

#: Values of a tile's candidate side at least; with the vectors' length this gives the rows of a block.
BLOCK_VALUES = 1 << 20
#: Values of a block of queries, which a task holds, and so many times its rows are a block of candidates, which a task reads in steps.
QUERY_VALUES, CANDIDATES_PER_QUERY = 1 << 23, 4
#: Tiles for each core, where there are rows enough.
TILES_PER_CORE = 4
#: Candidates of a step, pairs whose bounds are in memory at a time, and values that are recomputed in doubles at a time.
STEP_ROWS, PAIRS_AT_ONCE, VALUES_AT_ONCE = 4096, 1 << 21, 1 << 21
#: Tasks of the tiles at most; a task may have several tiles, one after the other.
MOST_TASKS = 10_000
#: A bar below all cosines, until a query has one of its own.
NO_BAR = -4.0


def usable(vector: Column) -> Column:
    """No null, no null or non-finite component, and not all zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf")))
    return vector.isNotNull() & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0)


class _Side:
    """Vectors of one side of a tile, their int8 codes as rounded unit vectors, and what the rounding can change."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        n, dim = vectors.shape
        self.norms, self.size, self.lost = np.empty(n), np.empty(n), np.empty(n)
        #: The codes, two columns of slack and one of bars.
        self.codes = np.zeros((n, dim + 3), np.float32)
        step = max(1, VALUES_AT_ONCE // max(1, dim))
        for a in range(0, n, step):
            part, some = slice(a, a + step), vectors[a:a + step].astype(np.float64)
            norms = np.sqrt((some * some).sum(axis=1))
            scale = np.abs(some).max(axis=1, keepdims=True) / 127
            rounded = np.rint(some / scale).astype(np.int8) * scale
            self.norms[part], self.size[part] = norms, np.sqrt((rounded * rounded).sum(axis=1)) / norms
            self.lost[part] = np.sqrt(((some - rounded) ** 2).sum(axis=1)) / norms
            self.codes[part, :dim] = rounded / norms[:, None]


def _first_copies(ids: np.ndarray, vectors: np.ndarray, copies: int) -> np.ndarray:
    """Positions without those copies of a vector that ``copies`` smaller ids precede: ties never reach them."""
    order = np.argsort(ids, kind="stable")
    rows = np.ascontiguousarray(vectors[order]).view(np.dtype((np.void, vectors.itemsize * vectors.shape[1])))[:, 0]
    _, group = np.unique(rows, return_inverse=True)
    by_group = np.argsort(group, kind="stable")
    starts = np.r_[0, np.flatnonzero(np.diff(group[by_group])) + 1]
    place = np.arange(len(ids)) - np.repeat(starts, np.diff(np.r_[starts, len(ids)]))
    return order[by_group[place < copies]]


class _Best:
    """The ``k`` best candidates of each query of a block, from candidates that come in steps.

    The product of two vectors' int8 codes misses their cosine by no more than the Cauchy-Schwarz bound of what
    rounding took from each. A candidate whose upper bound is below the k-th best score so far (in the first step:
    the k-th best lower bound) is out; the others are scored in doubles. Both parts of the bound and the query's bar
    are columns of the codes, so that one product tells the pairs that stay, those at zero or above, less what single
    precision can miss. Beside the two sides and the ``k`` best, ``PAIRS_AT_ONCE`` pairs are in memory.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.q, self.k, dim = _Side(ids, vectors), k, vectors.shape[1]
        self.q.codes[:, dim], self.q.codes[:, dim + 1] = self.q.lost, self.q.size
        self.bar = np.full(len(ids), NO_BAR)
        self.found, self.scores = np.zeros((len(ids), k), np.int64), np.full((len(ids), k), -np.inf)
        reach = (1 + dim ** 0.5 / 127) ** 2 - NO_BAR
        self.missed = 1e-9 + (dim + 8) * 2.0 ** -23 * reach

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        for a in range(0, len(ids), STEP_ROWS):
            some_ids, some = ids[a:a + STEP_ROWS], vectors[a:a + STEP_ROWS]
            kept = _first_copies(some_ids, some, self.k + 1)
            c, dim = _Side(some_ids[kept], some[kept]), vectors.shape[1]
            c.codes[:, dim], c.codes[:, dim + 1], c.codes[:, dim + 2] = c.size + c.lost, c.lost, 1
            step = max(1, PAIRS_AT_ONCE // len(kept))
            for b in range(0, len(self.q.ids), step):
                self._compare(slice(b, b + step), c)

    def _compare(self, rows: slice, c: _Side) -> None:
        q, dim = self.q, c.vectors.shape[1]
        bar = self.bar[rows]
        if (bar == NO_BAR).any() and len(c.ids) > self.k + 1:
            # The query itself may be one of the best: the next one's lower bound holds without it.
            lower = q.codes[rows, :dim] @ c.codes[:, :dim].T
            lower -= q.lost[rows, None].astype(np.float32) * c.codes[:, dim] + q.size[rows, None].astype(np.float32) * c.codes[:, dim + 1]
            lower[np.isnan(lower)] = NO_BAR
            lower.partition(len(c.ids) - self.k - 1, axis=1)
            bar = np.maximum(bar, lower[:, -self.k - 1] - self.missed)
            del lower
        q.codes[rows, dim + 2] = -bar
        i, j = np.nonzero(q.codes[rows] @ c.codes.T >= -self.missed)
        i += rows.start
        other = q.ids[i] != c.ids[j]
        i, j = i[other], j[other]
        if not len(i):
            return
        score, step = np.empty(len(i)), max(1, VALUES_AT_ONCE // dim)
        for a in range(0, len(i), step):
            x, y = i[a:a + step], j[a:a + step]
            score[a:a + step] = (q.vectors[x].astype(np.float64) * c.vectors[y]).sum(axis=1) / (q.norms[x] * c.norms[y])
        # The best so far of the queries that got candidates, and these.
        asked = np.unique(i)
        held = np.isfinite(self.scores[asked])
        i = np.concatenate([np.repeat(asked, held.sum(axis=1)), i])
        ids = np.concatenate([self.found[asked][held], c.ids[j]])
        score = np.concatenate([self.scores[asked][held], score])
        order = np.lexsort((ids, -score, i))
        i, ids, score = i[order], ids[order], score[order]
        starts = np.r_[0, np.flatnonzero(np.diff(i)) + 1]
        place = np.arange(len(i)) - np.repeat(starts, np.diff(np.r_[starts, len(i)]))
        first = place < self.k
        self.found[i[first], place[first]], self.scores[i[first], place[first]] = ids[first], score[first]
        last = self.scores[asked, -1]
        self.bar[asked] = np.where(np.isfinite(last), last, NO_BAR)

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        held = np.isfinite(self.scores)
        return np.repeat(self.q.ids, held.sum(axis=1)), self.found[held], self.scores[held]


def tile_nearest(q_ids, q_vectors, c_ids, c_vectors, k: int):
    """The ``k`` best candidates of each query of a tile: query ids, candidate ids, scores."""
    best = _Best(q_ids, q_vectors, k)
    best.add(c_ids, c_vectors)
    return best.result()


def _tiles(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The best of each tile, from its rows in order: dim, qb, cb, late (0 for queries, which come first), vec_id, v."""
    now, asked, best = None, [], None

    def done():
        if best is not None:
            query, vec, score = best.result()
            for a in range(0, len(query), STEP_ROWS * k):
                part = slice(a, a + STEP_ROWS * k)
                yield pa.RecordBatch.from_arrays([pa.array(query[part]), pa.array(vec[part]), pa.array(score[part])], names=["query_id", "vec_id", "score"])

    for batch in batches:
        keys = np.stack([batch.column(x).to_numpy(zero_copy_only=False) for x in range(4)], axis=1)
        starts = np.r_[0, np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, len(keys)] if len(keys) else []
        for start, stop in zip(starts[:-1], starts[1:]):
            tile, late = tuple(keys[start, :3]), keys[start, 3]
            if tile != now:
                yield from done()
                now, asked, best = tile, [], None
            part = batch.slice(start, stop - start)
            ids = part.column(4).to_numpy()
            values = part.column(5).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            if not late:
                asked.append((ids, values))
                continue
            if asked:
                best = _Best(np.concatenate([x for x, _ in asked]), np.concatenate([x for _, x in asked]), k)
                asked = []
            if best is not None:
                best.add(ids, values)
    yield from done()


def nearest(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``k`` nearest rows of every row that ``is_query`` marks.

    ``vectors`` has ``vec_id`` and ``embedding`` (numbers). Every row but the query's own is a candidate;
    ties go to the smaller vec_id. Vectors that are null, zero, or hold a null or non-finite component take
    no part, nor do rows without vec_id; vectors of another length aren't compared. A repeated vec_id counts
    once, with its smallest vector. Further columns are not read; an empty table gives an empty table.

    Candidates and queries are dealt into blocks by a hash of their id, and each pair of a query block and a candidate
    block is one tile. A task holds a tile's queries, a bounded number, and reads its candidates in steps; the tile
    returns ``k`` rows per query, which heaps merge. Rows travel once for each block of the other side: query blocks are
    as large as a task can hold, and candidate blocks several times as large unless cores would be idle.
    """
    # Single precision travels as it is, and a pair becomes double when it is scored, without a change of value.
    single = vectors.schema["embedding"].dataType == T.ArrayType(T.FloatType(), vectors.schema["embedding"].dataType.containsNull)
    rows = vectors.select("vec_id", F.col("embedding").cast("array<float>" if single else "array<double>").alias("v"), is_query.alias("asks"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("v"))).groupBy("vec_id").agg(
        F.min(F.struct("v", "asks")).alias("r")).select("vec_id", "r.v", "r.asks")
    rows = stage(rows.withColumn("dim", F.size("v")), "vectors")
    sizes = rows.groupBy("dim").agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).where("q > 0")
    rows_of = lambda values: F.greatest(F.lit(64), F.floor(F.lit(values) / F.col("dim")))
    blocks = lambda n, size: F.ceil(F.col(n) / size).cast("int")
    held, least = rows_of(QUERY_VALUES), rows_of(BLOCK_VALUES)
    wide = F.greatest(least, CANDIDATES_PER_QUERY * F.least("q", held))
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    sizes = sizes.select("dim", F.greatest(blocks("n", wide), F.least(blocks("n", least), F.lit(TILES_PER_CORE * cores))).alias("c_blocks"),
                         blocks("q", held).alias("q_blocks"))
    tiles = sizes.agg(F.coalesce(F.sum(F.col("q_blocks").cast("long") * F.col("c_blocks")), F.lit(0)).alias("n")).first()["n"]
    own = lambda blocks: F.pmod(F.xxhash64("vec_id"), F.col(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    dealt = rows.join(sizes, "dim")
    tile = ["dim", own("q_blocks").alias("qb"), own("c_blocks").alias("cb")]
    sides = dealt.select(tile[0], every("q_blocks").alias("qb"), tile[2], F.lit(1).alias("late"), "vec_id", "v")
    sides = sides.unionByName(dealt.where("asks").select(*tile[:2], every("c_blocks").alias("cb"), F.lit(0).alias("late"), "vec_id", "v"))
    spread = sides.repartition(min(max(1, tiles), MOST_TASKS), "dim", "qb", "cb").sortWithinPartitions("dim", "qb", "cb", "late")
    found = spread.mapInArrow(tidy(lambda batches: _tiles(batches, k)), "query_id bigint, vec_id bigint, score double")

    def merged(batches):
        now, heap = None, []

        def best():
            ranked = sorted(heap, key=lambda x: (-x[0], -x[1]))
            n = len(ranked)
            return pa.RecordBatch.from_arrays(
                [pa.array([now] * n, pa.int64()), pa.array(range(1, n + 1), pa.int32()), pa.array([-x[1] for x in ranked], pa.int64()),
                 pa.array([x[0] for x in ranked], pa.float64())], names=["query_id", "rank", "vec_id", "score"])

        for batch in batches:
            for query, vec, score in zip(*(batch.column(x).to_pylist() for x in range(3)), strict=True):
                if query != now:
                    if heap:
                        yield best()
                    now, heap = query, []
                if len(heap) < k:
                    heapq.heappush(heap, (score, -vec))
                else:
                    heapq.heappushpop(heap, (score, -vec))
        if heap:
            yield best()

    dealt_out = found.repartition("query_id").sortWithinPartitions("query_id")
    return dealt_out.mapInArrow(tidy(merged), "query_id bigint, rank int, vec_id bigint, score double")
