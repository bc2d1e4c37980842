"""Near-copies among documents: SimHash fingerprints and MinHash bands make candidates, exact Jaccard similarity of word shingles decides."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..workspace import stage
from . import simhash
from .common import arrow_pass, raw_bytes, slices, tidy

SEED = 42
#: Bands of minima. A pair at similarity 0.8 misses all of them with probability (1 - 0.8^4)^32 = 5e-8.
BANDS, ROWS = 32, 4
#: Bits in which the 128-bit sketches of a candidate pair may differ; 12.8 are expected at similarity 0.8, 34 or more have probability 2e-7.
SKETCH_BITS = 33
#: Rows of one key that a task compares; longer keys are cut into chunks and compared chunk by chunk.
CHUNK = 8192
#: The same where the rows hold whole shingle sets.
SET_CHUNK = 256
#: Shingle hashes whose minima are taken at a time.
HASHES_AT_ONCE = 2048

_rng = np.random.default_rng(SEED)
_FLIP = _rng.integers(0, 1 << 64, BANDS * ROWS, np.uint64)[:, None]
_TIMES = (_rng.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1))[:, None]


def shingles(text: bytes | None, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a UTF-8 text's lower-cased word shingles.

    Words are what ASCII white space separates. Fewer than ``width`` words make one shingle; none give no hash.
    """
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    width = min(width, len(words))
    digest, join = xxhash.xxh64_intdigest, b" ".join
    n = len(words) - width + 1
    hashes = (digest(join(s), SEED) for s in zip(*(words[i:] for i in range(width)), strict=False))
    return np.unique(np.fromiter(hashes, np.uint64, n))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The MinHash values (32 bits each) of a set that is not empty."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(hashes), HASHES_AT_ONCE):
        np.minimum(least, ((hashes[start:start + HASHES_AT_ONCE] ^ _FLIP) * _TIMES).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def _prints(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, digest of the shingle set (hi, lo), its size n, SimHash fingerprint fp, sketch (s0, s1) and band keys, a row per row."""

    def run(batches):
        for part in slices(batches):
            found = []
            for text in raw_bytes(part):
                own = shingles(text, width)
                digest = np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), np.int64).tolist()
                if not len(own):
                    found.append((*digest, 0, 0, 0, 0, []))
                    continue
                least = minima(own)
                sketch = np.packbits((least & 1).astype(np.uint8)).view(np.int64).tolist()
                raw, step = least.tobytes(), 4 * ROWS
                keys = np.array([xxhash.xxh64_intdigest(raw[b * step:(b + 1) * step], b) for b in range(BANDS)], np.uint64)
                print_ = np.array(simhash.majority(own[i:i + simhash.HASHES_AT_ONCE] for i in range(0, len(own), simhash.HASHES_AT_ONCE)), np.uint64).view(np.int64).item()
                found.append((*digest, len(own), print_, *sketch, keys.view(np.int64)))
            kinds = [pa.int64()] * 6 + [pa.list_(pa.int64())]
            columns = list(zip(*found, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))],
                                             names=["doc_id", "hi", "lo", "n", "fp", "s0", "s1", "keys"])

    return arrow_pass(docs, ["doc_id", "text"], run, "doc_id bigint, hi bigint, lo bigint, n bigint, fp bigint, s0 bigint, s1 bigint, keys array<bigint>")


def _fingerprint_links(prints: DataFrame, distance: int) -> DataFrame:
    """Links ``a``, ``b`` that span what fingerprints of at most ``distance`` differing bits connect.

    Documents of one fingerprint hang on the one of the smallest doc_id.
    """
    prints = prints.where("n > 0").select("doc_id", "fp")
    first = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "similar-fingerprints")
    same = prints.join(first, "fp").where(F.col("doc_id") != F.col("first")).select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    node = F.struct(F.lit(False).alias("missing"), F.col("first").alias("id")).alias("node")
    near = simhash.near_links(first.select("fp", node), distance)
    return same.unionByName(near.select(F.col("a.id").alias("a"), F.col("b.id").alias("b")))


def _dealt(rows: DataFrame, most: int) -> DataFrame:
    """``rows`` by ``key``, keys of over ``most`` rows by pairs of chunks (i, j), so that each two rows of a key meet in a task."""
    long_keys = rows.groupBy("key").count().where(F.col("count") > most).select("key", F.ceil(F.col("count") / most).cast("int").alias("chunks"))
    own = F.pmod(F.xxhash64("doc_id"), F.col("chunks")).cast("int")
    group = ["key", "i", "j"]
    return (rows.join(long_keys, "key", "left")
            .withColumn("own", F.when(F.col("chunks").isNull(), 0).otherwise(own))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)))
            .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), *[c for c in rows.columns if c != "key"])
            .repartition(*group).sortWithinPartitions(*group))


def _links(dealt: DataFrame, bar: float) -> DataFrame:
    """Links ``a``, ``b`` that span, in each group of (key, i, j), what close pairs connect.

    Rows are close if sizes and sketches allow ``bar`` and, where there is a column ``hashes``, if the sets have that similarity.
    """
    exact = "hashes" in dealt.columns

    def close(first, others, n, s0, s1, sets):
        size = n[others]
        near = np.bitwise_count(s0[others] ^ s0[first]).astype(int) + np.bitwise_count(s1[others] ^ s1[first]) <= SKETCH_BITS
        near &= np.minimum(size, n[first]) >= bar * np.maximum(size, n[first])
        if exact:
            own = sets[first]
            for i in np.flatnonzero(near):
                other = sets[others[i]]
                place = own.searchsorted(other)
                place[place == len(own)] = 0
                common = np.count_nonzero(own[place] == other)
                near[i] = common >= bar * (len(own) + len(other) - common)
        return near

    def links_of(table):
        """A row that is reached leaves the search, so a dense group costs one comparison per member, not one per pair."""
        key, i, j, ids, n, s0, s1 = (table.column(c).to_numpy() for c in ("key", "i", "j", "doc_id", "n", "s0", "s1"))
        s0, s1 = s0.view(np.uint64), s1.view(np.uint64)
        sets = [np.frombuffer(b.as_buffer(), np.uint64) for b in table.column("hashes")] if exact else None
        changed = (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        cuts = np.concatenate([[0], np.flatnonzero(changed) + 1, [len(key)]])
        left, right = [], []
        for g in np.flatnonzero(np.diff(cuts) > 1):
            open_ = np.arange(cuts[g], cuts[g + 1])
            while len(open_) > 1:
                first, open_ = open_[0], open_[1:]
                waiting = [first]
                while waiting and len(open_):
                    near = close(waiting.pop(), open_, n, s0, s1, sets)
                    if near.any():
                        hits, open_ = open_[near], open_[~near]
                        left.append(np.full(len(hits), ids[first]))
                        right.append(ids[hits])
                        waiting.extend(hits)
        if left:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["a", "b"])

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            last = [held.column(c).to_numpy() for c in ("key", "i", "j")]
            begin = len(held) - int(np.argmin(np.r_[np.all([c == c[-1] for c in last], axis=0)[::-1], False])) if len(held) else 0
            if begin:
                yield from links_of(held.slice(0, begin))
                held = held.slice(begin)
        if held is not None and len(held):
            yield from links_of(held)

    return dealt.mapInArrow(tidy(run), "a bigint, b bigint")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """``docs`` (key, doc_id, n, s0, s1, text) with the text's hashes in its place."""
    names = ["key", "doc_id", "n", "s0", "s1"]

    def run(batches):
        for part in slices(batches):
            sets = pa.array([shingles(t, width).tobytes() for t in raw_bytes(part)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in names), sets], names=[*names, "hashes"])

    return arrow_pass(docs, [*names, "text"], run, "key bigint, doc_id bigint, n bigint, s0 bigint, s1 bigint, hashes binary")


def _near_first(sets: DataFrame, bar: float) -> DataFrame:
    """(key, doc_id) of members of a group of candidates whose set is similar to that of the group's first document."""
    firsts = sets.where(F.col("doc_id") == F.col("key")).select(
        "key", F.col("n").alias("m"), F.col("s0").alias("t0"), F.col("s1").alias("t1"), F.col("hashes").alias("first"))
    bits = F.bit_count(F.col("s0").bitwiseXOR(F.col("t0"))) + F.bit_count(F.col("s1").bitwiseXOR(F.col("t1")))
    likely = (bits <= SKETCH_BITS) & (F.least("n", "m") >= bar * F.greatest("n", "m"))
    met = sets.where(F.col("doc_id") != F.col("key")).join(firsts, "key").where(likely)

    def run(batches):
        for part in slices(batches):
            near = []
            for own, first in zip(part.column(2), part.column(3), strict=True):
                own, first = np.frombuffer(own.as_buffer(), np.uint64), np.frombuffer(first.as_buffer(), np.uint64)
                common = np.intersect1d(own, first, assume_unique=True).size
                near.append(common >= bar * (len(own) + len(first) - common))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["key", "doc_id"]).filter(pa.array(near, pa.bool_()))

    return arrow_pass(met, ["key", "doc_id", "hashes", "first"], run, "key bigint, doc_id bigint")


def _left_to_meet(sets: DataFrame, near: DataFrame) -> DataFrame:
    """Rows of ``sets`` by tiles (i, j) in which every pair meets that the links to the first documents leave open.

    Members near the first document are connected, so they need not meet each other, only the others; a group
    without others has no tile. Chunks of others are numbered from 0, chunks of the near ones from -1 down.
    """
    status = sets.select("key", "doc_id").join(near.withColumn("near", F.lit(True)), ["key", "doc_id"], "left").select(
        "key", "doc_id", (F.col("near").isNotNull() | (F.col("doc_id") == F.col("key"))).alias("near"))
    status = stage(status, "similar-status")
    chunks = status.groupBy("key").agg(F.ceil(F.count_if(~F.col("near")) / SET_CHUNK).cast("int").alias("others"),
                                       F.ceil(F.count_if("near") / SET_CHUNK).cast("int").alias("nears")).where("others > 0")
    own = F.pmod(F.xxhash64("doc_id"), F.when(F.col("near"), F.col("nears")).otherwise(F.col("others"))).cast("int")
    # A tile of others with near ones holds all pairs of its others too.
    tiles = F.when(F.col("near"), F.expr("transform(sequence(0, others - 1), i -> struct(i as i, -1 - own as j))")).otherwise(F.expr("""concat(
        transform(sequence(0, nears - 1), l -> struct(own as i, -1 - l as j)),
        transform(filter(sequence(0, others - 1), o -> o <> own), o -> struct(least(own, o) as i, greatest(own, o) as j)))"""))
    dealt = status.join(chunks, "key").withColumn("own", own).select("doc_id", F.explode(tiles).alias("tile")).select("doc_id", "tile.i", "tile.j")
    group = ["key", "i", "j"]
    return sets.join(dealt, "doc_id").repartition(*group).sortWithinPartitions(*group)


def keep_one_per_group(docs: DataFrame, width: int = 5, bar: float = 0.8, distance: int = 3) -> DataFrame:
    """``docs`` without near-copies: of the documents that links reach, the one of the smallest doc_id stays.

    Two documents are linked if the Jaccard similarity of their sets of word shingles is ``bar`` or more. Equal
    sets collapse first. Others are candidates if their SimHash fingerprints differ in at most ``distance`` bits, or, as a
    pair at the bar differs in some ten bits, if they share a band of minima and their sketches are near;
    within the components of candidates the sets decide: first of each member and the component's first document,
    then of every pair that could still connect something, so a group of copies of one text is settled in one pass.
    Of rows that repeat a doc_id the one with the smallest text stays. Rows without doc_id stay.
    """
    named = docs.where(F.col("doc_id").isNotNull())
    if not named.groupBy("doc_id").count().where("count > 1").isEmpty():
        first = F.min_by(F.struct(*docs.columns), F.struct(F.col("text").isNotNull(), "text"))
        named = stage(named.groupBy("doc_id").agg(first.alias("row")).select("row.*"), "similar-named")
        docs = named.unionByName(docs.where(F.col("doc_id").isNull()))
    rows = stage(_prints(named, width), "similar-prints")
    smallest = stage(rows.groupBy("hi", "lo").agg(F.min("doc_id").alias("doc_id")), "similar-sets").select("doc_id")
    prints = rows.join(smallest, "doc_id", "left_semi")
    banded = prints.select(F.explode("keys").alias("key"), "doc_id", "n", "s0", "s1")
    candidates = _fingerprint_links(prints, distance).unionByName(_links(_dealt(banded, CHUNK), bar))
    groups = connected_components(candidates).select(F.col("node").alias("doc_id"), F.col("root").alias("key"))
    members = groups.join(rows.select("doc_id", "n", "s0", "s1"), "doc_id")
    sets = stage(_sets(named.select("doc_id", "text").join(members, "doc_id"), width), "similar-members")
    near = stage(_near_first(sets, bar), "similar-near")
    links = _links(_left_to_meet(sets, near), bar).unionByName(near.select(F.col("key").alias("a"), F.col("doc_id").alias("b")))
    roots = connected_components(links)
    gone = rows.join(smallest, "doc_id", "left_anti").select("doc_id").unionByName(
        roots.where("node > root").select(F.col("node").alias("doc_id")))
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
