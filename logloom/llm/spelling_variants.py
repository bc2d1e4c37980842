"""Spelling variants: words one code point apart, found through pairs of trie nodes, and the form each stands for.

Words are numbered into two tries, one of the words and one of the reversed words. A node's number says which
beginning (or end) a word has, so two integers name a word but for one position: (node before it, node after
it). Words that share such a pair differ there alone; a word whose pair without a gap equals it lacks the position.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import takewhile
from zlib import crc32

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..workspace import stage
from .common import append_columns, arrow_pass, raw_bytes, slices, strings

#: Distinct words that a task counts before it hands on what it has.
COUNTED_WORDS = 300_000
#: One in so many words of a document loses a code point.
LOSS = 97
SHORTEST = 5


def words_of(doc_id: int | None, text: bytes | None, loss: int = LOSS, shortest: int = SHORTEST) -> Counter:
    """Words of a UTF-8 text and how often they occur: runs of Latin letters, A-Z lower-cased.

    The CRC-32 of ``<doc_id>:<run>`` decides whether a run loses a code point, and which. Without an id none does.
    """
    runs = re.findall("[a-zÀ-ÿ]{%d,}" % shortest, (text or b"").lower().decode())
    if doc_id is None:
        return Counter(runs)
    found, begin = Counter(), crc32(b"%d:" % doc_id)
    for run, n in Counter(runs).items():
        h = crc32(run.encode(), begin)
        if h % loss == 0:
            run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) < shortest:
                continue
        found[run] += n
    return found


def word_counts(docs: DataFrame, least: int = 3, loss: int = LOSS, shortest: int = SHORTEST, counted: int = COUNTED_WORDS) -> DataFrame:
    """``word`` and ``n`` of the words with ``least`` occurrences or more; counted in tasks first, then together."""

    def run(batches):
        seen = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

        for part in slices(batches):
            for doc_id, text in zip(part.column(part.schema.get_field_index("doc_id")).to_pylist(), raw_bytes(part), strict=True):
                for word, n in words_of(doc_id, text, loss, shortest).items():
                    seen[word] += n
            if len(seen) > counted:
                yield out()
                seen.clear()
        if seen:
            yield out()

    found = arrow_pass(docs, ["doc_id", "text"], run, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _shared(a: str, b: str) -> int:
    """Length of the common beginning."""
    if b.startswith(a):
        return len(a)
    return sum(1 for _ in takewhile(lambda p: p[0] == p[1], zip(a, b, strict=False)))


def number_paths(words: DataFrame, column: str, name: str) -> DataFrame:
    """``words`` with ``name``: the numbers of the nodes from the root to the end of ``column``'s path in its trie.

    Distinct words, range-partitioned and sorted, meet every node of the trie in one unbroken stretch. A node is
    numbered by the place of its last character in all sorted words laid end to end, where its stretch begins; so
    words share a number exactly if they share that beginning, and the last numbers rise with the words. Each
    task numbers its own stretch. Nodes that began in an earlier partition lie on the path of that partition's
    last word: one row per partition (first word, last path, length) is folded on the driver, in order, and
    joined back. A path has one number per character and one for the root.
    """
    carried = list(words.columns)

    def run(batches):
        part, before, path, start, lead = TaskContext.get().partitionId(), None, [], 0, 0
        for batch in slices(batches, 4096):
            paths, leads, ends = [], [], []
            for word in strings(batch, column):
                shared = -1 if before is None else _shared(before, word)
                lead = len(word) if before is None else min(lead, shared)
                path = path[:shared + 1] + list(range(start + shared + 1, start + len(word) + 1))
                start += len(word) + 1
                before = word
                paths.append(path)
                leads.append(lead)
                ends.append(start)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(paths, pa.list_(pa.int64())), pa.array(leads, pa.int32()), pa.array(ends, pa.int64()),
                 pa.array([part] * batch.num_rows, pa.int32())], names=[*batch.schema.names, name, "_lead", "_end", "_part"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in words.schema.fields)
    ordered = words.repartitionByRange(column).sortWithinPartitions(column)
    local = stage(arrow_pass(ordered, carried, run, f"{types}, `{name}` array<bigint>, _lead int, _end bigint, _part int"), "trie-paths")
    edges = local.groupBy("_part").agg(F.min(column).alias("first"), F.max(F.struct(column, name, "_lead")).alias("last"), F.max("_end").alias("size"))
    rows, base, path, last = [], 0, [], None
    for edge in sorted(edges.collect(), key=lambda e: e["_part"]):
        path = path[:_shared(last, edge["first"]) + 1] if last is not None else []
        rows.append((edge["_part"], base, path))
        last, own, lead = edge["last"]
        known = min(lead + 1, len(path))
        path = path[:known] + [base + x for x in own[known:]]
        base += edge["size"]
    # Bounded: one row per partition of the sort.
    bounds = F.broadcast(local.sparkSession.createDataFrame(rows, "_part int, _base bigint, _path array<bigint>"))
    known = F.least(F.col("_lead") + 1, F.size("_path"))
    own = F.transform(F.slice(name, known + 1, F.size(name)), lambda x: x + F.col("_base"))
    return local.join(bounds, "_part").select(*carried, F.concat(F.slice("_path", F.lit(1), known), own).alias(name))


def near_words(words: DataFrame) -> DataFrame:
    """``words`` (``word``, ``n``, one row each) with ``id``, ``n_near`` and ``best`` (struct n, minus: minus the id).

    ``id`` rises with the word's code points. ``best`` is the near word of largest ``n``, of these the first; null
    without near words. A word has a pair of nodes for each position it may lack, and one for each place between
    two positions. Words that share a pair with a gap are all near each other; a word without the gap is near all
    whose gap is the first of equal neighbours, so every two near words meet in one pair only. The words of a pair
    differ in one code point: there are at most as many as the alphabet has, and one. They are not paired with
    each other; each is told how many the others are and which is the best.
    """
    fresh = T.StructField("fresh", T.ArrayType(T.BooleanType()))
    marked = append_columns(words.select("word", "n"), lambda part: [pa.array(
        [[a != b for a, b in zip(w, f"\0{w}", strict=False)] for w in strings(part, "word")], pa.list_(pa.bool_()))], [fresh])
    forward = number_paths(marked, "word", "ahead").withColumn("mirrored", F.reverse("word"))
    both = number_paths(forward, "mirrored", "back").withColumn("id", F.element_at("ahead", -1))
    both = stage(both.select("word", "n", "id", "ahead", "back", "fresh"), "trie-pairs")
    pairs = both.select("id", "n", F.explode(F.expr("""concat(
        transform(sequence(0, size(fresh)), i -> struct(ahead[i] as p, back[size(fresh) - i] as s, null as fresh)),
        transform(sequence(0, size(fresh) - 1), i -> struct(ahead[i] as p, back[size(fresh) - 1 - i] as s, fresh[i] as fresh)))""")).alias("at"))
    who = F.struct("n", (-F.col("id")).alias("minus"))
    # Bounded: as many members as letters of the alphabet, and the one word without the gap.
    met = pairs.groupBy("at.p", "at.s").agg(
        F.sort_array(F.collect_list(F.when(F.col("at.fresh").isNotNull(), F.struct("n", (-F.col("id")).alias("minus"), "at.fresh"))), False).alias("gap"),
        F.max(F.when(F.col("at.fresh").isNull(), who)).alias("whole"),
        F.count("*").alias("members")).where("members > 1")
    told = met.select(F.explode(F.expr("""concat(
        transform(gap, (m, i) -> struct(m.minus as minus,
            size(gap) - 1 + int(m.fresh and whole is not null) as near,
            array_max(array(if(m.fresh, whole, null), if(i = 0, if(size(gap) > 1, struct(gap[1].n as n, gap[1].minus as minus), null),
                                                         struct(gap[0].n as n, gap[0].minus as minus)))) as best)),
        if(whole is null, array(), array(struct(whole.minus as minus, size(filter(gap, m -> m.fresh)) as near,
            array_max(transform(filter(gap, m -> m.fresh), m -> struct(m.n as n, m.minus as minus))) as best))))""")).alias("one"))
    found = told.groupBy((-F.col("one.minus")).alias("id")).agg(F.sum("one.near").alias("n_near"), F.max("one.best").alias("best"))
    return both.select("word", "n", "id").join(found, "id", "left").select("word", "n", "id", F.coalesce("n_near", F.lit(0)).alias("n_near"), "best")


def _roots(links: DataFrame) -> DataFrame:
    """``id`` and ``up`` with every ``up`` followed to the last: each round doubles the way, and ways are short.

    A form has at least twice the occurrences, so no way is longer than the binary logarithm of the largest count.
    """
    links = stage(links, "forms")
    while True:
        above = links.select(F.col("id").alias("up"), F.col("up").alias("further"))
        if links.join(above, "up", "left_semi").isEmpty():
            return links
        links = stage(links.join(above, "up", "left").select("id", F.coalesce("further", "up").alias("up")), "forms")


def group_variants(words: DataFrame, factor: int = 2) -> DataFrame:
    """``words`` (``word``, ``n``) with form, root, n_near, form_n.

    The form of a word is its near word of largest ``n``, of these the first by code points, if that has ``factor``
    times the word's ``n`` or more; else null. The root is the last word that forms lead to, or the word itself.
    Rows of one word are added up; null and empty words are left out. Further columns aren't read.
    """
    if factor < 2:
        raise ValueError("forms must be at least twice as frequent, so that ways to a root are short")
    distinct = words.where(F.length("word") > 0).groupBy("word").agg(F.sum("n").alias("n"))
    near = stage(near_words(distinct), "near-words")
    led = F.col("best.n") >= factor * F.col("n")
    near = near.select("word", "n", "id", "n_near", F.when(led, -F.col("best.minus")).alias("form_id"))
    roots = _roots(near.where("form_id is not null").select("id", F.col("form_id").alias("up")))
    named = lambda column, *new: near.select(F.col("id").alias(column), *[F.col(a).alias(b) for a, b in new])
    out = (near.join(roots.withColumnRenamed("up", "root_id"), "id", "left")
           .join(named("form_id", ("word", "form"), ("n", "form_n")), "form_id", "left").join(named("root_id", ("word", "root")), "root_id", "left"))
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, least: int = 3, loss: int = LOSS, shortest: int = SHORTEST, factor: int = 2,
                      counted: int = COUNTED_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of all texts (columns ``doc_id`` and ``text``).

    Null, empty and blank texts have no words; a document without id loses no code points; repeated rows count
    each. Further columns aren't read. An empty table gives an empty table. A word of any length is whole; it takes
    memory in proportion to its length.
    """
    return group_variants(stage(word_counts(docs, least, loss, shortest, counted), "words"), factor)
