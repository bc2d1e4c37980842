"""Attack chains: threats joined through shared events.

A threat opens a chain unless an earlier chain opener shares one of its events; every
other threat joins the earliest opener it shares an event with. The work is done on
(threat, event) rows with minimum aggregates, so an event named by very many threats never
expands into threat pairs. Inputs carry ``idx``, an integer that orders the threats.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.severity import severity_rank
from ..workspace import stage
from .components import connected_components
from .ordering import with_ordinal


#: (threat, event) rows of a component that one task decides at a time.
STRETCH_ROWS = 1_000_000


def _decide(rows: pd.DataFrame) -> pd.DataFrame:
    """Openers of one stretch, threats in order."""
    claimed: set = set()
    opened = []
    for idx, group in rows.sort_values("idx").groupby("idx", sort=False):
        events = set(group["event_id"])
        if not events & claimed:
            opened.append(idx)
            claimed |= events
    return pd.DataFrame({"idx": pd.Series(opened, dtype="int64")})


def _stretches(undecided: DataFrame) -> DataFrame:
    """Rows with the ``root`` of their component and ``step``, the number of their stretch in it.

    Stretches follow the order of the threats and hold ``STRETCH_ROWS`` rows or a little more; a threat with
    more events than that is a stretch of its own. Places come from one distributed sort.
    """
    roots = connected_components(_sharing(undecided))
    grouped = undecided.join(roots.select(F.col("node").alias("idx"), "root"), "idx", "left").select(
        F.coalesce("root", "idx").alias("root"), "idx", "event_id")
    placed = stage(with_ordinal(grouped, ["root", "idx", "event_id"]), "chain-places")
    threats = placed.groupBy("root", "idx").agg(F.min("ord").alias("start"), F.count("*").alias("rows"))
    begins = placed.groupBy("root").agg(F.min("ord").alias("begin"))
    large = (F.col("rows") > STRETCH_ROWS).cast("int")
    step = (F.floor((F.col("start") - F.col("begin")) / STRETCH_ROWS) * 2 + large).cast("long")
    steps = threats.join(begins, "root").select("idx", step.alias("step"))
    return stage(placed.select("root", "idx", "event_id").join(steps, "idx"), "chain-stretches")


def _ordered_openers(undecided: DataFrame) -> list[DataFrame]:
    """Openers of components, stretch by stretch; the stretches of all components with one number in one job.

    Threats on an event that an earlier stretch claimed are settled. The others of a stretch are decided in order by
    one task. A threat alone in its stretch opens a chain, and its events are never gathered. So there are as
    many jobs as the largest component has stretches, and a task holds one stretch.
    """
    placed = _stretches(undecided)
    claims, found = undecided.select("event_id").limit(0), []
    for step in sorted(r["step"] for r in placed.select("step").distinct().collect()):
        part = placed.where(F.col("step") == step)
        settled = part.join(claims, "event_id", "left_semi").select("idx").distinct()
        rest = stage(part.join(settled, "idx", "left_anti"), "chain-rest")
        threats = rest.select("root", "idx").distinct()
        several = threats.groupBy("root").agg(F.count("*").alias("n")).where("n > 1").select("root")
        alone = threats.join(several, "root", "left_anti").select("idx")
        decided = rest.join(several, "root", "left_semi").groupBy("root").applyInPandas(_decide, "idx long")
        opened = stage(alone.unionByName(decided), "chain-heads")
        found.append(opened)
        claims = claims.unionByName(stage(rest.join(opened, "idx", "left_semi").select("event_id").distinct(), "chain-claims"))
    return found


def _openers(edges: DataFrame) -> DataFrame:
    """Chain openers among the threats that have events.

    First, a threat that is the first one on all its events opens a chain, and every other threat on those
    events is settled as a member; that settles nearly all rows. What remains falls into components that
    share no event, and these are decided in the order of their threats, all at the same time.
    """
    opened, undecided = _round(stage(edges, "chain-edges"))
    heads = opened
    if not undecided.isEmpty():
        for part in _ordered_openers(undecided):
            heads = heads.unionByName(part)
    return heads


def _round(undecided: DataFrame) -> tuple[DataFrame, DataFrame]:
    first = undecided.groupBy("event_id").agg(F.min("idx").alias("idx"))
    leads = first.groupBy("idx").agg(F.count("*").alias("leading"))
    degree = undecided.groupBy("idx").agg(F.count("*").alias("degree"))
    opened = stage(leads.join(degree, "idx").filter(F.col("leading") == F.col("degree")).select("idx"), "chain-heads")
    claimed = undecided.join(opened, "idx", "left_semi").select("event_id").distinct()
    settled = undecided.join(claimed, "event_id", "left_semi").select("idx").distinct()
    return opened, stage(undecided.join(settled, "idx", "left_anti"), "chain-edges")


def assign_chains(threats: DataFrame, links: DataFrame) -> DataFrame:
    """(idx, head): the chain of every threat, named by the ``idx`` of its opener."""
    edges = links.select("idx", "event_id").distinct()
    heads = _openers(edges)
    # Openers share no event, so an event belongs to at most one of them.
    claims = edges.join(heads, "idx", "left_semi").select("event_id", F.col("idx").alias("head"))
    joined = edges.join(claims, "event_id").groupBy("idx").agg(F.min("head").alias("head"))
    return threats.select("idx").join(joined, "idx", "left").select("idx", F.coalesce("head", "idx").alias("head"))


def connected_chains(threats: DataFrame, links: DataFrame) -> DataFrame:
    """(idx, head) by transitive sharing: the smallest ``idx`` of the connected component.

    Threats of an event hang on the event's first threat, so an event named by very many threats is a
    star and not a clique; the components come from star contraction.
    """
    roots = connected_components(_sharing(stage(links.select("idx", "event_id").distinct(), "component-edges")))
    known = roots.select(F.col("node").alias("idx"), F.col("root").alias("head"))
    return threats.select("idx").join(known, "idx", "left").select("idx", F.coalesce("head", "idx").alias("head"))


def _sharing(edges: DataFrame) -> DataFrame:
    """Edges ``a``, ``b`` between each threat and the first threat on each of its events."""
    lowest = stage(edges.groupBy("event_id").agg(F.min("idx").alias("a")), "event-first")
    return edges.join(lowest, "event_id").where(F.col("idx") != F.col("a")).select("a", F.col("idx").alias("b"))


def number_chains(assignment: DataFrame) -> DataFrame:
    """(head, chain_no, chain_id): chains counted from 1 in the order of their openers."""
    numbered = with_ordinal(assignment.select("head").distinct(), ["head"], "chain_no")
    return numbered.select(
        "head", (F.col("chain_no") + 1).alias("chain_no"),
        F.concat(F.lit("chain-"), F.col("chain_no") + 1).alias("chain_id"),
    )


def chain_threats(assignment: DataFrame, threats: DataFrame, chains: DataFrame) -> DataFrame:
    """Link table chain -> threat, with the threat columns."""
    return threats.join(assignment, "idx").join(chains, "head").withColumn("is_head", F.col("idx") == F.col("head"))


def chain_events(members: DataFrame, links: DataFrame) -> DataFrame:
    """Link table chain -> event."""
    return links.join(members.select("idx", "chain_no"), "idx").select("chain_no", "event_id").distinct()


def chain_patterns(events_of_chains: DataFrame, pattern_links: DataFrame) -> DataFrame:
    """A pattern belongs to every chain whose events it meets.

    An event lies in few chains (members of different chains may share it), and chain and
    pattern meet through single events, never as pairs of whole sets.
    """
    return events_of_chains.join(pattern_links, "event_id").select("chain_no", "pattern_id").distinct()


def sets_meet(left: DataFrame, right: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """Pairs of sets with at least one event in common, and how many."""
    return left.join(right, "event_id").groupBy(left_id, right_id).agg(F.count("*").alias("shared_events"))


def chain_headers(members: DataFrame, events_of_chains: DataFrame, patterns_of_chains: DataFrame) -> DataFrame:
    """One row per chain: highest severity label and sizes."""
    label = F.coalesce("severity", F.lit("Low"))
    # The opener's label stands unless a member has a higher rank; first such member wins.
    best = F.min_by(label, F.struct(-severity_rank(label), F.col("idx")))
    base = members.groupBy("chain_no", "chain_id").agg(
        best.alias("severity"), F.count("*").alias("threat_count"))
    events = events_of_chains.groupBy("chain_no").agg(F.count("*").alias("event_count"))
    patterns = patterns_of_chains.groupBy("chain_no").agg(F.count("*").alias("pattern_count"))
    zero = F.lit(0).cast("long")
    return base.join(events, "chain_no", "left").join(patterns, "chain_no", "left").select(
        "chain_no", "chain_id", "severity", "threat_count",
        F.coalesce("event_count", zero).alias("event_count"),
        F.coalesce("pattern_count", zero).alias("pattern_count"),
    )


def by_severity(chains: DataFrame) -> DataFrame:
    return chains.orderBy(severity_rank(F.col("severity")).desc(), "chain_no")


def first_chains(chains: DataFrame, n: int = 5) -> DataFrame:
    return by_severity(chains).limit(n)


#: Sets per block of a hot event; every two blocks of one event meet in a task of their own.
EVENT_BLOCK = 20_000


def _distinct_sets(unique: DataFrame, id_column: str) -> DataFrame:
    """(id, set_id, size): findings with the same events share a ``set_id``, the smallest of their ids.

    Two hash sums and the size bring equal sets together; that they are equal is then confirmed event by event.
    A set that only looked equal keeps its own id.
    """
    marks = unique.groupBy(id_column).agg(
        F.count("*").alias("size"),
        F.sum(F.xxhash64("event_id").cast("decimal(38,0)")).alias("sum_a"),
        F.sum(F.xxhash64(F.lit("b"), "event_id").cast("decimal(38,0)")).alias("sum_b"),
    )
    columns = ["size", "sum_a", "sum_b"]
    firsts = marks.groupBy(*columns).agg(F.min(id_column).alias("set_id"))
    claimed = stage(marks.join(firsts, columns).select(id_column, "set_id", "size"), "set-claims")
    own = unique.join(claimed.where(F.col(id_column) != F.col("set_id")), id_column)
    theirs = unique.select(F.col(id_column).alias("set_id"), "event_id")
    equal = own.join(theirs, ["set_id", "event_id"]).groupBy(id_column).agg(F.count("*").alias("same"))
    sure = F.col("same").eqNullSafe(F.col("size")) | (F.col(id_column) == F.col("set_id"))
    return stage(claimed.join(equal, id_column, "left").select(
        id_column, F.when(sure, F.col("set_id")).otherwise(F.col(id_column)).alias("set_id"), "size"), "sets")


def correlated_sets(links: DataFrame, id_column: str, threshold: float) -> DataFrame:
    """Pairs of distinct event sets whose Jaccard similarity reaches ``threshold``.

    Findings with the same events collapse to one set first, so copies never pair up; a row
    stands for all ``findings_a`` x ``findings_b`` links between two sets, and a set with
    several findings has a row with itself. So there are as many rows as similar pairs of distinct sets, and no
    more than sets with copies besides.

    Events are ranked from rare to common. Of two similar sets, the smaller has one of its first
    s - ceil(2t s / (1+t)) + 1 events among the first s - ceil(t s) + 1 of the larger. The event's places leave
    room for enough common events behind it, or the pair is dropped at once. So an event that a third of all
    sets have seldom makes candidates; where it does, its sets are cut into blocks, and every two blocks meet in
    a key of their own. What is left is counted exactly.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    unique = links.select(id_column, "event_id").distinct()
    known = _distinct_sets(unique, id_column)
    sets = known.groupBy("set_id").agg(F.count("*").alias("findings"), F.max("size").alias("size"))
    frequency = unique.groupBy("event_id").agg(F.count("*").alias("uses"))
    items = (
        unique.join(known.where(F.col(id_column) == F.col("set_id")), id_column)
        .join(frequency, "event_id")
        .select("set_id", "size", "event_id", "uses")
    )
    # Places inside a set come from one distributed sort, so a huge set needs no task of its own.
    items = with_ordinal(items, ["set_id", "uses", "event_id"])
    starts = items.groupBy("set_id").agg(F.min("ord").alias("start"))
    t, size, place = F.lit(threshold), F.col("size"), F.col("ord") - F.col("start")
    least_whole = lambda c: F.ceil(c - 1e-9)  # noqa: E731  (a product may come out just above a whole number)
    lead = stage(items.join(starts, "set_id").withColumn("place", place).where(place < size - least_whole(t * size) + 1).select(
        "event_id", "set_id", "size", "place"), "set-prefixes")
    blocks = lead.groupBy("event_id").agg(F.ceil(F.count("*") / EVENT_BLOCK).alias("blocks"))
    dealt = lead.join(blocks, "event_id").withColumn("own", F.pmod(F.xxhash64("set_id"), F.col("blocks")))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    small = dealt.where(F.col("place") < size - least_whole(2 * t / (1 + t) * size) + 1).select(
        "event_id", F.col("own").alias("block_a"), every.alias("block_b"), F.col("set_id").alias("a"), size.alias("n_a"), F.col("place").alias("at_a"))
    large = dealt.select("event_id", every.alias("block_a"), F.col("own").alias("block_b"), F.col("set_id").alias("b"), size.alias("n_b"),
                         F.col("place").alias("at_b"))
    need = least_whole(t / (1 + t) * (F.col("n_a") + F.col("n_b")))
    room = F.least("at_a", "at_b") + F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    smaller = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b")))
    met = small.join(large, ["event_id", "block_a", "block_b"]).where(
        smaller & (F.col("n_a") >= t * F.col("n_b") - 1e-9) & (room >= need))
    swap = F.col("a") > F.col("b")
    candidates = met.select(
        F.least("a", "b").alias("set_a"), F.greatest("a", "b").alias("set_b"),
        F.when(swap, F.col("n_b")).otherwise(F.col("n_a")).alias("size_a"), F.when(swap, F.col("n_a")).otherwise(F.col("n_b")).alias("size_b")).distinct()
    shared = (
        candidates
        .join(items.select(F.col("set_id").alias("set_a"), "event_id"), "set_a")
        .join(items.select(F.col("set_id").alias("set_b"), "event_id"), ["set_b", "event_id"])
        .groupBy("set_a", "set_b", "size_a", "size_b").agg(F.count("*").alias("shared"))
    )
    scored = shared.withColumn(
        "similarity", F.col("shared") / (F.col("size_a") + F.col("size_b") - F.col("shared")))
    size_of = sets.select("set_id", "findings")
    pairs = (
        scored.filter(F.col("similarity") >= threshold)
        .join(size_of.toDF("set_a", "findings_a"), "set_a")
        .join(size_of.toDF("set_b", "findings_b"), "set_b")
        .select("set_a", "set_b", "findings_a", "findings_b", "shared", "similarity")
    )
    alone = sets.filter(F.col("findings") > 1).select(
        F.col("set_id").alias("set_a"), F.col("set_id").alias("set_b"),
        F.col("findings").alias("findings_a"), F.col("findings").alias("findings_b"),
        F.col("size").alias("shared"), F.lit(1.0).alias("similarity"))
    return pairs.union(alone)
