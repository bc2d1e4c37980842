"""Risk level, distributions and the texts of the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.severity import severity_rank
from ..functions.text import first_sentence
from .chains import by_severity
from .ordering import with_ordinal

LABELS = ["High", "Medium", "Low"]


def label_distribution(threats: DataFrame, column: str) -> DataFrame:
    """Counts and shares of High, Medium and Low: zeros kept, missing is Low, other labels left out."""
    label = F.coalesce(F.col(column), F.lit("Low"))
    counts = threats.agg(*[F.count_if(label == name).alias(name) for name in LABELS])
    total = sum((F.col(name) for name in LABELS), F.lit(0))
    rows = F.array(*[F.struct(F.lit(name).alias("label"), F.col(name).alias("n")) for name in LABELS])
    listed = counts.select(total.alias("total"), F.inline(rows))
    percent = F.coalesce(F.try_divide(F.col("n") * 100.0, F.col("total")), F.lit(0.0))
    return listed.select("label", "n", F.round(percent, 1).alias("percent"))


def severity_distribution(threats: DataFrame) -> DataFrame:
    return label_distribution(threats, "severity")


def confidence_distribution(threats: DataFrame) -> DataFrame:
    return label_distribution(threats, "confidence")


def confidence_share(threats: DataFrame) -> DataFrame:
    """Share of each observed label over all threats; missing is Unknown."""
    counts = threats.groupBy(F.coalesce("confidence", F.lit("Unknown")).alias("confidence")).agg(
        F.count("*").alias("n"))
    total = threats.select(F.count("*")).scalar()
    return counts.withColumn("share", F.col("n") / total)


def risk_assessment(threats: DataFrame, chunk_count: Column | None = None) -> DataFrame:
    """Overall level by the most severe label present, with the reasoning sentence."""
    label = F.coalesce("severity", F.lit("Low"))
    counts = threats.agg(
        F.count("*").alias("threat_count"), *[F.count_if(label == name).alias(name) for name in LABELS])
    if chunk_count is not None:
        counts = counts.withColumn("chunks", chunk_count)
    high, medium, low = (F.col(name) for name in LABELS)
    level = F.when(high > 0, "High").when(medium > 0, "Medium").when(low > 0, "Low").otherwise("Minimal")
    where = F.format_string(C.RISK_CHUNKS, F.col("chunks")) if chunk_count is not None else F.lit("")
    reasoning = F.format_string(C.RISK_REASONING, F.col("threat_count"), where, high, medium, low)
    spread = F.create_map(*[x for name in LABELS for x in (F.lit(name), F.col(name))])
    return counts.select(
        level.alias("overall_risk_level"), reasoning.alias("reasoning"), "threat_count",
        spread.alias("severity_distribution"))


#: Types of a chain that its text names; it gives the number of the others.
NAMED_TYPES = 100


def chain_types(members: DataFrame) -> DataFrame:
    """Link table chain -> type in first-seen order: chain_no, chain_id, place (from 0), threat_type, n, last_seen.

    Types are free text and may be very many; places come from one distributed sort, so no chain is gathered.
    """
    kind = F.coalesce("threat_type", F.lit("Unknown"))
    order = F.struct(~F.col("is_head"), F.col("idx"))
    per_type = members.groupBy("chain_no", "chain_id", kind.alias("threat_type")).agg(
        F.count("*").alias("n"), F.min(order).alias("first_seen"), F.max(order).alias("last_seen"))
    placed = with_ordinal(per_type, ["chain_no", "first_seen"])
    begins = placed.groupBy("chain_no").agg(F.min("ord").alias("_begin"))
    return placed.join(begins, "chain_no").select(
        "chain_no", "chain_id", (F.col("ord") - F.col("_begin")).alias("place"), "threat_type", "n", "last_seen")


def chain_type_summary(members: DataFrame, named: int = NAMED_TYPES) -> DataFrame:
    """Per chain: ``n type`` in first-seen order, its first and last threat type, and how many types were left out.

    The text names the first ``named`` types; if there are more, it ends with their number. All of them are in
    ``chain_types``.
    """
    types = chain_types(members)
    entry = F.when(F.col("place") < named, F.struct("place", F.concat(F.col("n"), F.lit(" "), F.col("threat_type")).alias("text")))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["text"]), ", ")
    left_out = F.greatest(F.count("*") - named, F.lit(0))
    summed = types.groupBy("chain_no", "chain_id").agg(
        listed.alias("listed"), left_out.alias("types_left_out"),
        F.min_by("threat_type", "place").alias("first_type"), F.max_by("threat_type", "last_seen").alias("last_type"))
    more = F.when(F.col("types_left_out") > 0, F.concat(F.lit(" and "), F.col("types_left_out"), F.lit(" more types"))).otherwise("")
    return summed.withColumn("types", F.concat("listed", more)).select(
        "chain_no", "chain_id", "types", "first_type", "last_type",
        F.format_string(C.CHAIN_COURSE, F.col("types"), F.col("first_type"), F.col("last_type")).alias("text"), "types_left_out")


def top_chain(chains: DataFrame) -> DataFrame:
    """Best chain by severity weight, then number of threats, then order."""
    weight = F.when(F.col("severity") == "High", 1.0).when(F.col("severity") == "Medium", 0.5).otherwise(0.0)
    rank = severity_rank(F.col("severity"))
    return chains.withColumn("weight", weight).orderBy(
        F.desc("weight"), F.desc("threat_count"), rank.desc(), "chain_no").limit(1)


def attack_summary(threats: DataFrame, chains: DataFrame, members: DataFrame) -> DataFrame:
    """One sentence about the attack, chosen by what was found."""
    label = F.coalesce("severity", F.lit(""))
    counts = threats.agg(F.count("*").alias("total"), F.count_if(label == "High").alias("high"))
    first_high = (
        threats.filter(F.col("severity") == "High").orderBy("idx").limit(3)
        .select(F.coalesce("threat_type", F.lit("Unknown")).alias("t"))
        .agg(F.array_join(F.array_sort(F.collect_set("t")), ", ")).scalar()
    )
    best = top_chain(chains)
    involved = members.join(best.select("chain_no"), "chain_no", "left_semi")
    chain_text = (
        best.join(chain_type_summary(involved).select("chain_no", "text"), "chain_no")
        .select(F.format_string(C.SUMMARY_CHAIN, F.lower("severity"), F.col("threat_count"), F.col("text"))).scalar()
    )
    nothing = F.lit(C.SUMMARY_NOTHING)
    unclear = F.format_string(C.SUMMARY_UNCLEAR, F.col("total"))
    severe = F.format_string(C.SUMMARY_SEVERE, F.col("high"), first_high)
    # A chain always exists when its sentence does.
    text = (
        F.when(F.col("total") == 0, nothing)
        .when(chain_text.isNotNull(), chain_text)
        .when(F.col("high") == 0, unclear)
        .otherwise(severe)
    )
    return counts.select(text.alias("attack_summary"))


def key_indicators(threats: DataFrame, patterns: DataFrame, n: int = 5) -> DataFrame:
    """First sentences of High threats and pattern types: distinct, sorted, first ``n``."""
    described = threats.filter((F.col("severity") == "High") & (F.length("description") > 10)).select(
        first_sentence(F.col("description")).alias("indicator"))
    kinds = patterns.filter(F.coalesce("pattern_type", F.lit("")) != "").select(
        F.col("pattern_type").alias("indicator"))
    return described.union(kinds).distinct().orderBy("indicator").limit(n)


def threats_by_severity(threats: DataFrame) -> DataFrame:
    rank = severity_rank(F.coalesce("severity", F.lit("Low")))
    return threats.withColumn("severity_rank", rank).orderBy(F.desc("severity_rank"), "idx")


def top_events(links: DataFrame, id_column: str, order_by: str, n: int = 5) -> DataFrame:
    """First ``n`` events of each finding, and how many more there are.

    The rank filter is applied per map task before the shuffle (window group limit), so a
    finding with very many events sends only ``n`` rows per task.
    """
    ranked = Window.partitionBy(id_column).orderBy(order_by, "event_id")
    kept = links.withColumn("_rn", F.row_number().over(ranked)).filter(F.col("_rn") <= n)
    head = kept.groupBy(id_column).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_rn", "event_id"))), lambda e: e["event_id"]).alias("events"))
    counts = links.groupBy(id_column).agg(F.count("*").alias("total"))
    return head.join(counts, id_column).select(
        id_column, "events", F.greatest(F.col("total") - n, F.lit(0)).alias("more"))


def display_chains(chains: DataFrame, n: int = 5) -> DataFrame:
    return by_severity(chains).limit(n)
