"""Row filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C


def time_window(df: DataFrame, end: Column, hours: int, column: str = "timestamp") -> DataFrame:
    """Rows of the last ``hours`` before ``end``; plain comparisons, so the scan can use them."""
    start = end - F.make_interval(hours=F.lit(hours))
    return df.filter((F.col(column) >= start) & (F.col(column) <= end))


def relevant_events(events: DataFrame, *links: DataFrame) -> DataFrame:
    """Events that any of the link tables names."""
    named = links[0].select("event_id")
    for link in links[1:]:
        named = named.union(link.select("event_id"))
    return events.join(named, "event_id", "left_semi")


def parse_ok(chunks: DataFrame) -> DataFrame:
    return chunks.filter(F.col("parsing_error").isNull())


def within_prompt_budget(prompts: DataFrame, budget: int = C.PROMPT_BUDGET) -> tuple[DataFrame, DataFrame]:
    """Prompts below the budget, and the rejected ones."""
    fits = F.length("prompt") < budget
    return prompts.filter(fits), prompts.filter(~fits)


def high_threats(threats: DataFrame) -> DataFrame:
    return threats.filter(F.col("severity") == "High")


def severity_threshold(df: DataFrame, minimum: int, column: str = "severity") -> DataFrame:
    return df.filter(F.col(column) >= minimum)


def frequency_quantile(frequencies: DataFrame, q: float) -> Column:
    """Quantile of the ``n`` column by cumulative counts over its distinct values.

    With N events there are at most sqrt(2N) distinct frequencies, so the running sum is short.
    """
    by_value = frequencies.groupBy("n").agg(F.count("*").alias("keys"))
    running = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    cumulative = by_value.select("n", F.sum("keys").over(running).alias("upto"))
    total = frequencies.select(F.count("*")).scalar()
    return cumulative.filter(F.col("upto") >= F.lit(q) * total).select(F.min("n")).scalar()


def filter_noise(events: DataFrame, q: float = 0.9, max_severity: int = 1) -> DataFrame:
    """Drop low-value events: low severity, no IOC mark, and a very frequent (type, process) pair."""
    keys = ["event_type", "process_name"]
    frequencies = events.groupBy(*keys).agg(F.count("*").alias("n"))
    common = frequencies.filter(F.col("n") >= frequency_quantile(frequencies, q)).select(*keys)
    marked = common.select(*[F.col(k).alias(f"_{k}") for k in keys])
    dull = (F.col("severity") <= max_severity) & ~F.coalesce(F.col("ioc_match"), F.lit(False))
    match = dull & (F.col("event_type") == F.col("_event_type")) & (F.col("process_name") == F.col("_process_name"))
    return events.join(marked, match, "left_anti")
