"""Token, time and price totals of scoring runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C


def performance_totals(chunk_runs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Sums and per-chunk averages over (api_calls, total_tokens, duration_seconds) rows, one per chunk."""
    chunks = F.greatest(F.col("chunks_processed"), F.lit(1))
    grouped = chunk_runs.groupBy(*(keys or []))
    return grouped.agg(
        F.coalesce(F.sum("api_calls"), F.lit(0)).alias("total_api_calls"),
        F.coalesce(F.sum("total_tokens"), F.lit(0.0)).alias("total_tokens"),
        F.coalesce(F.sum("duration_seconds"), F.lit(0.0)).alias("total_duration_seconds"),
        F.count("*").alias("chunks_processed"),
    ).withColumns({
        "average_tokens_per_chunk": F.col("total_tokens") / chunks,
        "average_duration_per_chunk": F.col("total_duration_seconds") / chunks,
    })


def run_metrics(totals: DataFrame, event_count) -> DataFrame:
    """Truncated tokens per call and events per second."""
    return totals.select(
        F.floor(F.col("total_tokens") / F.greatest("total_api_calls", F.lit(1))).alias("average_tokens_per_call"),
        F.try_divide(event_count, F.col("total_duration_seconds")).alias("events_per_second"),
    )


def price_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        C.PRICES, "provider string, model string, input_price double, output_price double")


def cost_estimate(usage: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """Price of ``total_tokens`` per (provider, model) row, split 70/30 into input and output.

    An unknown model takes its provider's default price, an unknown provider the overall one.
    The price table is a few literal rows, so Catalyst broadcasts it by its known size.
    """
    prices = prices if prices is not None else price_table(usage.sparkSession)
    providers = prices.select("provider").distinct().withColumn("priced_as", F.col("provider"))
    exact = prices.toDF("priced_as", "model", "exact_in", "exact_out")
    fallback = prices.filter(F.col("model") == "default").select(
        F.col("provider").alias("priced_as"), F.col("input_price").alias("std_in"), F.col("output_price").alias("std_out"))
    priced = (
        usage.join(providers, "provider", "left")
        .withColumn("priced_as", F.coalesce("priced_as", F.lit("default")))
        .join(exact, ["priced_as", "model"], "left")
        .join(fallback, "priced_as", "left")
    )
    input_tokens = F.col("total_tokens") * C.INPUT_TOKEN_SHARE
    output_tokens = F.col("total_tokens") * C.OUTPUT_TOKEN_SHARE
    input_cost = input_tokens / 1000 * F.coalesce("exact_in", "std_in")
    output_cost = output_tokens / 1000 * F.coalesce("exact_out", "std_out")
    return priced.select(
        *usage.columns,
        F.floor(input_tokens).alias("input_tokens"),
        F.floor(output_tokens).alias("output_tokens"),
        input_cost.alias("input_cost"),
        output_cost.alias("output_cost"),
        (input_cost + output_cost).alias("total_cost"),
        F.lit("USD").alias("currency"),
    )


def resource_requirements(performance: DataFrame, keys: list[str]) -> DataFrame:
    """Rates per run and, where the input size is known, figures per GB.

    ``performance`` holds one row per run with totals, cost, peaks and ``input_file_size_gb``.
    GPU memory in MB and in percent are separate columns.
    """
    tokens, calls, seconds = F.col("total_tokens"), F.col("total_api_calls"), F.col("total_duration_seconds")
    size = F.nullif(F.col("input_file_size_gb"), F.lit(0.0))
    zero = F.lit(0.0)
    return performance.select(
        *keys, tokens.alias("total_tokens"), calls.alias("total_api_calls"), seconds.alias("total_duration_seconds"),
        F.coalesce(F.try_divide(tokens, calls), zero).alias("tokens_per_api_call"),
        F.coalesce(F.try_divide(tokens, seconds), zero).alias("tokens_per_second"),
        F.coalesce("cost", zero).alias("cost_estimate_usd"),
        F.coalesce("max_gpu_memory_mb", zero).alias("max_gpu_memory_mb"),
        F.coalesce("max_gpu_memory_percent", zero).alias("max_gpu_memory_percent"),
        F.coalesce("max_cpu_percent", zero).alias("max_cpu_percent"),
        F.coalesce("max_memory_percent", zero).alias("max_memory_percent"),
        F.coalesce("max_memory_gb", zero).alias("max_memory_gb"),
        F.try_divide(tokens, size).alias("tokens_per_gb"),
        F.try_divide(seconds, size).alias("time_per_gb"),
        F.try_divide(F.nullif(F.col("cost"), zero), size).alias("cost_per_gb"),
    )
