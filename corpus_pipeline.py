"""Corpus pipeline: quality classifier, quality rules, near-duplicate removal, secret masking, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import boosting, packing, quality_rules, secrets, similar_texts
from logloom.llm.queries import WORD_PIECES, table
from logloom.workspace import stage


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among them, doesn't reject."""
    trees = boosting.train(docs, table(spark, sf_dir, "labels"))
    return boosting.score_documents(docs, trees).where(F.col("predicted") == 1).select(*docs.columns)


def keep_regular(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, against references from the documents that came in."""
    return quality_rules.judge_documents(docs).where("kept").select(*docs.columns)


def keep_first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (5-word shingles, similarity 0.8 or more), that of the smallest doc_id."""
    return similar_texts.keep_one_per_group(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked and ``n_chars`` counted anew where it was known."""
    masked = secrets.mask_secrets(docs, secrets.train())
    return masked.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 2048 tokens, mixed by source."""
    return packing.pack_documents(docs, public_tokenizers.path(WORD_PIECES))


STAGES = [("quality_classifier", keep_good), ("quality_rules", keep_regular), ("near_dedup", keep_first_copies), ("secret_scans", mask_secrets),
          ("packing", pack)]

#: SQL can express neither the trained stages nor the tokenizer; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    name, step = STAGES[-1]
    return stage(step(spark, docs, sf_dir), f"pipeline-{name}")
