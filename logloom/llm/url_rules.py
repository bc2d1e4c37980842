"""URL verdicts from a list of host and path rules, by hashed host-suffix and path-prefix expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..workspace import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hexadecimal digits of a digest that the join uses; the full digest is compared afterwards.
PREFIX_DIGITS = 8


def url_host(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*+([^?#]*)", 1)


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, path), 256)


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule`` and ``verdict`` for every row of ``pages``.

    ``rules`` has ``host``, ``path`` and ``action`` (allow or block). A rule fits its host and all subdomains
    if the path starts with its path. The longest host and path together wins; of equal lengths the longer
    path, then block. Without a rule, ``rule`` is null and the verdict is ``default``. Rules with a null part
    are skipped. A null url, or one without ``://``, has empty host and path. Rows that repeat give a row
    each; further columns of ``pages`` are not read; an empty table gives an empty table.

    Each distinct (host, path) is expanded into one expression per shape (labels of the host, length of the
    path) that occurs among the rules, so its rows are bounded by the shapes, not by the rules. The shapes
    are few: labels and lengths of names, however long the list. Expressions meet the rules on a digest
    prefix and are confirmed by the full digest. Nothing is broadcast by hint.
    """
    rules = rules.dropna(subset=["host", "path", "action"]).select(
        F.translate("host", UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path"), "action")
    shapes = rules.select(F.size(F.split("rule_host", r"\.", -1)).alias("labels"),
                          F.length("rule_path").alias("chars")).distinct().collect()
    hashed = rules.withColumn("digest", _digest(F.col("rule_host"), F.col("rule_path"))).select(
        F.substring("digest", 1, PREFIX_DIGITS).alias("prefix"), F.col("digest").alias("rule_digest"),
        F.struct(F.length(F.concat("rule_host", "rule_path")).alias("chars"), F.length("rule_path").alias("path_chars"),
                 (F.col("action") == "block").alias("blocks"), F.concat("rule_host", "rule_path").alias("rule"), "action").alias("hit"))
    rows = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    names = rows.select("host", "path").distinct().withColumn("labels", F.split("host", r"\.", -1))
    expressions = [
        F.when((F.size("labels") >= n) & (F.length("path") >= chars),
               _digest(F.array_join(F.slice("labels", -n, n), "."), F.substring("path", 1, chars)))
        for n, chars in sorted(map(tuple, shapes))]
    expanded = (names.select("host", "path", F.explode(F.array_compact(F.array(*expressions))).alias("digest"))
                if expressions else names.select("host", "path", F.lit("").alias("digest")).limit(0))
    hits = (expanded.withColumn("prefix", F.substring("digest", 1, PREFIX_DIGITS)).join(hashed, "prefix")
            .where(F.col("digest") == F.col("rule_digest")))
    judged = stage(hits.groupBy("host", "path").agg(F.max("hit").alias("hit")), "url-rules")
    return rows.join(judged, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.action", F.lit(default)).alias("verdict"))
