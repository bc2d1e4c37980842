"""Connected components of a graph given as edges, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import stage


def connected_components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Columns ``node`` and ``root``: every node of an edge with the smallest node it reaches.

    Nodes are of any type that Spark orders. Each round joins every neighbourhood to its smallest
    node, first from above (large star), then from below (small star); the number of rounds grows with
    the logarithm of the number of nodes. A round writes its edges to the shared folder, and so does
    the table of smallest neighbours: then both sides of its join are plain shuffles, which adaptive
    execution can split when one node holds a large part of all edges. Rows with a null end are no edges.
    """
    high, low = F.greatest(left, right), F.least(left, right)
    links = (edges.where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right)))
             .select(high.alias("hi"), low.alias("lo")).distinct())
    links = stage(links, "component-edges")
    while not _is_star_forest(links):
        links = _round(links)
    roots = links.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    return links.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(roots)


def _round(links: DataFrame) -> DataFrame:
    both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
        links.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    smallest = stage(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m")), "component-min")
    lifted = (links.select(F.col("lo").alias("u"), F.col("hi").alias("v")).join(smallest, "u")
              .select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct())
    lifted = stage(lifted, "component-large")
    lowest = stage(lifted.groupBy("hi").agg(F.min("lo").alias("m")), "component-low")
    sideways = (lifted.join(lowest, "hi").where(F.col("lo") != F.col("m"))
                .select(F.col("lo").alias("hi"), F.col("m").alias("lo")))
    down = lowest.select("hi", F.col("m").alias("lo"))
    return stage(sideways.unionByName(down).distinct(), "component-small")


def _is_star_forest(links: DataFrame) -> bool:
    """Every node has one lower neighbour at most, and no node is both above one and below another."""
    ends = links.select(F.col("hi").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        links.select(F.col("lo").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    seen = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.where((F.col("up") > 1) | ((F.col("up") == 1) & (F.col("down") == 1))).isEmpty()
