"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import discard, store


def least_neighbour(pairs: DataFrame) -> DataFrame:
    """pairs(a, b) with m: the least of a and all its b.  Aggregated before the shuffle; the join back splits hubs."""
    least = pairs.groupBy("a").agg(F.min("b").alias("m"))
    return pairs.join(least.select(F.col("a").alias("of"), F.least("of", "m").alias("m")), F.col("a") == F.col("of")).drop("of")


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return least_neighbour(both).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    found = least_neighbour(edges)
    moved = found.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(found.select("a", F.col("m").alias("b")))
    return moved.where(F.col("a") != F.col("b")).distinct()


def stars(edges: DataFrame) -> bool:
    """Whether every node has one edge down at most and the lower ends have none: then each component is a star."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("low"), F.lit(0).alias("high")).unionByName(edges.select(F.col("b").alias("x"), F.lit(0).alias("low"), F.lit(1).alias("high")))
    per_node = ends.groupBy("x").agg(F.sum("low").alias("low"), F.max("high").alias("high"))
    return per_node.where((F.col("low") > 1) | ((F.col("low") > 0) & (F.col("high") > 0))).isEmpty()


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """node, component (the least node reachable) for every node of edges(a, b) but the components' own least nodes.

    Edges become stars around the least nodes, which ends it.  Each turn writes a table, and drops that of the turn before.
    """
    now = store(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    while not stars(now):
        before, now = now, store(small_star(large_star(now)), label)
        discard(before)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
