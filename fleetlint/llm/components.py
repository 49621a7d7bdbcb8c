"""Connected components of a graph given as links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlint.plans.storage import materialise


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is linked with the least node around it."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked with the least of these."""
    least = _least(edges)
    moved = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def _are_stars(edges: DataFrame) -> bool:
    """True when each larger node has one link, to a node that is the least of all its own."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    sums = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return sums.where("up > 1 OR (up = 1 AND down = 1)").agg(F.count("*")).first()[0] == 0


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """``(node, component)`` for each node of ``links(a, b)`` that is not the least of its component.

    Links are unordered pairs of ids. Each round is written to the shared folder, so lineage
    stays short; the rounds grow with the logarithm of the longest chain, and end as soon as only
    stars are left. A hot node is handled by sums and joins that can be split, never in one group.
    """
    edges = links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = materialise(edges, name)
    while not _are_stars(edges):
        edges = materialise(_small_star(_large_star(edges)).distinct(), name)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
