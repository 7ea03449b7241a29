"""Connected components by alternating large and small stars (Kiveris et al., 2014).

Works on edges only, in a number of rounds that grows with the logarithm of the size. A
node with very many edges is folded before it is shuffled, and its edges may be split
over tasks. Each round is written to the shared folder, so a lost executor costs a read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored


def ordered(edges: DataFrame) -> DataFrame:
    """Distinct edges from the larger to the smaller node, without loops."""
    pair = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    return pair.where("u != v").distinct()


def state(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*"),
        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
        F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")),
    ).first()
    return tuple(row)


def large_star(edges: DataFrame) -> DataFrame:
    """Join each larger neighbour of a node to the smallest node near it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Join a node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def roots(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v); the root is its component's smallest node."""
    now = stored(ordered(edges), "star")
    before, after = None, state(now)
    while after != before:
        now = stored(small_star(large_star(now)), "star")
        before, after = after, state(now)
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
