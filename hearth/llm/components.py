"""Connected components of a link table, by alternating star contractions.

Each round points every node's larger neighbours at its smallest one, then every node's smaller
neighbours at the smallest; the number of rounds grows with the logarithm of a component's
diameter.  Per-node minima are aggregates (combined before the shuffle), so a node with very many
links is no group in any one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (columns ``a``, ``b``): root is its component's smallest node."""
    edges = staged(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                   .distinct(), "links")
    before = None
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        # large star: larger neighbours go to the smallest of the closed neighbourhood
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = staged(both.where(F.col("v") > F.col("u")).join(low, "u")
                       .select(F.col("v").alias("a"), F.col("m").alias("b")).distinct(), "large-star")
        # small star: the node and its smaller neighbours go to the smallest of them
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        edges = staged(down.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("a"), F.col("m").alias("b"))
                       .unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct(), "small-star")
        state = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b") % (1 << 31)), F.lit(0))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    return (edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
            .unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct())
