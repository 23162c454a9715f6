"""Connected components of a link table, by alternating star contractions.

Each round points every node's larger neighbours at its smallest one, then every node's smaller neighbours at
the smallest of them; rounds grow with the logarithm of a component's diameter.  A node's minimum is an
aggregate (combined before the shuffle) and is written before it is joined, so a node with very many links is no
group in any one task and its join can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import Rounds


def components(links: DataFrame) -> tuple[DataFrame, int]:
    """``node, root`` for every node of ``links`` (columns ``a``, ``b``; root: the component's smallest node), and the rounds taken."""
    tables = Rounds(links, "components")
    edges = tables.write(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    rounds, before = 0, None
    while True:
        rounds += 1
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = tables.write(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = tables.write(both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct())
        least = tables.write(large.groupBy("a").agg(F.min("b").alias("m")))
        edges = tables.write(large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                            .unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        state = tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b") % (1 << 31)), F.lit(0))).first())
        if state == before:
            break
        before = state
        tables.keep(edges)
    tables.keep(edges)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct(), rounds
