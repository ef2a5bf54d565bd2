"""Connected components of a graph that is given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.session import pinned


def components(edges: DataFrame) -> DataFrame:
    """`node`, `root` for each node of `edges` (`a`, `b`, long): the smallest node it is connected to.

    Alternates the "large star" and "small star" steps of Kiveris et al. (2014): every node hands its larger, then
    its smaller, neighbours to the smallest one. Rounds grow with the logarithm of the longest path. Minima combine
    before they are shuffled, and each step joins two stored tables, so a node with very many neighbours
    is spread by adaptive execution. No graph at all gives an empty table.
    """
    now = pinned(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = pinned(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = pinned(large.where("u <> v").distinct())
        least = pinned(now.groupBy("u").agg(F.min("v").alias("m")))
        small = now.join(least, "u")
        now = pinned(
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(small.select("u", F.col("m").alias("v")))
            .distinct()
        )
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = state
