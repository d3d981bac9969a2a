"""Connected components of an undirected link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.runtime import written


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node of each node's component; nodes without links do not appear.

    Alternates joining every node to the smallest neighbour of its neighbourhood (large star) and of its
    smaller neighbours (small star) until no link changes, which takes O(log n) rounds on chains. Each round
    is written to the shared folder. Null ends and self links are left out; repeated links change nothing.
    """
    e = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where(F.col("u") != F.col("v"))
    e = written(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:  # every round moves some link to a smaller node, so it ends
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.union(low.where("u > m")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").union(least.select("u", F.col("m").alias("v"))).distinct()
        e = written(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = e.groupBy("u").agg(F.min("v").alias("component"))
    nodes = roots.select(F.col("u").alias("node"), "component")
    return nodes.union(roots.select(F.col("component").alias("node"), "component").distinct())
