"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, saved

#: Rounds halve the paths, so a path would need 2^60 nodes to take more.
ROUNDS = 64


def connected_components(links: DataFrame) -> DataFrame:
    """links: columns a and b. Returns node, root: for every linked node the smallest node that it reaches.

    Rounds are logarithmic in the length of the longest path. Each is two joins on a node with the minimum of its
    neighbours, which is counted before it is shuffled; a hub's join is left to skew handling. Null ends are no links.
    """
    a, b = F.col("a"), F.col("b")
    edges = saved(links.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    seen = None
    for _ in range(ROUNDS):
        both = edges.select("a", "b").unionByName(edges.select(b.alias("a"), a.alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.join(low, "a").where(b > a).select(b.alias("a"), F.least(a, F.col("m")).alias("b")).distinct()
        large = saved(large)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(low, "a").where(b != F.col("m")).select(b.alias("a"), F.col("m").alias("b"))
        after = saved(moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        dropped(large)
        dropped(edges)
        edges = after
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components are not found after {ROUNDS} rounds")
    return edges.select(a.alias("node"), b.alias("root")).unionByName(edges.select(b.alias("node"), b.alias("root")).distinct())
