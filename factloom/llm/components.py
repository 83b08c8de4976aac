"""Connected components of an undirected graph by alternating large and small stars.

Every step is a minimum per vertex (combined before the shuffle) and a join that adaptive execution can split, so a
vertex with very many links is no single task; the number of rounds grows with the logarithm of the graph's size.
Each round is cut off by a reliable checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """``edges`` (u, v) hold both directions if ``large``, else u > v only. Links neighbours to the smallest vertex around."""
    # cut off here, so that both sides of the join are shuffles and a hot vertex can be split
    least = cut_lineage(edges.groupBy("u").agg(F.min("v").alias("least")).withColumn("least", F.least("u", "least")))
    joined = edges.join(least, "u")
    if large:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).where("u <> v").distinct()
    own = least.select("u", F.col("least").alias("v"))
    return joined.select(F.col("v").alias("u"), F.col("least").alias("v")).union(own).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``vertex, component`` (smallest vertex that can be reached) for every vertex of ``edges`` (columns ``a, b``, not null)."""
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, before = cut_lineage(now), None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        now = cut_lineage(_star(_down(_star(both, True)), False))
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    stars = now.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
    return stars.union(now.select("v", "v").distinct())


def _down(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
