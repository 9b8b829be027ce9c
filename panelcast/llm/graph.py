"""Connected components over an edge table, by alternating large-star and small-star rounds.

Each round takes each node's smallest neighbour by a partial aggregate and joins it back, so a node with very many
neighbours is never gathered in one group; the join's hot side is split by the adaptive skew join. Each round is
written, which cuts the lineage. Self-loops and repeated edges do no harm; rows with a null end are no edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    both = _both_ways(edges)
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u")
    moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Is each node either a root or the end of one edge to a root?"""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).union(edges.select("v", F.lit(0), F.lit(1)))
    sums = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return sums.where("below > 1 OR (below > 0 AND above > 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) to (node, component): every node of an edge with the smallest node that it reaches."""
    down = edges.select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v"))
    now = written(down.where("u <> v"), "edges")
    while not _settled(now):
        now = written(_small_star(_large_star(now)), "stars")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
