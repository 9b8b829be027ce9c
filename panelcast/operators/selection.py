"""Exact order statistics of large groups, without sorting or collecting a whole group.

Equal values are counted first. Each group's values are dealt into bins by approximate quantiles (a sketch of bounded
size); exact counts of the bins tell which bins hold the ranks that are asked for, and only these bins are sorted. Where
no group has more than SMALL distinct values, each is one bin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import written

BINS, SMALL = 64, 4_096


def counted(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by…, value, n): how often each value that isn't null occurs, written once."""
    return written(df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("value")).agg(F.count("*").alias("n")), "counted")


def order_statistics(values: DataFrame, ranks: DataFrame, by: list[str], bins: int = BINS, small: int = SMALL) -> DataFrame:
    """(by…, rank, value) for ranks (by…, rank), from 0, of values (by…, value, n) in ascending order; ranks past the
    end have no row."""
    upto = lambda *keys: F.sum("n").over(Window.partitionBy(*keys).orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    largest = values.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    if largest <= small:
        placed = values.withColumn("__upto", upto(*by)).join(ranks, by)
        return placed.where((F.col("rank") < F.col("__upto")) & (F.col("rank") >= F.col("__upto") - F.col("n"))).select(*by, "rank", "value")
    points = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    cuts = values.groupBy(*by).agg(F.array_distinct(F.percentile_approx("value", points, F.lit(10_000))).alias("__cuts"))
    x = F.col("value")
    binned = values.join(cuts, by).withColumn("__bin", F.size(F.filter("__cuts", lambda c: c < x))).drop("__cuts")
    sizes = binned.groupBy(*by, "__bin").agg(F.sum("n").alias("__n"))
    below = F.sum("__n").over(Window.partitionBy(*by).orderBy("__bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__n")
    # A row for each bin of a group, and for each rank that is asked for.
    wanted = sizes.withColumn("__below", below).join(ranks, by).where((F.col("rank") >= F.col("__below")) & (F.col("rank") < F.col("__below") + F.col("__n"))).select(*by, "__bin", "__below", "rank")
    some = binned.join(wanted.select(*by, "__bin").distinct(), [*by, "__bin"], "left_semi")
    placed = some.withColumn("__upto", upto(*by, "__bin")).join(wanted, [*by, "__bin"])
    at = F.col("rank") - F.col("__below")
    return placed.where((at < F.col("__upto")) & (at >= F.col("__upto") - F.col("n"))).select(*by, "rank", "value")
