"""Cross-sectional signals: z-scores by date, quantile buckets, long/short spreads, growth and drawdown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .selection import counted, order_statistics


def zscore(df: DataFrame, raw, date: str = "forecast_start_date", name: str = "signal_z") -> DataFrame:
    """(raw - mean) / population deviation by date; 0 where the deviation is 0 or not finite. The statistics are an
    aggregate with a row for each date, joined back."""
    rows = df.withColumn("__raw", raw)
    stats = rows.groupBy(date).agg(F.avg("__raw").alias("__m"), F.stddev_pop("__raw").alias("__s"))
    usable = (F.col("__s") > 0) & (F.col("__s") < float("inf"))
    return rows.join(stats, date).withColumn(name, F.when(usable, (F.col("__raw") - F.col("__m")) / F.col("__s")).otherwise(0.0)).drop("__raw", "__m", "__s")


def signal_z(joined: DataFrame, risk_adjusted: bool = False) -> DataFrame:
    """The signal is mu, or mu / sigma for sigma > 0; rows without signal or target go first."""
    raw = F.when(F.col("sigma") > 0, F.col("mu") / F.col("sigma")) if risk_adjusted else F.col("mu")
    return zscore(joined.where(raw.isNotNull() & F.col("target").isNotNull()), raw)


def alpha(predictions: DataFrame) -> DataFrame:
    """z-score of mu / sigma by date, over rows with mu and sigma > 0."""
    rows = predictions.where(F.col("mu").isNotNull() & (F.col("sigma") > 0))
    return zscore(rows, F.col("mu") / F.col("sigma"), name="alpha")


def _points(n: int) -> list[float]:
    """Quantile points k / n, in the steps that make a value on an edge fall where it should."""
    return [1.0 if k == n else ((k * (1.0 / n)) * 100.0) / 100.0 for k in range(n + 1)]


def buckets(scored: DataFrame, n: int, z: str = "signal_z", date: str = "forecast_start_date") -> DataFrame:
    """Adds bucket (1 to n): right-closed quantile intervals by date, the lowest value included. Fewer than n distinct
    values: null. Equal edges count once, so that later buckets move down. Edges come from the few order statistics
    next to them, a row for each date."""
    values = counted(scored, [date], z)
    sizes = values.groupBy(date).agg((F.sum("n") - 1).alias("m"), F.count("*").alias("distinct")).where(F.col("distinct") >= n)
    low = lambda p: F.floor(F.lit(p) * F.col("m"))
    near = F.array_distinct(F.flatten(F.array(*[F.array(low(p), F.least(low(p) + 1, F.col("m"))) for p in _points(n)])))
    found = order_statistics(values, sizes.select(date, F.explode(near).alias("rank")), [date])
    s = F.map_from_entries(F.collect_list(F.struct("rank", "value")))
    sorted_ = sizes.join(found.groupBy(date).agg(s.alias("s")), date)

    def edge(p: float):
        f = F.lit(p) * F.col("m") - low(p)
        a, b = F.element_at("s", low(p)), F.element_at("s", F.least(low(p) + 1, F.col("m")))
        return F.when(f < 0.5, a + (b - a) * f).otherwise(b - (b - a) * (1 - f))

    edges = sorted_.select(date, F.array_distinct(F.array(*map(edge, _points(n)))).alias("__edges"))
    x = F.col(z)
    return scored.join(edges, date, "left").withColumn("bucket", F.when(F.col("__edges").isNotNull(), F.greatest(F.lit(1), F.size(F.filter("__edges", lambda e: e < x))))).drop("__edges")


def bucket_stats(bucketed: DataFrame, periods: int = 252) -> DataFrame:
    out = bucketed.where("bucket IS NOT NULL").groupBy("bucket").agg(F.avg("target").alias("mean_per_period"), F.count("target").alias("n"))
    return out.withColumn("annualized_return", F.col("mean_per_period") * periods)


def spread(bucketed: DataFrame, n: int, date: str = "forecast_start_date") -> DataFrame:
    """(date, spread): mean of the top bucket less that of the bottom one, on dates with both. If there are rows, but no
    such date, the plan fails when it runs; that is found in the table of one row per date."""
    side = lambda b: F.avg(F.when(F.col("bucket") == b, F.col("target")))
    days = bucketed.groupBy(date).agg((side(n) - side(1)).alias("spread"))
    some = F.count("spread").over(Window.partitionBy(F.lit(0)))
    known = days.withColumn("__some", some).where(F.when(F.col("__some") == 0, F.raise_error(F.lit("an extreme bucket has no rows")).cast("boolean")).otherwise(F.col("spread").isNotNull()))
    return known.drop("__some")


def spread_summary(spreads: DataFrame, periods: int = 252) -> DataFrame:
    """Annualised mean and Sharpe ratio (sample deviation; 0 unless that is positive)."""
    stats = spreads.agg(F.avg("spread").alias("m"), F.stddev_samp("spread").alias("s"), F.count("*").alias("n_dates"))
    return stats.select((F.col("m") * periods).alias("annualized_return"), F.when(F.col("s") > 0, F.col("m") / F.col("s") * F.sqrt(F.lit(float(periods)))).otherwise(0.0).alias("sharpe"), "n_dates")


def growth(returns: DataFrame, value: str, date: str, by=()) -> DataFrame:
    """(by…, date, cumulative, drawdown): product of 1 + r, from 1.0 on the day before the first date; the running
    maximum of drawdowns starts at the first cumulative value. One row per date and series goes in."""
    known = returns.where(F.col(value).isNotNull())
    series = Window.partitionBy(*(by or [F.lit(0)])).orderBy(date)
    w = series.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = known.select(*by, F.to_date(date).alias("date"), F.product(1 + F.col(value)).over(w).alias("cumulative"))
    top = F.max("cumulative").over(Window.partitionBy(*(by or [F.lit(0)])).orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = out.withColumn("drawdown", F.col("cumulative") / top - 1)
    first = known.groupBy(*by).agg(F.date_sub(F.min(F.to_date(date)), 1).alias("date")).where("date IS NOT NULL")
    return first.withColumn("cumulative", F.lit(1.0)).withColumn("drawdown", F.lit(None).cast("double")).unionByName(out)


def overlay(spreads: DataFrame, benchmark: DataFrame, date: str = "forecast_start_date", value: str = "target") -> DataFrame:
    """Benchmark values on the spread's dates; dates without one go."""
    return spreads.join(benchmark.select(date, F.col(value).alias("benchmark")), date, "left").where("benchmark IS NOT NULL")
