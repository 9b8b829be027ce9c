"""Evaluation of Gaussian forecasts: row terms, metrics, skill, calibration, volatility."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import gaussian
from .contracts import ContractError
from .recurrence import ROWS, Recursion, scan

KEYS = ["asset_id", "forecast_start_date"]
LEVELS = (0.50, 0.60, 0.6827, 0.80, 0.90, 0.9545, 0.99)
#: Powers of a decay that are taken from a table: the JVM's pow is an ulp off now and then, others' are not.
POWERS = 256
METRICS = ("mean_nll", "crps", "mae_mu", "rmse_mu", "bias_mu", "coverage_1s", "coverage_2s", "sigma_mean")


def stack_models(models: dict[str, DataFrame]) -> DataFrame:
    out = None
    for label, predictions in models.items():
        part = predictions.withColumn("model", F.lit(label))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ContractError("no models")
    return out


def realized(panel: DataFrame, target: str = "ret", id: str = "asset_id", date: str = "date") -> DataFrame:
    return panel.select(F.col(id).alias("asset_id"), F.col(date).alias("forecast_start_date"), F.col(target).cast("double").alias("target"))


def join_realized(predictions: DataFrame, truth: DataFrame, reference: str | None = None) -> DataFrame:
    """Inner join; rows with a null target stay. Models stacked before need this one join only. Fails if the reference
    model matches nothing; other models without a match just don't appear."""
    out = predictions.join(truth, KEYS)
    if reference is not None and out.where(F.col("model") == reference).isEmpty():
        raise ContractError(f"no realized value for model {reference}")
    return out


def row_terms(df: DataFrame) -> DataFrame:
    """Adds nll, crps, abs_err, sq_err, bias, in_1s, in_2s. Density terms need sigma > 0. A null target counts as
    outside the interval, a null sigma as unknown."""
    known = F.col("sigma") > 0
    rows = df.withColumn("resid", F.col("target") - F.col("mu")).withColumn("z", F.when(known, F.col("resid") / F.col("sigma")))
    # erf of z / sqrt 2 in a column of its own: the expression repeats its argument.
    rows = rows.withColumn("z2", F.col("z") / gaussian.SQRT_2).withColumn("e", F.expr(gaussian.erf("z2")))
    crps = F.col("sigma") * (F.col("z") * F.col("e") + 2 * F.expr(gaussian.pdf("z")) - gaussian.INV_SQRT_PI)
    nll = 0.5 * F.log(2 * F.pi() * F.col("sigma") * F.col("sigma")) + 0.5 * F.col("z") * F.col("z")
    inside = lambda k: F.when(F.col("sigma").isNotNull(), F.coalesce(F.abs("resid") <= k * F.col("sigma"), F.lit(False)).cast("double"))
    return rows.withColumns({
        "nll": F.when(known, nll), "crps": F.when(known, crps), "abs_err": F.abs("resid"), "sq_err": F.col("resid") * F.col("resid"),
        "bias": -F.col("resid"), "in_1s": inside(1), "in_2s": inside(2),
    }).drop("z2", "e")


def _aggregates() -> list[Column]:
    return [
        F.count("*").alias("n_rows"), F.avg("nll").alias("mean_nll"), F.avg("crps").alias("crps"), F.avg("abs_err").alias("mae_mu"),
        F.sqrt(F.avg("sq_err")).alias("rmse_mu"), F.avg("bias").alias("bias_mu"), F.avg("in_1s").alias("coverage_1s"), F.avg("in_2s").alias("coverage_2s"), F.avg("sigma").alias("sigma_mean"),
    ]


def metrics(joined: DataFrame) -> DataFrame:
    """A row per model (asset_id null, is_overall) and per (model, asset), from one grouping-sets aggregation."""
    rows = row_terms(joined)
    sets = rows.groupingSets([["model"], ["model", "asset_id"]], "model", "asset_id")
    return sets.agg((F.grouping_id() > 0).alias("is_overall"), *_aggregates())


def skill(measured: DataFrame, reference: str) -> DataFrame:
    """Adds rmse_skill = rmse / rmse of the reference model (same asset, or overall); null without one or for 0."""
    ref = measured.where(F.col("model") == reference).select(F.col("asset_id").alias("__a"), F.col("is_overall").alias("__o"), F.col("rmse_mu").alias("__r"))
    joined = measured.join(ref, measured["asset_id"].eqNullSafe(ref["__a"]) & (measured["is_overall"] == ref["__o"]), "left")
    return joined.withColumn("rmse_skill", F.try_divide("rmse_mu", "__r")).drop("__a", "__o", "__r")


def describe_range(predictions: DataFrame) -> DataFrame:
    return predictions.agg(F.min("forecast_start_date").alias("first_date"), F.max("forecast_start_date").alias("last_date"), F.count_distinct("asset_id").alias("n_assets"))


def reliability(joined: DataFrame, levels=LEVELS, by=()) -> DataFrame:
    """(by…, nominal, half_width, empirical): share of |z| within each nominal level's half width, in one pass over
    the finite rows with sigma > 0."""
    widths = [gaussian.half_width(level) for level in levels]
    z = F.abs((F.col("target") - F.col("mu")) / F.col("sigma"))
    rows = joined.where((F.col("sigma") > 0) & F.col("target").isNotNull() & F.col("mu").isNotNull()).withColumn("z", z)
    wide = rows.groupBy(*by).agg(*[F.avg((F.col("z") <= w).cast("double")).alias(f"e{k}") for k, w in enumerate(widths)])
    rows = F.array(*[F.struct(F.lit(level).alias("nominal"), F.lit(w).alias("half_width"), F.col(f"e{k}").alias("empirical")) for k, (level, w) in enumerate(zip(levels, widths))])
    return wide.select(*by, F.inline(rows))


def masked_losses(df: DataFrame, by=(), mask: str = "mask") -> DataFrame:
    """Gaussian NLL (without its constants), MSE and MAE over the cells where the mask holds; fails without any."""
    r = F.col("target") - F.col("mu")
    out = df.where(mask).groupBy(*by).agg(F.avg(r * r / (F.col("sigma") * F.col("sigma")) + F.log(F.col("sigma") * F.col("sigma"))).alias("nll"), F.avg(r * r).alias("mse"), F.avg(F.abs(r)).alias("mae"), F.count("*").alias("n"))
    if not by and out.first()["n"] == 0:
        raise ContractError("no valid target")
    return out


def realized_vol(panel: DataFrame, window: int = 20, target: str = "ret", id: str = "asset_id", date: str = "date") -> DataFrame:
    """Root mean square of the last `window` rows' values, where two at least are known."""
    w = Window.partitionBy(id).orderBy(date).rowsBetween(-(window - 1), 0)
    y = F.col(target)
    return panel.withColumn("vol", F.when(F.count(y).over(w) >= 2, F.sqrt(F.avg(y * y).over(w))))


def _weighted(decay: float) -> Recursion:
    """State: the average s of squares of y and the rows since the last known one. An old average weighs decay^(gap + 1)
    against 1 - decay of a new square. Summary of a run: the rows before its first square, that square, and the affine
    map of all later ones. The steps round as the formula is written, (old s + new y y) / (old + new), so that a chunk
    that is walked from its start gives the last digit of a plain loop too."""
    decay = float(decay)
    new = float(1 - Decimal(repr(decay)))
    table = F.expr("array({})".format(", ".join(f"{decay**k!r}D" for k in range(1, POWERS + 1))))

    def weight(gap: Column) -> Column:
        return F.when(gap < POWERS, F.get(table, gap.cast("int"))).otherwise(F.pow(F.lit(decay), gap + 1))

    def average(s: Column, gap: Column, y: Column) -> Column:
        return (weight(gap) * s + new * y * y) / (weight(gap) + new)

    def then(now: Column, row: Column) -> Column:
        known = F.when(now["s"].isNull(), row["__y"] * row["__y"]).otherwise(average(now["s"], now["gap"], row["__y"]))
        return F.when(row["__y"].isNull(), F.struct(now["s"].alias("s"), (now["gap"] + 1).alias("gap"))).otherwise(F.struct(known.alias("s"), F.lit(0).alias("gap")))

    def none() -> Column:
        return F.struct(F.lit(0).alias("skipped"), F.lit(None).alias("first"), F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0).alias("gap"))

    def add(m: Column, row: Column) -> Column:
        a = weight(m["gap"]) / (weight(m["gap"]) + new)
        part = lambda skipped, first, a, b, gap: F.struct(skipped.alias("skipped"), first.alias("first"), a.alias("a"), b.alias("b"), gap.alias("gap"))
        unknown, started = row["__y"].isNull(), m["first"].isNotNull()
        return (
            F.when(unknown & ~started, part(m["skipped"] + 1, m["first"], m["a"], m["b"], m["gap"]))
            .when(unknown, part(m["skipped"], m["first"], m["a"], m["b"], m["gap"] + 1))
            .when(~started, part(m["skipped"], row["__y"], m["a"], m["b"], m["gap"]))
            .otherwise(part(m["skipped"], m["first"], a * m["a"], average(m["b"], m["gap"], row["__y"]), F.lit(0).cast("bigint")))
        )

    def carry(now: Column, m: Column) -> Column:
        at_first = then(F.struct(now["s"].alias("s"), (now["gap"] + m["skipped"]).alias("gap")), F.struct(m["first"].alias("__y")))
        return F.when(m["first"].isNull(), F.struct(now["s"].alias("s"), (now["gap"] + m["skipped"]).alias("gap"))).otherwise(F.struct((m["a"] * at_first["s"] + m["b"]).alias("s"), m["gap"].alias("gap")))

    return Recursion("struct<s:double,gap:bigint>", "struct<skipped:bigint,first:double,a:double,b:double,gap:bigint>", then, none, add, carry)


def ewma_vol(panel: DataFrame, decay: float = 0.94, target: str = "ret", id: str = "asset_id", date: str = "date", rows: int = ROWS, nan_is_gap: bool = True) -> DataFrame:
    """Adds ewma_vol, the root of s = (old weight x s + (1 - decay) y^2) / (sum of both), where the old weight decays
    with each row, also over gaps (null or NaN), which keep the value; null before the first known value. Without
    nan_is_gap, NaN is a value, after which all are NaN. A scan in chunks of `rows` dates."""
    if not 0 < decay < 1:
        raise ContractError("the decay must be in (0, 1)")
    how, y = _weighted(decay), F.col(target).cast("double")
    values = panel.withColumn("__y", F.when(~F.isnan(y), y) if nan_is_gap else y)
    first = F.struct(F.lit(None).alias("s"), F.lit(0).alias("gap"))
    out = scan(values, how, first, "__before", [id], date, rows)
    return out.withColumn("ewma_vol", F.sqrt(how.next(F.col("__before"), F.struct("__y"))["s"])).select(*panel.columns, "ewma_vol")


def bands(predictions: DataFrame) -> DataFrame:
    """mu ± k sigma, k = 1, 2; fails with fewer than two forecast dates."""
    if len(predictions.select("forecast_start_date").distinct().limit(2).collect()) < 2:
        raise ContractError("fewer than two forecast dates")
    m, s = F.col("mu"), F.col("sigma")
    return predictions.withColumns({"lower_1s": m - s, "upper_1s": m + s, "lower_2s": m - 2 * s, "upper_2s": m + 2 * s})


def risk_signal(predictions: DataFrame) -> DataFrame:
    """signal = mu / sigma clipped to ±3 (null for sigma 0), and color = tanh(signal / max(q75 of |signal|, 0.05)) by
    asset, 0 without a signal."""
    raw = F.try_divide("mu", "sigma")
    rows = predictions.withColumn("signal", F.when(raw.isNotNull(), F.greatest(F.lit(-3.0), F.least(F.lit(3.0), raw))))
    q75 = rows.groupBy("asset_id").agg(F.percentile(F.abs("signal"), F.lit(0.75)).alias("q75"))
    color = F.tanh(F.col("signal") / F.greatest(F.col("q75"), F.lit(0.05)))
    return rows.join(q75, "asset_id").withColumn("color", F.coalesce(color, F.lit(0.0))).drop("q75")
