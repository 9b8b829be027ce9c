"""Ensembles of Gaussian forecasts and bagging over dates and assets, keyed by estimator in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import preprocess
from .contracts import ContractError
from .forecast import AR1, Columns, Forecaster

KEYS = ["asset_id", "forecast_start_date"]


def aggregate_gaussians(stacked: DataFrame, mode: str = "mean", by=("asset_id", "forecast_start_date", "forecast_end_date")) -> DataFrame:
    """One Gaussian per key of several members' (mu, sigma): mu by mean or median, variance = mean of variances +
    population variance of the means (in both modes)."""
    if mode not in ("mean", "median"):
        raise ContractError(f"no mode {mode}")
    middle = F.avg("mu") if mode == "mean" else F.median("mu")
    return stacked.groupBy(*by).agg(middle.alias("mu"), F.sqrt(F.avg(F.col("sigma") * F.col("sigma")) + F.var_pop("mu")).alias("sigma"), F.count("*").alias("n_members"))


def check_aligned(stacked: DataFrame, members: int) -> None:
    """Fails unless every (asset, date) has each member once."""
    bad = stacked.groupBy(*KEYS).agg(F.count("*").alias("n")).where(F.col("n") != members).limit(1).collect()
    if bad:
        raise ContractError(f"members aren't aligned: {bad[0].asDict()}")


def prune(losses: DataFrame, keep: int, loss: str = "oob_loss", estimator: str = "estimator") -> DataFrame:
    """The rows with the lowest losses, null last, in that order."""
    if keep < 1:
        raise ContractError("keep must be at least 1")
    return losses.orderBy(F.col(loss).asc_nulls_last(), estimator).limit(keep)


def leaderboard(losses: DataFrame, top: int = 10, keep: int | None = None, loss: str = "oob_loss", key: str = "estimator", ascending: bool = True, by=()) -> DataFrame:
    """Rank and retained flag of the best rows (by group, if by is given)."""
    order = F.col(loss).asc_nulls_last() if ascending else F.col(loss).desc_nulls_last()
    rank = F.row_number().over(Window.partitionBy(*(by or [F.lit(0)])).orderBy(order, key))
    limit = top if keep is None else keep
    best = losses if by else losses.orderBy(order, key).limit(top)
    return best.withColumn("rank", rank).where(F.col("rank") <= top).withColumn("retained", F.col("rank") <= limit)


def loss_summary(losses: DataFrame, loss: str = "oob_loss", by=()) -> DataFrame:
    return losses.groupBy(*by).agg(F.avg(loss).alias("mean_loss"), F.stddev_pop(loss).alias("std_loss"), F.count("*").alias("n"))


def best_trial(trials: DataFrame, direction: str = "minimize", value: str = "value", by=()) -> DataFrame:
    """The trial with the best value; of equal ones, the first."""
    if direction not in ("minimize", "maximize"):
        raise ContractError(f"no direction {direction}")
    sign = 1 if direction == "minimize" else -1
    pick = F.min_by(F.struct(*trials.columns), F.struct(sign * F.col(value), F.col("trial_number")))
    return trials.where(F.col(value).isNotNull()).groupBy(*by).agg(pick.alias("b")).select("b.*")


def bag_scalers(panel: DataFrame, bags: DataFrame, columns, assets: DataFrame | None = None, id: str = "asset_id", date: str = "date") -> DataFrame:
    """Scaler state by (estimator, id, feature), on each estimator's in-bag dates and assets; fails if all are empty."""
    rows = panel.join(bags.where("bag = 'in'").select("estimator", date), date)
    if assets is not None:
        rows = rows.join(assets, ["estimator", id], "left_semi")
    state = preprocess.fit_scaler(rows, columns, id, by=["estimator"])
    if state.isEmpty():
        raise ContractError("no rows in any bag")
    return state


def bag_windows(windows: DataFrame, bags: DataFrame, assets: DataFrame | None = None, id: str = "asset_id", date: str = "date") -> DataFrame:
    """Windows with each (estimator, bag) that their forecast date is in."""
    out = windows.join(bags.withColumnRenamed(date, "forecast_start_date"), "forecast_start_date")
    return out if assets is None else out.join(assets, ["estimator", id], "left_semi")


def bag(panel: DataFrame, bags: DataFrame, model: Forecaster, keep: int, mode: str = "mean", assets: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Bagging of any forecaster with a sigma: each estimator is fitted on its in-bag dates (and assets, if given); its
    loss is the mean NLL (without constants) on its other dates; the best `keep` are aggregated over the whole panel.
    Returns (losses, survivors, ensemble predictions). One plan keyed by (estimator, id), no loop over estimators. The
    model should not carry training values into its forecasts, since the panel holds the training dates themselves."""
    c = model.columns
    own = panel.select(c.id, c.date, c.target)
    inside = own.join(bags.where("bag = 'in'").select("estimator", c.date), c.date)
    if assets is not None:
        inside = inside.join(assets.select("estimator", c.id), ["estimator", c.id], "left_semi")
    members = model.predict(own, model.fit(inside, by=["estimator"]), by=["estimator"]).where("mu IS NOT NULL AND sigma > 0")
    outside = bags.where("bag = 'oob'").select("estimator", F.col(c.date).alias("forecast_start_date"))
    truth = own.where(F.col(c.target).isNotNull()).select(F.col(c.id).alias("asset_id"), F.col(c.date).alias("forecast_start_date"), F.col(c.target).cast("double").alias("target"))
    r = F.col("target") - F.col("mu")
    nll = r * r / (F.col("sigma") * F.col("sigma")) + F.log(F.col("sigma") * F.col("sigma"))
    measured = members.join(outside, ["estimator", "forecast_start_date"]).join(truth, KEYS).groupBy("estimator").agg(F.avg(nll).alias("oob_loss"))
    losses = bags.select("estimator").distinct().join(measured, "estimator", "left")
    survivors = prune(losses, keep)
    kept = members.join(F.broadcast(survivors.select("estimator")), "estimator", "left_semi")  # `keep` rows
    return losses, survivors, aggregate_gaussians(kept, mode)


def bag_ar1(panel: DataFrame, bags: DataFrame, keep: int, mode: str = "mean", columns: Columns = Columns()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """bag of a Gaussian AR(1)."""
    return bag(panel, bags, AR1(columns, gaussian=True, carry=False), keep, mode)
