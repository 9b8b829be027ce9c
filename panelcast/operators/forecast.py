"""Baseline forecasters: fit(train) gives a table of parameters, predict(panel, params) the five prediction columns.

Panels have (id, date, target); predictions (forecast_start_date, forecast_end_date, asset_id, mu, sigma). With `by`, for
instance an estimator, training rows, parameters and predictions have these columns as well: fit makes parameters for each
(by…, id), and predict gives a panel (without them) to each of its id's parameters.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .contracts import ContractError


@dataclass(frozen=True)
class Columns:
    id: str = "asset_id"
    date: str = "date"
    target: str = "ret"


class Forecaster(Protocol):
    columns: Columns

    def fit(self, train: DataFrame, by=()) -> DataFrame: ...

    def predict(self, panel: DataFrame, params: DataFrame, by=()) -> DataFrame: ...


def as_predictions(df: DataFrame, c: Columns, mu: Column, sigma: Column | None = None, by=()) -> DataFrame:
    sigma = F.lit(None) if sigma is None else sigma
    return df.select(*by, F.col(c.date).alias("forecast_start_date"), F.col(c.date).alias("forecast_end_date"), F.col(c.id).alias("asset_id"), mu.cast("double").alias("mu"), sigma.cast("double").alias("sigma"))


@dataclass(frozen=True)
class UnconditionalMean:
    """The mean of each id's training values; an unseen id keeps its rows, with null mu."""

    columns: Columns = Columns()
    gaussian: bool = False  # sigma: the training values' population deviation

    def fit(self, train: DataFrame, by=()) -> DataFrame:
        c = self.columns
        return train.groupBy(*by, c.id).agg(F.avg(c.target).alias("mean"), F.stddev_pop(c.target).alias("deviation"))

    def predict(self, panel: DataFrame, params: DataFrame, by=()) -> DataFrame:
        c = self.columns
        return as_predictions(panel.select(c.id, c.date).join(params, c.id, "left"), c, F.col("mean"), F.col("deviation") if self.gaussian else None, by)


@dataclass(frozen=True)
class AR1:
    """Least squares of each value on the one before it, nulls dropped first. The previous value of a forecast is the
    last one known strictly before its date, else the last training value. Unseen ids are dropped. With fewer than
    three values the constant is their mean (0 without any); a constant regressor gets the minimum-norm solution."""

    columns: Columns = Columns()
    gaussian: bool = False  # sigma from the residuals
    carry: bool = True  # the last training value stands for an absent previous one

    def fit(self, train: DataFrame, by=()) -> DataFrame:
        c = self.columns
        keys = [*by, c.id]
        y = F.col(c.target).cast("double")
        rows = train.select(*keys, F.col(c.date).alias("__d"), y.alias("__y"))
        known = rows.where("__y IS NOT NULL").withColumn("__x", F.lag("__y").over(Window.partitionBy(*keys).orderBy("__d")))
        fits = known.groupBy(*keys).agg(
            F.count("*").alias("n"), F.avg("__y").alias("mean"), F.max_by("__y", "__d").alias("last_value"),
            F.regr_slope("__y", "__x").alias("slope"), F.regr_intercept("__y", "__x").alias("intercept"),
            F.var_pop("__x").alias("vx"), F.avg("__x").alias("mx"), F.avg(F.when(F.col("__x").isNotNull(), F.col("__y"))).alias("my"),
            F.var_pop(F.when(F.col("__x").isNotNull(), F.col("__y"))).alias("vy"), F.covar_pop("__y", "__x").alias("cxy"),
        )
        few, flat = F.col("n") < 3, F.col("vx") == 0
        norm = 1 + F.col("mx") * F.col("mx")
        const = F.when(few, F.col("mean")).when(flat, F.col("my") / norm).otherwise(F.col("intercept"))
        phi = F.when(few, 0.0).when(flat, F.col("my") * F.col("mx") / norm).otherwise(F.col("slope"))
        rest = F.when(few, None).otherwise(F.sqrt(F.greatest(F.lit(0.0), F.col("vy") - F.coalesce(phi, F.lit(0.0)) * F.when(flat, 0.0).otherwise(F.col("cxy")))))
        fits = fits.select(*keys, F.coalesce(const, F.lit(0.0)).alias("const"), F.coalesce(phi, F.lit(0.0)).alias("phi"), "last_value", rest.alias("residual_sd"))
        # Ids whose values are all null have constant 0.
        return rows.select(*keys).distinct().join(fits, keys, "left").select(*keys, F.coalesce("const", F.lit(0.0)).alias("const"), F.coalesce("phi", F.lit(0.0)).alias("phi"), "last_value", "residual_sd")

    def predict(self, panel: DataFrame, params: DataFrame, by=()) -> DataFrame:
        """The window runs over the panel once, before `by` multiplies its rows."""
        c = self.columns
        before = Window.partitionBy(c.id).orderBy(c.date).rowsBetween(Window.unboundedPreceding, -1)
        known = panel.select(c.id, c.date, F.last(c.target, ignorenulls=True).over(before).alias("__before"))
        joined = known.join(params, c.id)
        previous = F.coalesce("__before", "last_value") if self.carry else F.col("__before")
        mu = F.col("const") + F.col("phi") * previous
        # Without any value before, a zero slope still gives the constant.
        mu = F.when(previous.isNull() & (F.col("phi") == 0), F.col("const")).otherwise(mu)
        return as_predictions(joined, c, mu, F.col("residual_sd") if self.gaussian else None, by)


def forecaster(name: str, columns: Columns = Columns(), gaussian: bool = False, carry: bool = True) -> Forecaster:
    """A forecaster by name. gaussian: with a sigma, which garch always has; carry: forecasts go on from where the
    training rows ended, as they should when the panel comes after them."""
    from .garch import Garch11

    kinds = {"unconditional_mean": lambda: UnconditionalMean(columns, gaussian), "ar1": lambda: AR1(columns, gaussian, carry), "garch": lambda: Garch11(columns, carry=carry)}
    if name not in kinds:
        raise ContractError(f"no forecaster {name}; there are {sorted(kinds)}")
    return kinds[name]()


def run_forecaster(model: Forecaster, train: DataFrame, test: DataFrame) -> DataFrame:
    return model.predict(test, model.fit(train))
