"""Queries through storage: what one job writes and another reads back, and the parts of jobs that plug into others."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from ..operators import calendar, evaluate, portfolio, preprocess, splits, windows
from ..operators.contracts import Roles
from ..operators.forecast import AR1
from ..sources import io
from ..sources.fixtures import panel, predictions
from ..sources.scratch import shared_folder
from . import forecast_queries as fq
from . import panel_queries as pq
from .common import oracle, rounded, sessions_sql

N, S, E, U = pq.N, pq.S, pq.E, pq.U
QUERIES, SQL = {}, {}


def query(sql: str, *doubles: str):
    def register(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, oracle(sql, *doubles)
        return f

    return register


def _path(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"SELECT date, asset_id, ret FROM ({N}) AS p", "ret")
def stored_panel(spark, d):
    """A panel as CSV, read with its schema, and the columns of its roles."""
    path = _path(spark, "panel")
    panel(spark, d, "nation_day").write.option("header", True).csv(path)
    return rounded(io.read_prediction_panel(spark, path, ["ret", "ret"], "asset_id long, date date, level double, ret double"))


@query(f"SELECT p.asset_id, CAST(forecast_start_date AS TIMESTAMP) AS forecast_start_date, mu, sigma, t.ret AS target FROM ({fq.PN}) AS p JOIN ({N}) AS t ON t.asset_id = p.asset_id AND t.date = forecast_start_date", "mu", "sigma", "target")
def stored_predictions(spark, d):
    """Predictions and realized values through Parquet, joined."""
    path = _path(spark, "predictions")
    io.write_predictions(predictions(spark, d, "nation_day"), f"{path}/predictions.parquet")
    panel(spark, d, "nation_day").write.parquet(f"{path}/panel.parquet")
    return rounded(evaluate.join_realized(io.read_predictions(spark, f"{path}/predictions.parquet"), io.read_realized(spark, f"{path}/panel.parquet", "ret")))


@query(pq.SQL["bundle_transform"])
def stored_state(spark, d):
    """A scaler and a vocabulary, saved, loaded and applied. Events of no user have no scaler, but their kinds count."""
    path, p = _path(spark, "state"), panel(spark, d, "user_day").select("asset_id", "date", "ret", "kind")
    of_users = p.where("asset_id IS NOT NULL")
    io.write_state(preprocess.fit_scaler(of_users, ["ret"]), preprocess.fit_vocabulary(p, ["kind"]), path)
    scaler, vocabulary = io.read_state(spark, path)
    return rounded(preprocess.apply_bundle(of_users, scaler, ["ret"], vocabulary, ["kind"]))


@query(f"SELECT CASE WHEN year(forecast_start_date) < 1997 THEN 'train' ELSE 'val' END AS split, asset_id, count(*) AS n_windows, avg(y[1]) AS mean_y, min(forecast_start_date) AS first_date FROM ({pq._windows_sql(S, 5, 1, 1)}) AS w GROUP BY 1, 2", "mean_y")
def stored_windows(spark, d):
    """Windows in a table that is partitioned by split."""
    path = _path(spark, "windows")
    w = windows.make_windows(panel(spark, d, "segment_day"), Roles(("ret",), ("ret",)), 5)
    io.write_windows(w.withColumn("split", F.when(F.year("forecast_start_date") < 1997, "train").otherwise("val")), path)
    back = spark.read.parquet(path)
    return rounded(back.groupBy("split", "asset_id").agg(F.count("*").alias("n_windows"), F.avg(F.get("y", F.lit(0))).alias("mean_y"), F.min("forecast_start_date").alias("first_date")))


@query(fq.METRICS, *evaluate.METRICS)
def stored_metrics(spark, d):
    """Metrics in a table that is partitioned by model."""
    path = _path(spark, "metrics")
    measured = evaluate.metrics(fq._measured(spark, d))
    io.write_metrics(measured, path)
    return rounded(spark.read.parquet(path).select(*measured.columns))


@query(fq.SQL["portfolio_metrics"])
def stored_backtest(spark, d):
    """Weights, returns and metrics of a backtest; the metrics are taken again from what was stored."""
    path, w = _path(spark, "backtest"), fq._equal(spark, d)
    returns = portfolio.portfolio_returns(w)
    io.write_backtest(w, returns, portfolio.portfolio_metrics(returns, w), path)
    stored = portfolio.portfolio_metrics(spark.read.parquet(f"{path}/returns.parquet"), spark.read.parquet(f"{path}/weights.parquet"))
    both = stored.unionByName(spark.read.parquet(f"{path}/metrics.parquet"))
    return rounded(both).distinct()


@query(fq.SQL["cv_grid"])
def stored_trials(spark, d):
    path = _path(spark, "trials")
    io.write_trials(fq._cv(spark, d), path)
    return rounded(spark.read.parquet(path))


@query(f"SELECT 'bagging' AS ensemble_type, 'mean' AS aggregation, CAST(estimator AS INTEGER) AS index, 'estimators/' || estimator AS estimator_manifest_path, oob_loss AS oob_val_loss FROM ({fq.LOSSES}) AS l", "oob_val_loss")
def stored_manifest(spark, d):
    """An ensemble's manifest as JSON, a row for each estimator."""
    path = _path(spark, "manifest")
    one = F.struct(F.col("estimator").cast("int").alias("index"), F.concat(F.lit("estimators/"), "estimator").alias("estimator_manifest_path"), F.col("oob_loss").alias("oob_val_loss"))
    # As many elements as an ensemble has estimators.
    fq._losses(spark, d).agg(F.collect_list(one).alias("estimators")).select(F.lit("bagging").alias("ensemble_type"), F.lit("mean").alias("aggregation"), "estimators").write.json(path)
    return rounded(io.read_manifest(spark, path))


@query(f"""WITH p AS (SELECT p.*, n_regionkey AS region FROM ({N}) AS p JOIN nation ON n_nationkey = asset_id), s AS ({sessions_sql('p')})
  SELECT asset_id, session AS date, ret, g.region FROM (SELECT DISTINCT asset_id, region FROM p) AS g CROSS JOIN s LEFT JOIN (SELECT asset_id, date AS session, ret FROM p) AS q USING (asset_id, session)""", "ret")
def reindex_static(spark, d):
    """A static column fills every session of its asset."""
    region = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("asset_id"), F.col("n_regionkey").alias("region"))
    p = panel(spark, d, "nation_day").select("asset_id", "date", "ret").join(region, "asset_id")
    return rounded(calendar.reindex(p, calendar.sessions_of(p), ["region"]))


@query(f"SELECT p.asset_id, forecast_start_date, mu * scale + mean AS mu, sigma * scale AS sigma FROM ({fq.PN}) AS p JOIN ({pq.SCALER}) AS s ON s.asset_id = p.asset_id", "mu", "sigma")
def unscaled_gaussians(spark, d):
    state = preprocess.fit_scaler(panel(spark, d, "nation_day"), ["ret"])
    return rounded(preprocess.unscale_gaussian(predictions(spark, d, "nation_day").select("asset_id", "forecast_start_date", "mu", "sigma"), state, "ret"))


@query(f"SELECT CAST(unnest(range(4)) AS INTEGER) AS estimator, date, 'in' AS bag FROM ({pq.DATES}) AS q")
def whole_bags(spark, d):
    return splits.no_bootstrap(pq._dates(spark, d), 4)


#: Each nation's own constant in place of its returns: the regressor doesn't vary.
FLAT = f"SELECT asset_id, date, (asset_id + 1) / 100 AS ret FROM ({N}) AS p"


@query(f"SELECT asset_id, max(ret) / (1 + max(ret) ** 2) AS const, max(ret) ** 2 / (1 + max(ret) ** 2) AS phi, max(ret) AS last_value, CAST(0 AS DOUBLE) AS residual_sd FROM ({FLAT}) AS f GROUP BY 1 HAVING count(*) >= 3", "const", "phi", "last_value", "residual_sd")
def ar1_minimum_norm(spark, d):
    """A constant regressor: the shortest solution of the normal equations."""
    p = panel(spark, d, "nation_day").select("asset_id", "date", ((F.col("asset_id") + 1) / 100).alias("ret"))
    return rounded(AR1().fit(p))


def _own_alpha(mu: np.ndarray, sigma: np.ndarray) -> np.ndarray:
    return mu


def _own_risk(x: np.ndarray, ridge: float, relative: bool) -> tuple[np.ndarray, np.ndarray]:
    """No correlations: the sample variances of the window."""
    keep = np.flatnonzero(np.isfinite(x).sum(axis=0) >= 2)
    return keep, np.diag(np.nanvar(x[:, keep], axis=0, ddof=1))


def _own_solver(alpha: np.ndarray, cov: np.ndarray, *_) -> np.ndarray:
    """Weights by inverse variance."""
    w = 1 / np.diag(cov)
    return w / w.sum()


@query(f"""WITH p AS ({E}), i AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS k FROM (SELECT DISTINCT date FROM p) AS q),
  v AS (SELECT asset_id, date, k, ret, var_samp(ret) OVER (PARTITION BY asset_id ORDER BY k RANGE BETWEEN 24 PRECEDING AND 1 PRECEDING) AS v FROM p JOIN i USING (date)),
  f AS (SELECT v.asset_id, v.date, mu, ret, v, count(*) OVER (PARTITION BY v.date) AS n FROM v JOIN ({fq.predictions_sql("event_hour")}) AS f ON f.asset_id = v.asset_id AND f.forecast_start_date = v.date WHERE k >= 24 AND mu IS NOT NULL AND sigma IS NOT NULL AND v IS NOT NULL)
  SELECT date, asset_id, (1 / v) / sum(1 / v) OVER (PARTITION BY date) AS weight, mu AS alpha, ret AS realized_return FROM f WHERE n >= 2""", "weight", "alpha", "realized_return")
def backtest_plugins(spark, d):
    """The caller's own alpha, covariance and solver."""
    f = predictions(spark, d, "event_hour").select("asset_id", "forecast_start_date", "mu", "sigma")
    weights, _, _ = portfolio.backtest(f, panel(spark, d, "event_hour"), portfolio.Backtest(window=24), alpha_fn=_own_alpha, cov_fn=_own_risk, solve_fn=_own_solver)
    return rounded(weights)
