"""Queries on forecasts: baselines, evaluation, signals, ensembles, tuning, portfolios."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import gaussian
from ..operators import calendar, ensemble, evaluate, portfolio, signal, splits, tuning, windows
from ..operators.contracts import Roles
from ..operators.forecast import AR1, UnconditionalMean, forecaster, run_forecaster
from ..operators.garch import Garch11, neighbourhood
from ..sources.fixtures import panel, predictions
from .common import oracle, panel_sql, predictions_sql, rounded
from .panel_queries import _windows_sql, bags_sql

N, S, E, U = (panel_sql(n) for n in ("nation_day", "segment_day", "event_hour", "user_day"))
PN, PU = predictions_sql("nation_day"), predictions_sql("user_day")
QUERIES, SQL = {}, {}
#: Train up to here, test from the next day on.
CUT = "2000-06-30"


def query(sql: str | None = None, *doubles: str):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = oracle(sql, *doubles)
        return f

    return register


def _split(spark, d):
    p = panel(spark, d, "nation_day").select("asset_id", "date", "ret")
    # The training rows lack one nation, so that the test has an unseen asset.
    return p.where(f"date <= DATE '{CUT}' AND asset_id <> 7"), p.where(f"date > DATE '{CUT}'")


TRAIN, TEST = f"SELECT * FROM ({N}) AS p WHERE date <= DATE '{CUT}' AND asset_id <> 7", f"SELECT * FROM ({N}) AS p WHERE date > DATE '{CUT}'"
MEAN = f"SELECT date AS forecast_start_date, date AS forecast_end_date, asset_id, mean AS mu, CAST(NULL AS DOUBLE) AS sigma FROM ({TEST}) AS t LEFT JOIN (SELECT asset_id, avg(ret) AS mean FROM ({TRAIN}) AS r GROUP BY 1) AS m USING (asset_id)"
AR_FIT = f"""SELECT asset_id, regr_slope(y, x) AS phi, regr_intercept(y, x) AS const, arg_max(y, date) AS last_value,
  sqrt(greatest(0, var_pop(CASE WHEN x IS NOT NULL THEN y END) - regr_slope(y, x) * covar_pop(y, x))) AS sd
  FROM (SELECT asset_id, date, ret AS y, lag(ret) OVER (PARTITION BY asset_id ORDER BY date) AS x FROM ({TRAIN}) AS r WHERE ret IS NOT NULL) AS l GROUP BY 1"""


def _ar_sql(sigma: str) -> str:
    return f"""SELECT date AS forecast_start_date, date AS forecast_end_date, asset_id, const + phi * coalesce(prev, last_value) AS mu, {sigma} AS sigma FROM (
      SELECT asset_id, date, last_value(ret IGNORE NULLS) OVER (PARTITION BY asset_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM ({TEST}) AS t) AS k JOIN ({AR_FIT}) AS f USING (asset_id)"""


@query(MEAN, "mu", "sigma")
def forecast_mean(spark, d):
    return rounded(run_forecaster(UnconditionalMean(), *_split(spark, d)))


@query(_ar_sql("CAST(NULL AS DOUBLE)"), "mu", "sigma")
def forecast_ar1(spark, d):
    return rounded(run_forecaster(AR1(), *_split(spark, d)))


@query(_ar_sql("sd"), "mu", "sigma")
def forecast_ar1_gaussian(spark, d):
    return rounded(run_forecaster(AR1(gaussian=True), *_split(spark, d)))


def _hours(spark, d):
    p = panel(spark, d, "event_hour").select("asset_id", "date", "ret")
    return p.where("date < TIMESTAMP '2024-01-24'"), p.where("date >= TIMESTAMP '2024-01-24'")


@query()
def forecast_garch(spark, d):
    return rounded(run_forecaster(Garch11(), *_hours(spark, d)))


#: Parameters from simple statistics of the training hours; returns in per cent.
GARCH = f"""SELECT asset_id, avg(100 * ret) AS mu, 0.1 * var_pop(100 * ret) AS omega, 0.1 AS alpha, 0.8 AS beta, var_pop(100 * ret) AS start
  FROM ({E}) AS p WHERE date < TIMESTAMP '2024-01-24' AND ret IS NOT NULL GROUP BY 1 HAVING count(*) >= 60"""


def _variances_sql(rows: str, keys: str, carried: str) -> str:
    """Rows (keys, carried, date, y, n from 1) with the variance v just before each, by recursion."""
    joined = " AND ".join(f"s.{k.strip()} = r.{k.strip()}" for k in keys.split(","))
    columns = ", ".join(f"r.{k.strip()}" for k in f"{keys}, {carried}".split(","))
    return f"""WITH RECURSIVE r AS ({rows}),
      s AS (SELECT {columns}, r.date, r.y, r.n, r.start AS v FROM r WHERE n = 1
            UNION ALL SELECT {columns}, r.date, r.y, r.n, CASE WHEN s.y IS NULL THEN s.v ELSE r.omega + r.alpha * (s.y - r.mu) ** 2 + r.beta * s.v END FROM s JOIN r ON {joined} AND r.n = s.n + 1)
      SELECT * FROM s"""


def _moments(train):
    """The parameters that GARCH states."""
    known = train.where("ret IS NOT NULL").groupBy("asset_id").agg(F.avg(100 * F.col("ret")).alias("mu"), F.var_pop(100 * F.col("ret")).alias("start"), F.count("*").alias("n")).where("n >= 60")
    return known.select("asset_id", "mu", (0.1 * F.col("start")).alias("omega"), F.lit(0.1).alias("alpha"), F.lit(0.8).alias("beta"), F.col("start").alias("variance"), "start")


@query(f"""SELECT date AS forecast_start_date, date AS forecast_end_date, asset_id, mu / 100 AS mu, sqrt(v) / 100 AS sigma FROM (
  {_variances_sql(f"SELECT p.asset_id, date, 100 * ret AS y, row_number() OVER (PARTITION BY p.asset_id ORDER BY date) AS n, mu, omega, alpha, beta, start FROM ({E}) AS p JOIN ({GARCH}) AS g USING (asset_id)", "asset_id", "mu, omega, alpha, beta")}) AS w""", "mu", "sigma")
def garch_roll(spark, d):
    train, _ = _hours(spark, d)
    return rounded(Garch11().predict(panel(spark, d, "event_hour").select("asset_id", "date", "ret"), _moments(train)))


SHAPES = [(a, b) for a in (0.05, 0.15, 0.3) for b in (0.2, 0.5, 0.65)]
_SHAPES = ", ".join(f"({k}, {a}, {b})" for k, (a, b) in enumerate(SHAPES))


@query(f"""SELECT asset_id, max(n) AS n, max(l) AS best_of_grid, TRUE AS not_below_grid, TRUE AS not_below_neighbours FROM (
  SELECT asset_id, k, count(*) AS n, sum(-0.5 * (ln(2 * pi()) + ln(greatest(v, 1e-12)) + (y - mu) ** 2 / greatest(v, 1e-12))) AS l FROM (
    {_variances_sql(f"SELECT p.asset_id, k, date, 100 * ret AS y, row_number() OVER (PARTITION BY p.asset_id, k ORDER BY date) AS n, mu, start * (1 - a - b) AS omega, a AS alpha, b AS beta, start FROM ({E}) AS p JOIN ({GARCH}) AS g USING (asset_id) CROSS JOIN (VALUES {_SHAPES}) AS c(k, a, b) WHERE date < TIMESTAMP '2024-01-24' AND ret IS NOT NULL", "asset_id, k", "mu, omega, alpha, beta")}) AS w GROUP BY 1, 2) AS t GROUP BY 1""", "best_of_grid")
def garch_optimality(spark, d):
    """The fit's likelihood against that of a grid over alpha and beta, and of steps of 2 % away from the fit."""
    train, _ = _hours(spark, d)
    model = Garch11()
    shapes = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(a).alias("a"), F.lit(b).alias("b")) for k, (a, b) in enumerate(SHAPES)])
    simple = _moments(train).select("asset_id", "mu", "start", F.inline(shapes)).select("asset_id", "k", "mu", (F.col("start") * (1 - F.col("a") - F.col("b"))).alias("omega"), F.col("a").alias("alpha"), F.col("b").alias("beta"), "start")
    grid = model.log_likelihood(train, simple, by=["k"]).groupBy("asset_id").agg(F.max("n").alias("n"), F.max("log_likelihood").alias("best_of_grid"))
    around = model.log_likelihood(train, neighbourhood(model.fit(train).drop("variance")), by=["candidate"])
    fitted = around.groupBy("asset_id").agg(F.max(F.when(F.col("candidate") == 0, F.col("log_likelihood"))).alias("fit"), F.max(F.when(F.col("candidate") > 0, F.col("log_likelihood"))).alias("near"))
    close = 1e-5  # of a log likelihood; the search stops at such differences
    out = grid.join(fitted, "asset_id", "left")
    return rounded(out.select("asset_id", "n", "best_of_grid", (F.col("fit") >= F.col("best_of_grid") - close).alias("not_below_grid"), (F.col("fit") >= F.col("near") - close).alias("not_below_neighbours")))


def _measured(spark, d):
    """Two models on one panel, stacked and joined with the realized values once."""
    train, test = _split(spark, d)
    models = {"rolling": predictions(spark, d, "nation_day").where(f"forecast_start_date > DATE '{CUT}'"), "ar1": run_forecaster(AR1(gaussian=True), train, test)}
    return evaluate.join_realized(evaluate.stack_models({k: v.select("forecast_start_date", "forecast_end_date", "asset_id", "mu", "sigma") for k, v in models.items()}), evaluate.realized(test))


STACK = f"""SELECT 'rolling' AS model, forecast_start_date, asset_id, mu, sigma FROM ({PN}) AS p WHERE forecast_start_date > DATE '{CUT}'
  UNION ALL SELECT 'ar1', forecast_start_date, asset_id, mu, sigma FROM ({_ar_sql("sd")}) AS a"""
JOINED = f"SELECT model, forecast_start_date, asset_id, mu, sigma, t.ret AS target, t.ret - mu AS resid, CASE WHEN sigma > 0 THEN (t.ret - mu) / sigma END AS z FROM ({STACK}) AS m JOIN ({TEST}) AS t ON t.asset_id = m.asset_id AND t.date = forecast_start_date".replace(", asset_id, mu", ", m.asset_id, mu", 1)
TERMS = f"""SELECT *, CASE WHEN sigma > 0 THEN 0.5 * ln(2 * pi() * sigma * sigma) + 0.5 * z * z END AS nll,
  CASE WHEN sigma > 0 THEN sigma * (z * ({gaussian.erf("z2")}) + 2 * {gaussian.pdf("z")} - {gaussian.INV_SQRT_PI!r}) END AS crps,
  CASE WHEN sigma IS NOT NULL THEN CASE WHEN abs(resid) <= sigma THEN 1.0 ELSE 0.0 END END AS in_1s,
  CASE WHEN sigma IS NOT NULL THEN CASE WHEN abs(resid) <= 2 * sigma THEN 1.0 ELSE 0.0 END END AS in_2s FROM (SELECT *, z / {gaussian.SQRT_2!r} AS z2 FROM ({JOINED}) AS j) AS k"""
METRICS = f"""SELECT model, asset_id, grouping(asset_id) = 1 AS is_overall, count(*) AS n_rows, avg(nll) AS mean_nll, avg(crps) AS crps, avg(abs(resid)) AS mae_mu, sqrt(avg(resid * resid)) AS rmse_mu,
  avg(-resid) AS bias_mu, avg(in_1s) AS coverage_1s, avg(in_2s) AS coverage_2s, avg(sigma) AS sigma_mean FROM ({TERMS}) AS t GROUP BY GROUPING SETS ((model), (model, asset_id))"""


@query(METRICS, *evaluate.METRICS)
def metrics_overall_and_asset(spark, d):
    return rounded(evaluate.metrics(_measured(spark, d)))


@query(f"WITH m AS ({METRICS}) SELECT m.*, m.rmse_mu / nullif(r.rmse_mu, 0) AS rmse_skill FROM m LEFT JOIN (SELECT * FROM m WHERE model = 'rolling') AS r ON m.asset_id IS NOT DISTINCT FROM r.asset_id AND m.is_overall = r.is_overall", *evaluate.METRICS, "rmse_skill")
def metrics_skill(spark, d):
    return rounded(evaluate.skill(evaluate.metrics(_measured(spark, d)), "rolling"))


@query(f"SELECT min(forecast_start_date) AS first_date, max(forecast_start_date) AS last_date, count(DISTINCT asset_id) AS n_assets FROM ({PN}) AS p")
def forecast_range(spark, d):
    return evaluate.describe_range(predictions(spark, d, "nation_day"))


@query(f"SELECT model, avg(resid * resid / (sigma * sigma) + ln(sigma * sigma)) AS nll, avg(resid * resid) AS mse, avg(abs(resid)) AS mae, count(*) AS n FROM ({JOINED}) AS j WHERE target IS NOT NULL AND sigma > 0 GROUP BY 1", "nll", "mse", "mae")
def masked_losses(spark, d):
    rows = _measured(spark, d).withColumn("mask", F.col("target").isNotNull() & (F.col("sigma") > 0))
    return rounded(evaluate.masked_losses(rows, by=["model"]))


LEVELS = ", ".join(f"({level!r}, {gaussian.half_width(level)!r})" for level in evaluate.LEVELS)


@query(f"SELECT model, CAST(nominal AS DOUBLE) AS nominal, CAST(half_width AS DOUBLE) AS half_width, avg(CASE WHEN abs(z) <= half_width THEN 1.0 ELSE 0.0 END) AS empirical FROM ({JOINED}) AS j CROSS JOIN (VALUES {LEVELS}) AS l(nominal, half_width) WHERE z IS NOT NULL GROUP BY 1, 2, 3", "nominal", "half_width", "empirical")
def reliability(spark, d):
    return rounded(evaluate.reliability(_measured(spark, d), by=["model"]))


@query(f"SELECT asset_id, date, CASE WHEN count(ret) OVER w >= 2 THEN sqrt(avg(ret * ret) OVER w) END AS vol FROM ({E}) AS p WINDOW w AS (PARTITION BY asset_id ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)", "vol")
def realized_vol(spark, d):
    return rounded(evaluate.realized_vol(panel(spark, d, "event_hour"), 20).select("asset_id", "date", "vol"))


@query(f"""WITH RECURSIVE r AS (SELECT asset_id, date, ret, row_number() OVER (PARTITION BY asset_id ORDER BY date) AS n FROM ({E}) AS p),
  s AS (SELECT asset_id, date, n, ret * ret AS v FROM r WHERE n = 1
        UNION ALL SELECT r.asset_id, r.date, r.n, CASE WHEN s.v IS NULL THEN r.ret * r.ret WHEN r.ret IS NULL THEN s.v ELSE 0.94 * s.v + 0.06 * r.ret * r.ret END FROM s JOIN r ON r.asset_id = s.asset_id AND r.n = s.n + 1)
  SELECT asset_id, date, sqrt(v) AS ewma_vol FROM s""", "ewma_vol")
def ewma_vol(spark, d):
    return rounded(evaluate.ewma_vol(panel(spark, d, "event_hour").select("asset_id", "date", "ret")).select("asset_id", "date", "ewma_vol"))


#: Every user on every day: null where the user had no event, or no return.
GRID = f"SELECT asset_id, date, ret FROM (SELECT DISTINCT asset_id FROM ({U}) AS p) AS a CROSS JOIN (SELECT DISTINCT date FROM ({U}) AS p) AS d LEFT JOIN ({U}) AS u USING (asset_id, date)"


@query(f"""WITH RECURSIVE r AS (SELECT asset_id, date, ret, row_number() OVER (PARTITION BY asset_id ORDER BY date) AS n FROM ({GRID}) AS p),
  s AS (SELECT asset_id, date, n, ret * ret AS v, CAST(0 AS BIGINT) AS gap FROM r WHERE n = 1
        UNION ALL SELECT r.asset_id, r.date, r.n, CASE WHEN s.v IS NULL THEN r.ret * r.ret WHEN r.ret IS NULL THEN s.v ELSE (0.9 ** (s.gap + 1) * s.v + 0.1 * r.ret * r.ret) / (0.9 ** (s.gap + 1) + 0.1) END,
          CASE WHEN r.ret IS NULL THEN s.gap + 1 ELSE 0 END FROM s JOIN r ON r.asset_id = s.asset_id AND r.n = s.n + 1)
  SELECT asset_id, date, sqrt(v) AS ewma_vol FROM s""", "ewma_vol")
def ewma_vol_gaps(spark, d):
    """Events of no user give one row, on the first day, since the SQL's recursion never goes on from there."""
    p = panel(spark, d, "user_day").select("asset_id", "date", "ret")
    whole = calendar.reindex(p.where("asset_id IS NOT NULL"), p.select(F.col("date").alias("session")).distinct())
    nobody = p.agg(F.min("date").alias("date"), F.count_if(F.col("asset_id").isNull()).alias("n")).where("n > 0")
    nobody = nobody.select(F.lit(None).cast(p.schema["asset_id"].dataType).alias("asset_id"), "date", F.lit(None).cast("double").alias("ewma_vol"))
    return rounded(evaluate.ewma_vol(whole, 0.9, nan_is_gap=False).select("asset_id", "date", "ewma_vol").unionByName(nobody), nan_is_null=False)


@query(f"SELECT asset_id, forecast_start_date, mu - sigma AS lower_1s, mu + sigma AS upper_1s, mu - 2 * sigma AS lower_2s, mu + 2 * sigma AS upper_2s FROM ({PN}) AS p", "lower_1s", "upper_1s", "lower_2s", "upper_2s")
def forecast_bands(spark, d):
    return rounded(evaluate.bands(predictions(spark, d, "nation_day")).select("asset_id", "forecast_start_date", "lower_1s", "upper_1s", "lower_2s", "upper_2s"))


@query(f"WITH s AS (SELECT asset_id, forecast_start_date, CASE WHEN sigma <> 0 THEN greatest(-3, least(3, mu / sigma)) END AS signal FROM ({PN}) AS p), q AS (SELECT asset_id, quantile_cont(abs(signal), 0.75) AS q75 FROM s GROUP BY 1) SELECT asset_id, forecast_start_date, signal, coalesce(tanh(signal / greatest(q75, 0.05)), 0) AS color FROM s JOIN q USING (asset_id)", "signal", "color")
def risk_signal(spark, d):
    return rounded(evaluate.risk_signal(predictions(spark, d, "nation_day").select("asset_id", "forecast_start_date", "mu", "sigma")).drop("mu", "sigma"))


def _joined(spark, d):
    return evaluate.join_realized(predictions(spark, d, "nation_day").select("asset_id", "forecast_start_date", "mu", "sigma"), evaluate.realized(panel(spark, d, "nation_day")))


SIGNAL = f"""SELECT asset_id, forecast_start_date, target, CASE WHEN s > 0 THEN (raw - m) / s ELSE 0 END AS signal_z FROM (
  SELECT p.asset_id, forecast_start_date, t.ret AS target, mu / sigma AS raw, avg(mu / sigma) OVER w AS m, stddev_pop(mu / sigma) OVER w AS s
  FROM ({PN}) AS p JOIN ({N}) AS t ON t.asset_id = p.asset_id AND t.date = forecast_start_date WHERE sigma > 0 AND mu IS NOT NULL AND t.ret IS NOT NULL WINDOW w AS (PARTITION BY forecast_start_date)) AS r"""
BUCKET = 4
_POINTS = ", ".join(f"CAST({1.0 if k == BUCKET else ((k * (1.0 / BUCKET)) * 100.0) / 100.0!r} AS DOUBLE)" for k in range(BUCKET + 1))
BUCKETS = f"""WITH z AS ({SIGNAL}), v AS (SELECT forecast_start_date, list_sort(list(signal_z)) AS s, count(DISTINCT signal_z) AS n FROM z GROUP BY 1),
  e AS (SELECT forecast_start_date, CASE WHEN n >= {BUCKET} THEN list_distinct(list_transform([{_POINTS}], lambda p: CASE WHEN p * (len(s) - 1) - floor(p * (len(s) - 1)) < 0.5
    THEN s[floor(p * (len(s) - 1))::INT + 1] + (coalesce(s[floor(p * (len(s) - 1))::INT + 2], s[-1]) - s[floor(p * (len(s) - 1))::INT + 1]) * (p * (len(s) - 1) - floor(p * (len(s) - 1)))
    ELSE coalesce(s[floor(p * (len(s) - 1))::INT + 2], s[-1]) - (coalesce(s[floor(p * (len(s) - 1))::INT + 2], s[-1]) - s[floor(p * (len(s) - 1))::INT + 1]) * (1 - (p * (len(s) - 1) - floor(p * (len(s) - 1)))) END)) END AS edges FROM v)
  SELECT asset_id, forecast_start_date, target, signal_z, CASE WHEN edges IS NOT NULL THEN greatest(1, len(list_filter(edges, lambda e: e < signal_z))) END::INT AS bucket FROM z JOIN e USING (forecast_start_date)"""


def _bucketed(spark, d):
    return signal.buckets(signal.signal_z(_joined(spark, d), risk_adjusted=True), BUCKET)


@query(BUCKETS, "target", "signal_z")
def signal_buckets(spark, d):
    return rounded(_bucketed(spark, d).select("asset_id", "forecast_start_date", "target", "signal_z", "bucket"))


@query(f"SELECT bucket, avg(target) AS mean_per_period, count(target) AS n, avg(target) * 252 AS annualized_return FROM ({BUCKETS}) AS b WHERE bucket IS NOT NULL GROUP BY 1", "mean_per_period", "annualized_return")
def bucket_stats(spark, d):
    return rounded(signal.bucket_stats(_bucketed(spark, d)))


SPREAD = f"SELECT * FROM (SELECT forecast_start_date, avg(CASE WHEN bucket = {BUCKET} THEN target END) - avg(CASE WHEN bucket = 1 THEN target END) AS spread FROM ({BUCKETS}) AS b GROUP BY 1) AS s WHERE spread IS NOT NULL"


@query(SPREAD, "spread")
def spread_series(spark, d):
    return rounded(signal.spread(_bucketed(spark, d), BUCKET))


@query(f"SELECT avg(spread) * 252 AS annualized_return, CASE WHEN stddev_samp(spread) > 0 THEN avg(spread) / stddev_samp(spread) * sqrt(252) ELSE 0 END AS sharpe, count(*) AS n_dates FROM ({SPREAD}) AS s", "annualized_return", "sharpe")
def spread_summary(spark, d):
    return rounded(signal.spread_summary(signal.spread(_bucketed(spark, d), BUCKET)))


def _growth_sql(source: str, date: str, value: str) -> str:
    return f"""SELECT date, cumulative, cumulative / max(cumulative) OVER (ORDER BY date) - 1 AS drawdown FROM (SELECT {date} AS date, product(1 + {value}) OVER (ORDER BY {date}) AS cumulative FROM ({source}) AS s) AS c
      UNION ALL SELECT min({date}) - 1, 1.0, NULL FROM ({source}) AS s"""


#: Spreads are scaled down, so that products stay in range.
@query(_growth_sql(f"SELECT forecast_start_date, spread / 100 AS spread FROM ({SPREAD}) AS x", "forecast_start_date", "spread"), "cumulative", "drawdown")
def spread_growth(spark, d):
    s = signal.spread(_bucketed(spark, d), BUCKET).withColumn("spread", F.col("spread") / 100)
    return rounded(signal.growth(s, "spread", "forecast_start_date"))


@query(f"SELECT forecast_start_date, spread, ret AS benchmark FROM ({SPREAD}) AS s JOIN (SELECT date, ret FROM ({N}) AS p WHERE asset_id = 3 AND ret IS NOT NULL) AS b ON date = forecast_start_date", "spread", "benchmark")
def spread_overlay(spark, d):
    benchmark = evaluate.realized(panel(spark, d, "nation_day").where("asset_id = 3"))
    return rounded(signal.overlay(signal.spread(_bucketed(spark, d), BUCKET), benchmark))


def _ensemble_sql(middle: str) -> str:
    return f"SELECT asset_id, forecast_start_date, {middle}(mu) AS mu, sqrt(avg(sigma * sigma) + var_pop(mu)) AS sigma, count(*) AS n_members FROM ({STACK}) AS s GROUP BY 1, 2"


def _members(spark, d):
    return _measured(spark, d).select("asset_id", "forecast_start_date", "mu", "sigma")


@query(_ensemble_sql("avg"), "mu", "sigma")
def gaussian_ensemble_mean(spark, d):
    return rounded(ensemble.aggregate_gaussians(_members(spark, d), "mean", by=["asset_id", "forecast_start_date"]))


@query(_ensemble_sql("median"), "mu", "sigma")
def gaussian_ensemble_median(spark, d):
    return rounded(ensemble.aggregate_gaussians(_members(spark, d), "median", by=["asset_id", "forecast_start_date"]))


LOSSES = f"SELECT asset_id AS estimator, sqrt(avg(ret * ret)) AS oob_loss FROM ({N}) AS p GROUP BY 1"


def _losses(spark, d):
    return panel(spark, d, "nation_day").groupBy(F.col("asset_id").alias("estimator")).agg(F.sqrt(F.avg(F.col("ret") * F.col("ret"))).alias("oob_loss"))


@query(f"SELECT estimator, oob_loss FROM ({LOSSES}) AS l ORDER BY oob_loss NULLS LAST, estimator LIMIT 10", "oob_loss")
def prune_top_n(spark, d):
    return rounded(ensemble.prune(_losses(spark, d), 10))


@query(f'SELECT estimator, oob_loss, CAST(rank AS INTEGER) AS rank, rank <= 6 AS retained FROM (SELECT *, row_number() OVER (ORDER BY oob_loss NULLS LAST, estimator) AS rank FROM ({LOSSES}) AS l) AS r WHERE rank <= 10', "oob_loss")
def leaderboard(spark, d):
    return rounded(ensemble.leaderboard(_losses(spark, d), 10, 6))


@query(f"SELECT avg(oob_loss) AS mean_loss, stddev_pop(oob_loss) AS std_loss, count(*) AS n FROM ({LOSSES}) AS l", "mean_loss", "std_loss")
def loss_summary(spark, d):
    return rounded(ensemble.loss_summary(_losses(spark, d)))


@query(f"SELECT estimator AS trial_number, oob_loss AS value FROM ({LOSSES}) AS l ORDER BY 2 DESC, 1 LIMIT 1", "value")
def best_trial(spark, d):
    return rounded(ensemble.best_trial(_losses(spark, d).select(F.col("estimator").alias("trial_number"), F.col("oob_loss").alias("value")), "maximize"))


def _bagged_sql(fit: str, mu: str) -> str:
    """Twelve estimators fitted on draws of 0.8 of the hours, the best eight by NLL on the others, as one Gaussian."""
    return f"""WITH p AS (SELECT asset_id, date, ret, last_value(ret IGNORE NULLS) OVER (PARTITION BY asset_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM ({E}) AS e),
  b AS ({bags_sql(E, 12, 0.8, 5)}), i AS (SELECT estimator, asset_id, date, ret FROM p JOIN b USING (date) WHERE bag = 'in'), f AS ({fit}),
  m AS (SELECT estimator, asset_id, date, ret, {mu} AS mu, sd FROM p JOIN f USING (asset_id) WHERE {mu} IS NOT NULL AND sd > 0),
  l AS (SELECT estimator, avg((ret - mu) ** 2 / (sd * sd) + ln(sd * sd)) AS loss FROM m JOIN b USING (estimator, date) WHERE bag = 'oob' AND ret IS NOT NULL GROUP BY 1),
  k AS (SELECT estimator FROM (SELECT DISTINCT estimator FROM b) AS e LEFT JOIN l USING (estimator) ORDER BY loss NULLS LAST, estimator LIMIT 8)
  SELECT asset_id, date AS forecast_start_date, date AS forecast_end_date, avg(mu) AS mu, sqrt(avg(sd * sd) + var_pop(mu)) AS sigma, count(*) AS n_members FROM m WHERE estimator IN (SELECT estimator FROM k) GROUP BY 1, 2"""


BAGGED_AR1 = """SELECT estimator, asset_id, regr_slope(y, x) AS phi, regr_intercept(y, x) AS const,
  sqrt(greatest(0, var_pop(CASE WHEN x IS NOT NULL THEN y END) - regr_slope(y, x) * covar_pop(y, x))) AS sd
  FROM (SELECT estimator, asset_id, ret AS y, lag(ret) OVER (PARTITION BY estimator, asset_id ORDER BY date) AS x FROM i WHERE ret IS NOT NULL) AS l GROUP BY 1, 2"""


def _bag(spark, d, model: str):
    p = panel(spark, d, "event_hour").select("asset_id", "date", "ret")
    bags = splits.bootstrap_dates(splits.date_index(p), 12, 0.8, seed=5)
    return ensemble.bag(p, bags, forecaster(model, gaussian=True, carry=False), 8)[2]


@query(_bagged_sql(BAGGED_AR1, "const + phi * prev"), "mu", "sigma")
def bagged_ar1(spark, d):
    return rounded(_bag(spark, d, "ar1"))


@query(_bagged_sql("SELECT estimator, asset_id, avg(ret) AS mean, stddev_pop(ret) AS sd FROM i GROUP BY 1, 2", "mean"), "mu", "sigma")
def bagged_mean(spark, d):
    return rounded(_bag(spark, d, "unconditional_mean"))


@query()
def bagged_garch(spark, d):
    """Fits by likelihood have no SQL; tests hold each member against a direct fit."""
    return rounded(_bag(spark, d, "garch"))


SPACE = {"window": [5, 20, 60], "shrink": [0.0, 0.5]}


def _errors(train: pd.DataFrame, val: pd.DataFrame, params: dict) -> tuple[float, int]:
    """Squared errors of the mean of each asset's last values, shrunk to 0."""
    mean = train.sort_values("date").dropna(subset=["ret"]).groupby("asset_id")["ret"].apply(lambda s: s.tail(params["window"]).mean())
    error = val["ret"] - val["asset_id"].map(mean) * (1 - params["shrink"])
    return float((error**2).sum()), int(error.count())


def _cv(spark, d):
    p = panel(spark, d, "segment_day").select("asset_id", "date", "ret")
    trials = tuning.grid(spark, SPACE)
    folds = splits.expanding(splits.date_index(p), 3)
    return tuning.trial_values(tuning.cross_validate_assets(p, folds, trials, _errors, F.sqrt), trials)


@query(f"""WITH q AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM ({S}) AS p) AS q),
  f AS (SELECT *, CASE WHEN i < (n // 4) * (fold + 1) THEN 'train' WHEN i < (n // 4) * (fold + 2) THEN 'val' END AS split FROM q CROSS JOIN (SELECT unnest([0, 1, 2]) AS fold) AS k),
  t AS (SELECT row_number() OVER (ORDER BY window_no, shrink_no) - 1 AS trial_number, w, s FROM (VALUES (0, 5), (1, 20), (2, 60)) AS a(window_no, w) CROSS JOIN (VALUES (0, 0.0), (1, 0.5)) AS b(shrink_no, s)),
  r AS (SELECT asset_id, fold, ret, row_number() OVER (PARTITION BY asset_id, fold ORDER BY date DESC) AS back FROM ({S}) AS p JOIN f USING (date) WHERE split = 'train' AND ret IS NOT NULL),
  m AS (SELECT trial_number, fold, asset_id, w, s, avg(ret) AS mean FROM r JOIN t ON back <= w GROUP BY ALL),
  l AS (SELECT trial_number, fold, w, s, sqrt(avg((ret - mean * (1 - s)) ** 2)) AS loss FROM m JOIN ({S}) AS p USING (asset_id) JOIN f USING (date, fold) WHERE split = 'val' GROUP BY ALL)
  SELECT trial_number, 'COMPLETE' AS state, avg(loss) AS value, CAST(w AS BIGINT) AS "window", CAST(s AS DOUBLE) AS shrink FROM l GROUP BY ALL""", "value", "shrink")
def cv_grid(spark, d):
    return rounded(_cv(spark, d))


def _last_three(x):
    """A linear model: mean of the last three returns, and their root mean square."""
    tail = x[:, -3:, 0]
    return tail.mean(axis=1), np.sqrt((tail**2).mean(axis=1))


@query(f"SELECT forecast_start_date, forecast_end_date, asset_id, (v[-1] + v[-2] + v[-3]) / 3 AS mu, sqrt((v[-1] ** 2 + v[-2] ** 2 + v[-3] ** 2) / 3) AS sigma FROM (SELECT *, list_transform(x, lambda e: coalesce(e, 0)) AS v FROM ({_windows_sql(E, 6, 1, 1)}) AS w) AS z", "mu", "sigma")
def score_windows_linear(spark, d):
    w = windows.make_windows(panel(spark, d, "event_hour"), Roles(("ret",), ("ret",)), 6)
    return rounded(tuning.score_windows(w, ["ret"], _last_three))


ALPHA = f"SELECT asset_id, forecast_start_date, CASE WHEN s > 0 THEN (raw - m) / s ELSE 0 END AS alpha FROM (SELECT asset_id, forecast_start_date, mu / sigma AS raw, avg(mu / sigma) OVER w AS m, stddev_pop(mu / sigma) OVER w AS s FROM ({PN}) AS p WHERE mu IS NOT NULL AND sigma > 0 WINDOW w AS (PARTITION BY forecast_start_date)) AS r"


@query(ALPHA, "alpha")
def alpha_zscore(spark, d):
    return rounded(signal.alpha(predictions(spark, d, "nation_day")).select("asset_id", "forecast_start_date", "alpha"))


@query(f"SELECT asset_id, forecast_start_date, mu, sigma FROM ({PN}) AS p WHERE forecast_start_date IN (SELECT forecast_start_date FROM ({PN}) AS q GROUP BY 1 HAVING count(mu) = count(*) AND count(sigma) = count(*)) AND forecast_start_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'", "mu", "sigma")
def valid_forecasts(spark, d):
    import datetime as dt

    p = predictions(spark, d, "nation_day").select("asset_id", "forecast_start_date", "mu", "sigma")
    return rounded(portfolio.date_bounds(portfolio.valid_forecasts(p, drop_date=True), dt.date(1996, 1, 1), dt.date(1999, 12, 31)))


@query(f"SELECT asset_id, forecast_start_date, arg_min(mu, k) FILTER (WHERE mu IS NOT NULL) AS mu, arg_min(sigma, k) FILTER (WHERE sigma IS NOT NULL) AS sigma FROM (SELECT asset_id, forecast_start_date, mu, CASE WHEN asset_id % 2 = 0 THEN sigma END AS sigma, 0 AS k FROM ({PN}) AS a UNION ALL SELECT asset_id, forecast_start_date, mu + 1, sigma + 1, 1 FROM ({PN}) AS b) AS u GROUP BY 1, 2", "mu", "sigma")
def dedupe_predictions(spark, d):
    p = predictions(spark, d, "nation_day").select("asset_id", "forecast_start_date", "mu", "sigma")
    first = p.withColumn("sigma", F.when(F.col("asset_id") % 2 == 0, F.col("sigma"))).withColumn("k", F.lit(0))
    again = p.withColumns({"mu": F.col("mu") + 1, "sigma": F.col("sigma") + 1, "k": F.lit(1)})
    return rounded(portfolio.dedupe_predictions(first.unionByName(again), "k"))


W = 24
COV = f"""WITH p AS ({E}), i AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS k FROM (SELECT DISTINCT date FROM p) AS q), r AS (SELECT p.*, k FROM p JOIN i USING (date)),
  c AS (SELECT a.date, a.k, a.asset_id AS asset_i, b.asset_id AS asset_j, covar_samp(CASE WHEN b.ret IS NOT NULL THEN a.ret END, CASE WHEN a.ret IS NOT NULL THEN b.ret END) OVER w AS cov, count(a.ret + b.ret) OVER w AS n
    FROM r AS a JOIN r AS b ON a.k = b.k AND a.asset_id <= b.asset_id WINDOW w AS (PARTITION BY a.asset_id, b.asset_id ORDER BY a.k RANGE BETWEEN {W - 1} PRECEDING AND CURRENT ROW)),
  f AS (SELECT * FROM c WHERE k >= {W - 1} AND n >= 2), m AS (SELECT k, avg(cov) AS v FROM f WHERE asset_i = asset_j GROUP BY 1)
  SELECT date, asset_i, asset_j, cov + CASE WHEN asset_i = asset_j THEN 0.1 * v ELSE 0 END AS cov, n FROM f JOIN m USING (k)"""


@query(COV, "cov")
def rolling_cov(spark, d):
    return rounded(portfolio.rolling_cov(panel(spark, d, "event_hour"), W, 0.1))


HOW = portfolio.Backtest(window=48, ridge=0.1, ridge_relative=True, risk_aversion=5.0)
#: The backtest in SQL: pairwise covariances of the 48 hours before each forecast, and a Gauss-Jordan elimination, pivot by
#: pivot, of each hour's matrix with alpha and a column of ones beside it.
SOLVED = f"""WITH RECURSIVE p AS ({E}), i AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS k FROM (SELECT DISTINCT date FROM p) AS q),
  r AS (SELECT asset_id AS a, k, ret FROM p JOIN i USING (date)),
  f AS (SELECT f.asset_id AS a, k, mu, sigma, count(*) OVER (PARTITION BY k) AS n_known FROM ({predictions_sql("event_hour")}) AS f JOIN i ON i.date = f.forecast_start_date WHERE mu IS NOT NULL AND sigma IS NOT NULL),
  c AS (SELECT x.k, x.a AS a, y.a AS b, covar_samp(CASE WHEN y.ret IS NOT NULL THEN x.ret END, CASE WHEN x.ret IS NOT NULL THEN y.ret END) OVER w AS cov, count(x.ret + y.ret) OVER w AS n
    FROM r AS x JOIN r AS y USING (k) WINDOW w AS (PARTITION BY x.a, y.a ORDER BY k RANGE BETWEEN 48 PRECEDING AND 1 PRECEDING)),
  v AS (SELECT c.k, c.a, c.b, cov FROM c JOIN f ON f.k = c.k AND f.a = c.a JOIN f AS g ON g.k = c.k AND g.a = c.b WHERE c.n >= 2 AND c.k >= 48 AND f.n_known >= 2),
  s AS (SELECT k, a, alpha FROM (SELECT k, a, CASE WHEN stddev_pop(mu / sigma) OVER w > 0 THEN (mu / sigma - avg(mu / sigma) OVER w) / stddev_pop(mu / sigma) OVER w ELSE 0 END AS alpha FROM f WHERE sigma > 0 WINDOW w AS (PARTITION BY k)) AS z),
  d AS (SELECT k, avg(cov) AS mean_var FROM v WHERE a = b GROUP BY 1),
  m AS (SELECT k, a, alpha, list(cov + CASE WHEN a = b THEN 0.1 * mean_var ELSE 0 END ORDER BY b) AS row FROM v JOIN d USING (k) JOIN s USING (k, a) GROUP BY ALL),
  g AS (SELECT k, 1 AS step, count(*) AS n, list(a ORDER BY a) AS assets, list(alpha ORDER BY a) AS alphas, list(list_concat(row, [alpha, 1.0]) ORDER BY a) AS m FROM m GROUP BY 1 HAVING count(*) >= 2
    UNION ALL SELECT k, step + 1, n, assets, alphas, list_transform(range(1, n + 1), lambda i: CASE WHEN i = step THEN list_transform(m[step], lambda x: x / m[step][step])
      ELSE list_transform(range(1, n + 3), lambda j: m[i][j] - m[i][step] * m[step][j] / m[step][step]) END) FROM g WHERE step <= n),
  e AS (SELECT k, unnest(assets) AS asset_id, unnest(alphas) AS alpha, unnest(list_transform(m, lambda x: x[n + 1])) AS by_alpha, unnest(list_transform(m, lambda x: x[n + 2])) AS by_one FROM g WHERE step = n + 1)
  SELECT i.date, asset_id, (by_alpha - (sum(by_alpha) OVER w - 5.0) / (sum(by_one) OVER w) * by_one) / 5.0 AS weight, alpha, ret AS realized_return
  FROM e JOIN i USING (k) JOIN r ON r.k = e.k AND r.a = e.asset_id WINDOW w AS (PARTITION BY e.k)"""
#: What became of each forecast hour.
STATUS = f"""SELECT date, CASE WHEN n_known < 2 THEN 'universe' WHEN k < 48 THEN 'burn_in' ELSE 'ok' END AS status FROM (
  SELECT forecast_start_date AS date, k, count(CASE WHEN mu IS NOT NULL AND sigma IS NOT NULL THEN 1 END) AS n_known FROM ({predictions_sql("event_hour")}) AS f
  JOIN (SELECT date, row_number() OVER (ORDER BY date) - 1 AS k FROM (SELECT DISTINCT date FROM ({E}) AS p) AS q) AS i ON i.date = forecast_start_date GROUP BY 1, 2) AS t"""


def _backtest(spark, d):
    p = panel(spark, d, "event_hour")
    return portfolio.backtest(predictions(spark, d, "event_hour").select("asset_id", "forecast_start_date", "mu", "sigma"), p, HOW)


@query(SOLVED, "weight", "alpha", "realized_return")
def backtest_weights(spark, d):
    return rounded(_backtest(spark, d)[0])


@query(f"SELECT date, sum(weight * realized_return) AS portfolio_return, count(*) AS n_assets_held, sum(abs(weight)) AS leverage, sum(weight * weight) AS hhi, 1 / sum(weight * weight) AS effective_n FROM ({SOLVED}) AS w WHERE realized_return IS NOT NULL GROUP BY 1", "portfolio_return", "leverage", "hhi", "effective_n")
def backtest_returns(spark, d):
    return rounded(_backtest(spark, d)[1])


@query(f"SELECT status, count(*) AS n_dates FROM ({STATUS}) AS t GROUP BY 1")
def backtest_status(spark, d):
    return _backtest(spark, d)[2]


@query(f"""SELECT count(*) AS n_rebalance_dates, (SELECT count(DISTINCT asset_id) FROM ({SOLVED}) AS w) AS n_unique_assets, min(date) AS start_date, max(date) AS end_date,
  (SELECT count(*) FROM ({STATUS}) AS t WHERE status = 'burn_in') AS skipped_burn_in_dates, CAST(0 AS BIGINT) AS skipped_missing_asset_dates, (SELECT count(*) FROM ({STATUS}) AS t WHERE status = 'universe') AS skipped_insufficient_universe_dates,
  CAST(48 AS BIGINT) AS burn_in_days, 'drop_asset' AS missing_asset_policy FROM ({STATUS}) AS t WHERE status = 'ok'""")
def backtest_summary(spark, d):
    return portfolio.summary(*_backtest(spark, d), HOW)


#: Equal weights over the nations that traded, small returns so that products stay in range.
EQUAL = f"SELECT date, asset_id, 1.0 / count(*) OVER (PARTITION BY date) AS weight, ret / 100 AS realized_return FROM ({N}) AS p WHERE ret IS NOT NULL"
RETURNS = f"SELECT date, sum(weight * realized_return) AS portfolio_return, count(*) AS n_assets_held, sum(abs(weight)) AS leverage, sum(weight * weight) AS hhi, 1 / sum(weight * weight) AS effective_n FROM ({EQUAL}) AS w GROUP BY 1"
TURNOVER = f"WITH w AS (SELECT *, dense_rank() OVER (ORDER BY date) - 1 AS k FROM ({EQUAL}) AS e) SELECT k, sum(abs(coalesce(a.weight, 0) - coalesce(b.weight, 0))) AS turnover FROM (SELECT k, asset_id, weight FROM w) AS a FULL JOIN (SELECT k + 1 AS k, asset_id, weight FROM w) AS b USING (k, asset_id) WHERE k BETWEEN 1 AND (SELECT max(k) FROM w) GROUP BY 1"


def _equal(spark, d):
    from pyspark.sql.window import Window

    p = panel(spark, d, "nation_day").where("ret IS NOT NULL")
    return p.select("date", "asset_id", (F.lit(1.0) / F.count("*").over(Window.partitionBy("date"))).alias("weight"), (F.col("ret") / 100).alias("realized_return"))


@query(RETURNS, "portfolio_return", "leverage", "hhi", "effective_n")
def portfolio_returns(spark, d):
    return rounded(portfolio.portfolio_returns(_equal(spark, d)))


@query(TURNOVER, "turnover")
def turnover(spark, d):
    return rounded(portfolio.turnover(_equal(spark, d)))


@query(f"""WITH r AS ({RETURNS}), c AS (SELECT date, product(1 + portfolio_return) OVER (ORDER BY date) AS cum FROM r), t AS (SELECT avg(turnover) AS mean_turnover FROM ({TURNOVER}) AS x)
  SELECT product(1 + portfolio_return) ** (252.0 / count(*)) - 1 AS annual_return, stddev_pop(portfolio_return) * sqrt(252) AS annual_vol, avg(portfolio_return) / stddev_pop(portfolio_return) * sqrt(252) AS sharpe,
  (SELECT min(dd) FROM (SELECT cum / max(cum) OVER (ORDER BY date) - 1 AS dd FROM c) AS y) AS max_drawdown, avg(CASE WHEN portfolio_return > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate, avg(portfolio_return) AS mean_daily_return,
  stddev_pop(portfolio_return) AS std_daily_return, (SELECT mean_turnover FROM t) AS mean_turnover, avg(leverage) AS mean_leverage, avg(effective_n) AS mean_effective_n, count(*) AS n_days FROM r""",
  "annual_return", "annual_vol", "sharpe", "max_drawdown", "hit_rate", "mean_daily_return", "std_daily_return", "mean_turnover", "mean_leverage", "mean_effective_n")
def portfolio_metrics(spark, d):
    w = _equal(spark, d)
    return rounded(portfolio.portfolio_metrics(portfolio.portfolio_returns(w), w))


@query(f"""WITH s AS (SELECT 'portfolio' AS series, date, portfolio_return AS v FROM ({RETURNS}) AS r UNION ALL SELECT CAST(asset_id AS VARCHAR), date, ret / 100 FROM ({N}) AS p WHERE asset_id IN (SELECT DISTINCT asset_id FROM (SELECT * FROM ({N}) AS y WHERE ret IS NOT NULL) AS z ORDER BY 1 LIMIT 2) AND ret IS NOT NULL),
  k AS (SELECT * FROM s WHERE date IN (SELECT date FROM s GROUP BY 1 HAVING count(*) = 3)),
  c AS (SELECT series, date, product(1 + v) OVER (PARTITION BY series ORDER BY date) AS cumulative FROM k)
  SELECT series, date, cumulative, cumulative / max(cumulative) OVER (PARTITION BY series ORDER BY date) - 1 AS drawdown FROM c UNION ALL SELECT series, min(date) - 1, 1.0, NULL FROM k GROUP BY 1""", "cumulative", "drawdown")
def equity_vs_benchmark(spark, d):
    p = panel(spark, d, "nation_day").withColumn("ret", F.col("ret") / 100)
    first_two = [r[0] for r in p.where("ret IS NOT NULL").select("asset_id").distinct().orderBy("asset_id").limit(2).collect()]
    both = portfolio.versus_benchmarks(portfolio.portfolio_returns(_equal(spark, d)), p, first_two)
    return rounded(signal.growth(both, "value", "date", by=["series"]))


def _last_one(x):
    """Another model: the last return, and the deviation of all."""
    return x[:, -1, 0], np.sqrt(x[:, :, 0].var(axis=1)) + 0.01


@query(f"""WITH w AS (SELECT *, list_transform(x, lambda e: coalesce(e, 0)) AS v FROM ({_windows_sql(E, 6, 1, 1)}) AS w),
  m AS (SELECT forecast_start_date, forecast_end_date, asset_id, (v[-1] + v[-2] + v[-3]) / 3 AS a, sqrt((v[-1] ** 2 + v[-2] ** 2 + v[-3] ** 2) / 3) AS sa, v[-1] AS b, sqrt(list_aggregate(v, 'var_pop')) + 0.01 AS sb FROM w)
  SELECT asset_id, forecast_start_date, forecast_end_date, (a + b) / 2 AS mu, sqrt((sa * sa + sb * sb) / 2 + (a - b) * (a - b) / 4) AS sigma, CAST(2 AS BIGINT) AS n_members FROM m""", "mu", "sigma")
def score_windows_ensemble(spark, d):
    w = windows.make_windows(panel(spark, d, "event_hour"), Roles(("ret",), ("ret",)), 6)
    return rounded(tuning.score_ensemble(w, ["ret"], {0: _last_three, 1: _last_one}))


@query(f"SELECT asset_id, date, ret FROM ({N}) AS p WHERE asset_id IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) AND date IN (SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_orderstatus = 'P')", "ret")
def slice_dates_assets(spark, d):
    dates = spark.read.parquet(f"{d}/orders.parquet").where("o_orderstatus = 'P'").select(F.to_date("o_orderdate").alias("date"))
    assets = spark.read.parquet(f"{d}/nation.parquet").where("n_regionkey = 1").select(F.col("n_nationkey").alias("asset_id"))
    return rounded(splits.slice_dates_assets(panel(spark, d, "nation_day").select("asset_id", "date", "ret"), dates, assets))
