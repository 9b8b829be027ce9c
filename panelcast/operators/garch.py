"""GARCH(1,1) with a constant mean: maximum likelihood per asset, and the one-step roll-forward.

For the fit, ids are dealt into buckets, and a bucket's likelihoods run over time with one numpy lane for each id. With
given parameters, variances are an affine recursion, which a scan in chunks of dates computes. Values are scaled by 100 for the fit. Ids with fewer than 60 values, or whose fit fails, have
no parameters, and no predictions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import written
from .forecast import Columns, as_predictions
from .recurrence import ROWS, affine, scan, with_chunks

LEAST = 60
PERCENT = 100.0


def variances(y: np.ndarray, live: np.ndarray, mu, omega, alpha, beta, start) -> np.ndarray:
    """Conditional variances (time x lane) of padded series; start is the variance before the first value."""
    out = np.empty_like(y)
    added = omega + alpha * (y - mu) ** 2
    out[0] = now = start
    for t in range(1, len(y)):
        now = added[t - 1] + beta * now
        out[t] = now
    return np.where(live, out, 1.0)


def log_likelihood(y, live, mu, omega, alpha, beta, start) -> np.ndarray:
    v = np.maximum(variances(y, live, mu, omega, alpha, beta, start), 1e-12)
    terms = -0.5 * (np.log(2 * np.pi) + np.log(v) + (y - mu) ** 2 / v)
    return np.where(live, terms, 0.0).sum(axis=0)


def _unpack(p: np.ndarray, scale: np.ndarray, centre: np.ndarray):
    """Free numbers to mu, omega, alpha, beta with alpha + beta < 1."""
    total = 0.9999 / (1 + np.exp(-np.clip(p[2], -30, 30)))
    share = 1 / (1 + np.exp(-np.clip(p[3], -30, 30)))
    return centre + p[0] * np.sqrt(scale), scale * np.exp(p[1]), total * share, total * (1 - share)


def fit_lanes(series: list[np.ndarray]) -> list[tuple[float, float, float, float, float] | None]:
    """(mu, omega, alpha, beta, last variance) of each series (scaled values), or None: Nelder-Mead in every lane at
    once, from several starts, and the best result."""
    if not series:
        return []
    n, size = len(series), max(map(len, series))
    y, live = np.zeros((size, n)), np.zeros((size, n), bool)
    for k, s in enumerate(series):
        y[: len(s), k], live[: len(s), k] = s, True
    centre = np.array([s.mean() for s in series])
    scale = np.array([max(s.var(), 1e-12) for s in series])

    def loss(p: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            out = -log_likelihood(y, live, *_unpack(p, scale, centre), scale)
        return np.where(np.isfinite(out), out, 1e300)

    best, value = np.zeros((4, n)), np.full(n, 1e300)
    for omega, total, share in ((0.05, 3.0, -2.0), (0.3, 1.0, -1.0), (0.7, -0.5, 0.0)):
        p = _nelder_mead(loss, np.stack([np.zeros(n), np.full(n, np.log(omega)), np.full(n, total), np.full(n, share)]))
        now = loss(p)
        best, value = np.where(now < value, p, best), np.minimum(now, value)
    # A simplex can collapse early: search again from the best point until that gains nothing.
    for _ in range(5):
        p = _nelder_mead(loss, best, rounds=150, step=0.3)
        now = loss(p)
        gain = value - now
        best, value = np.where(gain > 0, p, best), np.minimum(now, value)
        if gain.max() < 1e-6:
            break
    mu, omega, alpha, beta = _unpack(best, scale, centre)
    v = variances(y, live, mu, omega, alpha, beta, scale)
    out = []
    for k, s in enumerate(series):
        found = (float(mu[k]), float(omega[k]), float(alpha[k]), float(beta[k]), float(v[len(s) - 1, k]))
        out.append(found if value[k] < 1e299 and all(map(np.isfinite, found)) else None)
    return out


def _nelder_mead(loss, start: np.ndarray, rounds: int = 220, step: float = 0.6) -> np.ndarray:
    """Simplex search with a simplex for each lane. start: (parameters, lanes)."""
    d, n = start.shape
    points = np.repeat(start[None], d + 1, axis=0)
    for k in range(d):
        points[k + 1, k] += step
    values = np.stack([loss(p) for p in points])
    lanes = np.arange(n)
    for _ in range(rounds):
        order = values.argsort(axis=0, kind="stable")
        points, values = np.take_along_axis(points, order[:, None, :], 0), np.take_along_axis(values, order, 0)
        middle = points[:-1].mean(axis=0)
        reflected = 2 * middle - points[-1]
        fr = loss(reflected)
        better, worse = fr < values[0], fr >= values[-2]
        second = np.where(better, 3 * middle - 2 * points[-1], np.where(fr < values[-1], 1.5 * middle - 0.5 * points[-1], 0.5 * middle + 0.5 * points[-1]))
        fs = loss(second)
        take = np.where(better, fs < fr, worse & (fs < np.minimum(fr, values[-1])))
        new, f_new = np.where(take, second, reflected), np.where(take, fs, fr)
        shrink = worse & ~take
        points[-1, :, ~shrink] = new[:, ~shrink].T
        values[-1, ~shrink] = f_new[~shrink]
        if shrink.any():
            points[1:, :, shrink] = (points[:1, :, shrink] + points[1:, :, shrink]) / 2
            for k in range(1, d + 1):
                values[k, shrink] = loss(points[k])[shrink]
        if (values.max(axis=0) - values.min(axis=0)).max() < 1e-9:
            break
    return points[values.argmin(axis=0), :, lanes].T


@dataclass(frozen=True)
class Garch11:
    columns: Columns = Columns()
    bucket_ids: int = 64  # ids in one group, about
    carry: bool = True  # forecasts start from the last training variance, else from the training values' variance

    def fit(self, train: DataFrame, by=()) -> DataFrame:
        """(by…, id, mu, omega, alpha, beta, variance, start): variance is that of the last value, start of the first.
        Written once, since the search is the dear part and what uses the table may read it more than once."""
        c = self.columns
        keys = [*by, c.id]
        rows = train.select(*keys, c.date, F.col(c.target).cast("double").alias("y")).where("y IS NOT NULL AND NOT isnan(y)")
        counts = rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= LEAST)
        buckets = max(1, -(-counts.count() // self.bucket_ids))
        dealt = rows.join(counts.drop("n"), keys, "left_semi").withColumn("__bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
        schema = T.StructType([*(train.schema[k] for k in keys), *(T.StructField(n, T.DoubleType()) for n in ("mu", "omega", "alpha", "beta", "variance", "start"))])

        def work(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values([*keys, c.date])
            series = {i: g["y"].to_numpy(float) * PERCENT for i, g in group.groupby(keys, sort=True)}
            fits = zip(series.items(), fit_lanes(list(series.values())))
            return pd.DataFrame([(*i, *f, max(float(s.var()), 1e-12)) for (i, s), f in fits if f is not None], columns=schema.names)

        return written(dealt.groupBy("__bucket").applyInPandas(work, schema), "garch")

    def _steps(self, panel: DataFrame, params: DataFrame, start: str, by=(), rows: int = ROWS) -> DataFrame:
        """Rows with parameters and `variance` just before each: v = omega + alpha (y - mu)^2 + beta v at each known
        value, kept over gaps, from the parameter `start` on. A scan in chunks of dates."""
        c = self.columns
        y = F.col(c.target).cast("double") * PERCENT
        values = with_chunks(panel.select(c.id, c.date, F.when(~F.isnan(y), y).alias("y")), c.date, rows)
        known = values.join(params.withColumnRenamed(start, "start"), c.id)
        e, there = F.col("y") - F.col("mu"), F.col("y").isNotNull()
        steps = known.withColumns({"a": F.when(there, F.col("beta")).otherwise(1.0), "b": F.when(there, F.col("omega") + F.col("alpha") * e * e).otherwise(0.0)})
        return scan(steps, affine("a", "b"), F.struct(F.col("start").alias("s")), "before", [*by, c.id], c.date, rows).withColumn("variance", F.col("before.s"))

    def predict(self, panel: DataFrame, params: DataFrame, by=(), rows: int = ROWS) -> DataFrame:
        """mu is constant; sigma starts from the last in-sample variance and is updated by each known value."""
        c = self.columns
        params = params.drop("start") if self.carry else params.drop("variance").withColumnRenamed("start", "variance")
        sigma = F.when(F.col("variance") > 0, F.sqrt("variance") / PERCENT)
        return as_predictions(self._steps(panel, params, "variance", by, rows), c, F.col("mu") / PERCENT, sigma, by)

    def log_likelihood(self, panel: DataFrame, params: DataFrame, by=(), rows: int = ROWS) -> DataFrame:
        """(by…, id, n, log_likelihood) of the known values under parameters (by…, id, mu, omega, alpha, beta, start);
        start is the variance of the first value."""
        c = self.columns
        known = self._steps(panel.where(F.col(c.target).isNotNull()), params, "start", by, rows).where("y IS NOT NULL")
        v, e = F.greatest("variance", F.lit(1e-12)), F.col("y") - F.col("mu")
        term = -0.5 * (F.log(2 * F.pi()) + F.log(v) + e * e / v)
        return known.groupBy(*by, c.id).agg(F.count("*").alias("n"), F.sum(term).alias("log_likelihood"))


def neighbourhood(params: DataFrame, share: float = 0.02) -> DataFrame:
    """Each row of parameters with candidate 0, and its neighbours as candidates 1 on: one parameter moved by `share` of
    itself (mu: of the start's root), down or up. alpha + beta < 1 is kept."""
    moves = [(0.0, 0.0, 0.0, 0.0)] + [tuple(s * share if k == j else 0.0 for j in range(4)) for k in range(4) for s in (-1, 1)]
    table = F.array(*[F.struct(F.lit(k).alias("candidate"), *[F.lit(x).alias(n) for n, x in zip(("dm", "do", "da", "db"), m)]) for k, m in enumerate(moves)])
    rows = params.select("*", F.inline(table))
    moved = {"mu": F.col("mu") + F.col("dm") * F.sqrt("start"), "omega": F.col("omega") * (1 + F.col("do")), "alpha": F.col("alpha") * (1 + F.col("da")), "beta": F.col("beta") * (1 + F.col("db"))}
    return rows.withColumns(moved).where("candidate = 0 OR alpha + beta < 1").drop("dm", "do", "da", "db")
