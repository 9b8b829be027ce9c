"""Mean-variance backtest without look-ahead, and the portfolio's metrics.

The covariance comes from sums over pairs of assets (how many values in common, their sums and products), taken in
groups of a chunk of dates and a pair of asset blocks. A group holds the values of two blocks on its own dates and the W
dates before them (a halo): no group holds the whole history, nor, in the covariance, all assets. The optimiser needs
one date's whole matrix, and gets it in a group of a few dates, or of one where there are many assets.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import written
from .contracts import ContractError, failing
from .splits import date_index


@dataclass(frozen=True)
class Backtest:
    window: int = 96
    ridge: float = 1e-4
    ridge_relative: bool = False
    risk_aversion: float = 1e5
    fully_invested: bool = True
    shorting: bool = True
    drop_date: bool = False  # else assets without forecast are dropped
    burn_in: int = 0  # 0: the window
    chunk: int = 384
    block_assets: int = 128
    start: object = None
    end: object = None

    def __post_init__(self):
        if self.window < 2 or self.risk_aversion <= 0 or self.ridge < 0 or min(self.chunk, self.block_assets) < 1:
            raise ContractError("window >= 2, risk aversion > 0, ridge >= 0 and chunk >= 1 are needed")


def dedupe_predictions(predictions: DataFrame, order: str) -> DataFrame:
    """Per key, the first mu and the first sigma that aren't null, each for itself, in the given order."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c)
    return predictions.groupBy("asset_id", "forecast_start_date").agg(first("mu"), first("sigma"))


def date_bounds(df: DataFrame, start=None, end=None, date: str = "forecast_start_date") -> DataFrame:
    """Rows between the bounds, inclusive; an open bound is the first or last forecast date."""
    out = df if start is None else df.where(F.col(date) >= F.lit(start))
    return out if end is None else out.where(F.col(date) <= F.lit(end))


def valid_forecasts(predictions: DataFrame, drop_date: bool = False, date: str = "forecast_start_date") -> DataFrame:
    """Rows with mu and sigma; with drop_date, only dates on which every row has both."""
    known = F.col("mu").isNotNull() & F.col("sigma").isNotNull()
    if not drop_date:
        return predictions.where(known)
    whole = predictions.groupBy(date).agg(F.min(known).alias("whole")).where("whole").select(date)
    return predictions.join(whole, date, "left_semi")


def rolling_cov(panel: DataFrame, window: int, ridge: float = 0.0, relative: bool = True, target: str = "ret", id: str = "asset_id", date: str = "date") -> DataFrame:
    """(date, asset_i, asset_j, cov, n): sample covariance over the last `window` dates up to each date, pairwise
    complete; ridge on the diagonal, absolute or times the mean variance. For few assets: a row per pair and date."""
    index = date_index(panel, date)
    rows = panel.join(F.broadcast(index), date).select(F.col(id).alias("a"), "date_idx", F.col(target).alias("x"))
    i, j = rows.select("date_idx", F.col("a").alias("asset_i"), F.col("x").alias("xi")), rows.select("date_idx", F.col("a").alias("asset_j"), F.col("x").alias("xj"))
    pairs = i.join(j, "date_idx").where("asset_i <= asset_j")
    w = Window.partitionBy("asset_i", "asset_j").orderBy("date_idx").rangeBetween(-(window - 1), 0)
    both = F.col("xi").isNotNull() & F.col("xj").isNotNull()
    xi, xj = F.when(both, F.col("xi")), F.when(both, F.col("xj"))
    out = pairs.select("date_idx", "asset_i", "asset_j", F.covar_samp(xi, xj).over(w).alias("cov"), F.count(xi).over(w).alias("n")).where((F.col("date_idx") >= window - 1) & (F.col("n") >= 2))
    if ridge:
        base = F.lit(ridge)
        if relative:
            mean = out.where("asset_i = asset_j").groupBy("date_idx").agg(F.avg("cov").alias("mean_var"))
            out, base = out.join(mean, "date_idx"), ridge * F.col("mean_var")
        out = out.withColumn("cov", F.when(F.col("asset_i") == F.col("asset_j"), F.col("cov") + base).otherwise(F.col("cov")))
    return out.join(F.broadcast(index), "date_idx").select(date, "asset_i", "asset_j", "cov", "n")


def pair_sums(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each pair of columns of x and y (time, asset): the number of rows with both values, and over these rows the
    sums of x, of y, and of x y. They add up over rows."""
    mx, my = np.isfinite(x), np.isfinite(y)
    vx, vy = np.where(mx, x, 0.0), np.where(my, y, 0.0)
    mx, my = mx.astype(float), my.astype(float)
    return mx.T @ my, vx.T @ my, mx.T @ vy, vx.T @ vy


def pair_covariance(n: np.ndarray, sx: np.ndarray, sy: np.ndarray, sxy: np.ndarray) -> np.ndarray:
    """Sample covariance of pairs from their sums; NaN with fewer than two rows in common."""
    with np.errstate(all="ignore"):
        return np.where(n >= 2, (sxy - sx * sy / n) / (n - 1), np.nan)


def usable(cov: np.ndarray) -> np.ndarray:
    """The assets kept of a pairwise covariance with NaN for unknown pairs: those with a variance, less, one after another,
    the one with most unknown pairs, until there are none."""
    keep = np.flatnonzero(np.isfinite(np.diag(cov)))
    while len(keep):
        short = np.isnan(cov[np.ix_(keep, keep)]).sum(axis=0)
        if not short.any():
            break
        keep = np.delete(keep, int(short.argmax()))
    return keep


def covariance(x: np.ndarray, ridge: float, relative: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairwise-complete sample covariance of (time, asset) values with gaps: the assets kept (those with two values or
    more, and two in common with each other one kept), and their matrix with its ridge."""
    live = np.isfinite(x)
    centred = x - np.where(live, x, 0.0).sum(axis=0) / np.maximum(live.sum(axis=0), 1)
    return ridged(pair_covariance(*pair_sums(centred, centred)), ridge, relative)


def ridged(cov: np.ndarray, ridge: float, relative: bool) -> tuple[np.ndarray, np.ndarray]:
    keep = usable(cov)
    kept = cov[np.ix_(keep, keep)]
    return keep, kept + np.eye(len(keep)) * ridge * (np.diag(kept).mean() if relative and len(keep) else 1.0)


def mean_variance(alpha: np.ndarray, cov: np.ndarray, risk_aversion: float, fully_invested: bool = True, shorting: bool = True) -> np.ndarray:
    """Weights that maximise alpha w - risk_aversion / 2 w cov w, summing to 1 if fully invested; without shorting by
    an active set of zero weights."""
    free = np.arange(len(alpha))
    while True:
        inverse = np.linalg.solve(cov[np.ix_(free, free)], np.column_stack([alpha[free], np.ones(len(free))]))
        if fully_invested:
            one = inverse[:, 1].sum()
            if one <= 0:
                raise ContractError("the covariance isn't positive definite")
            nu = (inverse[:, 0].sum() - risk_aversion) / one
            w = (inverse[:, 0] - nu * inverse[:, 1]) / risk_aversion
        else:
            w = inverse[:, 0] / risk_aversion
        out = np.zeros(len(alpha))
        out[free] = w
        if shorting or (w >= 0).all():
            break
        free = np.delete(free, int(w.argmin()))
        if not len(free):
            return np.zeros(len(alpha))
    if not shorting:
        out = np.clip(out, 0, None)
        if fully_invested and out.sum() > 0:
            out = out / out.sum()
    return out


STATUSES = ("ok", "missing", "universe", "burn_in")


#: Cells of covariances that a group of dates may hold, unless one date has more.
GROUP_CELLS = 2_000_000
SOLVED = ["date_idx", "asset", "weight", "alpha", "realized_return", "status"]


def _weights(day: int, rows: pd.DataFrame, how: Backtest, alpha_fn, cov_of, solve_fn) -> list[tuple]:
    """Of one date's forecasts (asset, mu, sigma, realized), rows as in SOLVED; a date that is skipped is one row. cov_of
    takes the rows with a whole forecast and gives those kept, by position, and their covariance."""
    burn = how.burn_in or how.window
    skipped = lambda status: [(day, None, None, None, None, status)]
    mu, sigma = rows["mu"].to_numpy(float), rows["sigma"].to_numpy(float)
    known = np.isfinite(mu) & np.isfinite(sigma)
    if how.drop_date and not known.all():
        return skipped("missing")
    if known.sum() < 2:
        return skipped("universe")
    if day == 0 or day < how.window:  # dates before this one
        return skipped("burn_in")
    rows = rows[known]
    kept, cov = cov_of(rows)
    if len(kept) < 2 or (len(kept) < burn and day < burn):
        return skipped("burn_in")
    scores, today = alpha_fn(mu[known], sigma[known]), rows["realized"].to_numpy(float)
    inside = np.flatnonzero(np.isfinite(scores[kept]))
    use = kept[inside]
    if len(use) < 2 or not np.isfinite(today[use]).any():
        return skipped("universe")
    weights = solve_fn(scores[use], cov[np.ix_(inside, inside)], how.risk_aversion, how.fully_invested, how.shorting)
    assets = rows["asset"].to_numpy(object)
    return [(day, assets[k], w, scores[k], None if np.isnan(today[k]) else today[k], "ok") for k, w in zip(use, weights)]


def _grid(history: pd.DataFrame, assets, low: int, high: int) -> np.ndarray:
    """Values as (time from low to high, asset), NaN where there is none."""
    place = {a: k for k, a in enumerate(assets)}
    x = np.full((high - low + 1, len(place)), np.nan)
    some = history[(history["date_idx"] >= low) & (history["date_idx"] <= high) & history["asset"].isin(place)]
    x[some["date_idx"].to_numpy(int) - low, some["asset"].map(place).to_numpy(int)] = some["target"].to_numpy(float)
    return x


def _block_covariances(forecasts: DataFrame, history: DataFrame, how: Backtest, kind: str, n_assets: int) -> DataFrame:
    """(date_idx, rows, columns, cov): for each date with forecasts, the covariance over the W dates before it between the
    assets of two blocks, as the bytes of a matrix of doubles, NaN for pairs with fewer than two dates in common."""
    blocks = max(1, -(-n_assets // how.block_assets))
    block = F.pmod(F.xxhash64("asset"), F.lit(blocks))
    pair = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda k: F.struct(F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j")))
    values = history.withColumn("block", block.cast("int")).select("chunk", "date_idx", "asset", "target", "block", F.explode(pair).alias("pair")).select("chunk", "date_idx", "asset", "target", "block", "pair.i", "pair.j")
    pairs = F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda i: F.transform(F.sequence(i, F.lit(blocks - 1)), lambda j: F.struct(i.alias("i"), j.alias("j"))))))
    days = forecasts.where(F.col("date_idx") >= how.window).select("chunk", "date_idx").distinct().select("chunk", "date_idx", pairs.alias("pair")).select("chunk", "date_idx", "pair.i", "pair.j")

    def work(days: pd.DataFrame, values: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(days) and len(values):
            i, j = int(days["i"].iat[0]), int(days["j"].iat[0])
            sides = [sorted(set(values.loc[values["block"] == b, "asset"])) for b in (i, j)]
            low, high = int(days["date_idx"].min()) - how.window, int(days["date_idx"].max()) - 1
            x, y = (_grid(values, side, low, high) for side in sides)
            # Covariances don't depend on where values are centred; the chunk's mean keeps the sums small.
            x, y = (v - np.nan_to_num(np.nansum(v, axis=0) / np.maximum(np.isfinite(v).sum(axis=0), 1)) for v in (x, y))
            for day in sorted(days["date_idx"]):
                window = slice(int(day) - how.window - low, int(day) - low)
                cov = pair_covariance(*pair_sums(x[window], y[window]))
                out.append((int(day), sides[0], sides[1], cov.tobytes()))
        return pd.DataFrame(out, columns=["date_idx", "rows", "columns", "cov"])

    keys = ["chunk", "i", "j"]
    return days.groupBy(*keys).cogroup(values.groupBy(*keys)).applyInPandas(work, f"date_idx long, rows array<{kind}>, columns array<{kind}>, cov binary")


def _assembled(parts: pd.DataFrame, assets: list) -> np.ndarray:
    """One date's covariance of these assets from blocks of pairs."""
    place = {a: k for k, a in enumerate(assets)}
    out = np.full((len(assets), len(assets)), np.nan)
    for rows, columns, cov in zip(parts["rows"], parts["columns"], parts["cov"]):
        matrix = np.frombuffer(cov).reshape(len(rows), len(columns))
        a, b = [k for k, r in enumerate(rows) if r in place], [k for k, c in enumerate(columns) if c in place]
        if a and b:
            at = np.ix_([place[rows[k]] for k in a], [place[columns[k]] for k in b])
            out[at] = matrix[np.ix_(a, b)]
            out[at[1].T, at[0].T] = matrix[np.ix_(a, b)].T
    return out


def zscore_alpha(mu: np.ndarray, sigma: np.ndarray) -> np.ndarray:
    """z-score of mu / sigma over sigma > 0 (population deviation; 0 for all if that is 0); NaN elsewhere."""
    out = np.full(len(mu), np.nan)
    good = sigma > 0
    raw = mu[good] / sigma[good]
    spread = raw.std() if len(raw) else 0.0
    out[good] = (raw - raw.mean()) / spread if spread > 0 and np.isfinite(spread) else 0.0
    return out


def backtest(predictions: DataFrame, panel: DataFrame, how: Backtest = Backtest(), target: str = "ret", id: str = "asset_id", date: str = "date", alpha_fn=zscore_alpha, cov_fn=None, solve_fn=mean_variance) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(weights, returns, status): per (date, asset) the weight, alpha and realized return; per date the portfolio's
    return and shape; per status the number of dates. Forecast dates and assets that the panel lacks fail. The solved
    dates are written once, since all results come from them.

    alpha_fn, cov_fn and solve_fn are plug-ins on numpy arrays. cov_fn(x, ridge, relative) gets a window of all assets with
    forecasts (time, asset) and gives those kept and their matrix; its groups hold a chunk of dates with all assets.
    Without it the pairwise covariance is taken in asset blocks."""
    index = date_index(panel, date)
    shown = date_bounds(predictions, how.start, how.end).select(F.col("forecast_start_date").alias(date), F.col("asset_id").alias("asset"), "mu", "sigma")
    key = F.floor(F.col("date_idx") / how.chunk).cast("long")
    kind = panel.schema[id].dataType.simpleString()
    values = panel.join(index, date).groupBy("date_idx", F.col(id).alias("asset")).agg(F.first(F.col(target).cast("double"), ignorenulls=True).alias("target"))
    ids = panel.select(F.col(id).alias("asset"), F.lit(True).alias("listed")).distinct()
    located = shown.join(index, date, "left").join(ids, "asset", "left")
    told = lambda what, c: F.raise_error(F.concat(F.lit(f"{what} isn't in the panel: "), F.coalesce(F.col(c).cast("string"), F.lit("null"))))
    found = F.coalesce("date_idx", F.when(F.col("date_idx").isNull(), told("a forecast date", date)).cast("long")).alias("date_idx")
    f = located.select(found, F.when(F.col("listed"), F.col("asset")).otherwise(told("a forecast asset", "asset").cast(kind)).alias("asset"), "mu", "sigma")
    f = f.join(values.withColumnRenamed("target", "realized"), ["date_idx", "asset"], "left").withColumn("chunk", key)
    last = F.floor((F.col("date_idx") + how.window) / how.chunk).cast("long")  # the chunk of the last date that looks back this far
    h = values.withColumn("chunk", F.explode(F.sequence(key, last)))
    schema = f"date_idx long, asset {kind}, weight double, alpha double, realized_return double, status string"

    def some_days(forecasts: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        out, parts = [], dict(iter(blocks.groupby("date_idx")))
        for day, rows in forecasts.sort_values("asset").groupby("date_idx", sort=True):
            cov_of = lambda known: ridged(_assembled(parts.get(day, blocks[:0]), list(known["asset"])), how.ridge, how.ridge_relative)  # noqa: B023,E731
            out += _weights(int(day), rows.reset_index(drop=True), how, alpha_fn, cov_of, solve_fn)
        return pd.DataFrame(out, columns=SOLVED)

    def one_chunk(forecasts: pd.DataFrame, history: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(forecasts):
            low, high = int(min(history["date_idx"].min() if len(history) else 0, forecasts["date_idx"].min())), int(forecasts["date_idx"].max())
            assets = sorted(set(history["asset"]) | set(forecasts["asset"]))
            x, place = _grid(history, assets, low, high), {a: k for k, a in enumerate(assets)}
            for day, rows in forecasts.sort_values("asset").groupby("date_idx", sort=True):
                window = lambda known: cov_fn(x[int(day) - how.window - low : int(day) - low][:, known["asset"].map(place).to_numpy(int)], how.ridge, how.ridge_relative)  # noqa: B023,E731
                out += _weights(int(day), rows.reset_index(drop=True), how, alpha_fn, window, solve_fn)
        return pd.DataFrame(out, columns=SOLVED)

    if cov_fn is None:
        n_assets = panel.select(id).distinct().count()
        group = F.floor(F.col("date_idx") / max(1, min(how.chunk, GROUP_CELLS // max(n_assets, 1) ** 2))).alias("group")
        blocks = _block_covariances(f, h, how, kind, n_assets)
        solved = f.groupBy(group).cogroup(blocks.groupBy(group)).applyInPandas(some_days, schema)
    else:
        solved = f.groupBy("chunk").cogroup(h.groupBy("chunk")).applyInPandas(one_chunk, schema)
    with failing():
        solved = written(solved, "backtest").join(index, "date_idx")
    weights = solved.where("status = 'ok'").select(date, F.col("asset").alias("asset_id"), "weight", "alpha", "realized_return")
    status = solved.groupBy("status").agg(F.count_distinct("date_idx").alias("n_dates"))
    return weights, portfolio_returns(weights, date), status


def summary(weights: DataFrame, returns: DataFrame, status: DataFrame, how: Backtest, date: str = "date") -> DataFrame:
    """One row: rebalance dates, assets ever held, first and last date (null without any), the dates skipped by reason,
    the burn-in in dates and the policy for missing forecasts."""
    dates = returns.agg(F.count("*").alias("n_rebalance_dates"), F.min(date).alias("start_date"), F.max(date).alias("end_date"))
    assets = weights.agg(F.count_distinct("asset_id").alias("n_unique_assets"))
    of = lambda name, alias: F.coalesce(F.max(F.when(F.col("status") == name, F.col("n_dates"))), F.lit(0)).cast("long").alias(alias)
    skipped = status.agg(of("burn_in", "skipped_burn_in_dates"), of("missing", "skipped_missing_asset_dates"), of("universe", "skipped_insufficient_universe_dates"))
    out = dates.join(assets).join(skipped)  # one row each
    return out.select(
        "n_rebalance_dates", "n_unique_assets", "start_date", "end_date", "skipped_burn_in_dates", "skipped_missing_asset_dates", "skipped_insufficient_universe_dates",
        F.lit(how.burn_in or how.window).cast("long").alias("burn_in_days"), F.lit("drop_date" if how.drop_date else "drop_asset").alias("missing_asset_policy"),
    )


def portfolio_returns(weights: DataFrame, date: str = "date") -> DataFrame:
    """Per date, over assets with a realized return; weights aren't renormalised."""
    known = weights.where(F.col("realized_return").isNotNull())
    w = F.col("weight")
    out = known.groupBy(date).agg(F.sum(w * F.col("realized_return")).alias("portfolio_return"), F.count("*").alias("n_assets_held"), F.sum(F.abs(w)).alias("leverage"), F.sum(w * w).alias("hhi"))
    return out.withColumn("effective_n", F.try_divide(F.lit(1.0), F.col("hhi")))


def turnover(weights: DataFrame, date: str = "date", id: str = "asset_id") -> DataFrame:
    """(k, turnover) for each rebalance but the first: sum of |w - previous w|, an absent weight being 0."""
    index = date_index(weights, date).select(date, F.col("date_idx").alias("k"))
    rows = weights.join(F.broadcast(index), date).select("k", F.col(id).alias("a"), "weight")
    before = rows.select((F.col("k") + 1).alias("k"), "a", F.col("weight").alias("was"))
    both = rows.join(before, ["k", "a"], "full").join(F.broadcast(index.select("k")), "k", "left_semi").where("k > 0")
    return both.groupBy("k").agg(F.sum(F.abs(F.coalesce("weight", F.lit(0.0)) - F.coalesce("was", F.lit(0.0)))).alias("turnover"))


def portfolio_metrics(returns: DataFrame, weights: DataFrame | None = None, periods: int = 252, date: str = "date") -> DataFrame:
    """One row; nulls and n_days 0 for an empty portfolio. The drawdown is over a table of one row per date."""
    r = F.col("portfolio_return")
    whole = Window.partitionBy(F.lit(0)).orderBy(date).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    curve = returns.withColumn("cum", F.product(1 + r).over(whole)).withColumn("drawdown", F.col("cum") / F.max("cum").over(Window.partitionBy(F.lit(0)).orderBy(date).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1)
    stats = curve.agg(F.product(1 + r).alias("total"), F.avg(r).alias("m"), F.stddev_pop(r).alias("s"), F.min("drawdown").alias("max_drawdown"), F.avg((r > 0).cast("double")).alias("hit_rate"), F.avg("leverage").alias("mean_leverage"), F.avg("effective_n").alias("mean_effective_n"), F.count("*").alias("n_days"))
    turned = weights if weights is None else turnover(weights, date).agg(F.avg("turnover").alias("mean_turnover"))
    out = stats if turned is None else stats.join(turned)  # one row each
    root = F.sqrt(F.lit(float(periods)))
    return out.select(
        (F.pow("total", F.lit(float(periods)) / F.greatest(F.lit(1), F.col("n_days"))) - 1).alias("annual_return"), (F.col("s") * root).alias("annual_vol"),
        F.when(F.col("s") > 0, F.col("m") / F.col("s") * root).alias("sharpe"), "max_drawdown", "hit_rate", F.col("m").alias("mean_daily_return"), F.col("s").alias("std_daily_return"),
        (F.lit(None).cast("double") if turned is None else F.col("mean_turnover")).alias("mean_turnover"), "mean_leverage", "mean_effective_n", "n_days",
    )


def versus_benchmarks(returns: DataFrame, panel: DataFrame, benchmarks, target: str = "ret", id: str = "asset_id", date: str = "date") -> DataFrame:
    """(series, date, value) of the portfolio and the benchmark assets on their common dates. An asset without values, or
    no common date, fails when the plan runs: that is found in a table of one row per date."""
    names = sorted({str(b) for b in benchmarks})
    rows = panel.where(F.col(id).cast("string").isin(names) & F.col(target).isNotNull()).select(F.col(id).cast("string").alias("series"), date, F.col(target).alias("value"))
    every = rows.unionByName(returns.select(F.lit("portfolio").alias("series"), date, F.col("portfolio_return").alias("value")))
    days = every.groupBy(date).agg(F.collect_set("series").alias("there"))
    whole = Window.partitionBy(F.lit(0))
    absent = F.filter(F.array(*[F.when(~F.max(F.array_contains("there", n)).over(whole), F.lit(n)) for n in names]), lambda n: n.isNotNull())
    common = F.size("there") == len(names) + 1
    told = days.withColumns({"absent": absent, "common": common}).withColumn("some", F.max("common").over(whole))
    fails = F.when(F.size("absent") > 0, F.concat(F.lit("unknown benchmark assets: "), F.array_join("absent", ", "))).when(~F.col("some"), F.lit("no common dates"))
    kept = told.where(F.when(fails.isNotNull(), F.raise_error(fails).cast("boolean")).otherwise(F.col("common"))).select(date)
    return every.join(kept, date, "left_semi")
