"""Time-ordered folds, date bootstraps and asset subsets as membership tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import preprocess, windows
from .contracts import ContractError, Roles


def date_index(df: DataFrame, date: str = "date") -> DataFrame:
    """(date, date_idx): sorted unique dates, nulls dropped, from 0; fails if there are none. A row per date."""
    dates = df.select(date).where(F.col(date).isNotNull()).distinct()
    out = dates.withColumn("date_idx", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(date)) - 1).cast("long"))
    if out.isEmpty():
        raise ContractError("no dates")
    return out


def _size(dates: DataFrame) -> int:
    return dates.agg(F.max("date_idx")).first()[0] + 1



def _folds(dates: DataFrame, bounds, date: str) -> DataFrame:
    """All folds in one plan: a small table of bounds, joined by range with the date dimension."""
    rows = [(k, *train, *val) for k, (train, val) in enumerate(bounds)]
    table = dates.sparkSession.createDataFrame(rows, "fold int, train_from long, train_to long, val_from long, val_to long")
    idx = F.col("date_idx")
    in_train = (idx >= F.col("train_from")) & (idx < F.col("train_to"))
    in_val = (idx >= F.col("val_from")) & (idx < F.col("val_to"))
    joined = dates.join(F.broadcast(table), in_train | in_val)  # folds are few by definition
    return joined.select("fold", date, F.when(in_train, "train").otherwise("val").alias("split"))


def holdout(dates: DataFrame, fraction: float, date: str = "date") -> DataFrame:
    """(fold, date, split): the last max(1, floor(n f)) dates are val."""
    if not 0 < fraction < 1:
        raise ContractError("the fraction must be in (0, 1)")
    n = _size(dates)
    n_val = max(1, int(n * fraction))
    if n_val >= n:
        raise ContractError("no training dates left")
    return _folds(dates, [((0, n - n_val), (n - n_val, n))], date)


def expanding(dates: DataFrame, folds: int, date: str = "date") -> DataFrame:
    """b = floor(n / (folds + 1)): fold k trains on the first b (k + 1) dates and validates on the next b."""
    b = _size(dates) // (folds + 1)
    if b == 0:
        raise ContractError("too few dates for so many folds")
    return _folds(dates, [((0, b * (k + 1)), (b * (k + 1), b * (k + 2))) for k in range(folds)], date)


def walk_forward(dates: DataFrame, folds: int, window: int | None = None, date: str = "date") -> DataFrame:
    """As expanding, but training on the last `window` dates (b by default) before val."""
    b = _size(dates) // (folds + 1)
    if b == 0:
        raise ContractError("too few dates for so many folds")
    return _folds(dates, [((max(0, b * (k + 1) - (window or b)), b * (k + 1)), (b * (k + 1), b * (k + 2))) for k in range(folds)], date)


def slice_dates(df: DataFrame, dates: DataFrame, date: str = "date") -> DataFrame:
    """Rows on these dates; fails if there are none."""
    out = df.join(dates.select(date).distinct(), date, "left_semi")
    if out.isEmpty():
        raise ContractError("no rows on these dates")
    return out


def slice_dates_assets(df: DataFrame, dates: DataFrame, assets: DataFrame, date: str = "date", id: str = "asset_id") -> DataFrame:
    return slice_dates(df, dates, date).join(assets.select(id).distinct(), id, "left_semi")


def in_folds(panel: DataFrame, folds: DataFrame, date: str = "date") -> DataFrame:
    """Panel rows with each (fold, split) that their date is in."""
    return panel.join(folds, date)


def fold_windows(panel: DataFrame, folds: DataFrame, roles: Roles, in_steps: int, horizon: int = 1, out_steps: int = 1, mode: str = "tail", scaled=(), id: str = "asset_id", date: str = "date") -> DataFrame:
    """Leak-free windows: (fold, split, …) windows that lie within one slice of one fold, with the columns `scaled` on
    the scale of their fold's training rows. Ids that a fold doesn't train on have no windows there. All folds in one
    plan; no window looks over the border of its slice."""
    rows = in_folds(panel, folds, date)
    if scaled:
        state = preprocess.fit_scaler(rows.where("split = 'train'"), scaled, id, by=["fold"])
        known = rows.join(state.select("fold", id).distinct(), ["fold", id], "left_semi")
        rows = preprocess.scale(known, state, scaled, id, by=["fold"], strict=False)
    return windows.make_windows(rows, roles, in_steps, horizon, out_steps, mode, by=("fold", "split"))


def hashed(*parts) -> Column:
    """A number from 0 to 2^60 - 1 for these values: the first 15 hex digits of the md5 of their texts, joined by colons.
    Any engine with md5 can repeat the draws."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])), 1, 15), 16, 10).cast("long")


def bootstrap_dates(dates: DataFrame, estimators: int, fraction: float = 1.0, seed: int = 0, date: str = "date") -> DataFrame:
    """(estimator, date, bag): max(1, round-half-even(n f)) draws with replacement for each estimator; dates drawn are
    'in' once, the others 'oob'. Deterministic in the seed."""
    if not 0 < fraction <= 1:
        raise ContractError("the fraction must be in (0, 1]")
    n = _size(dates)
    draws = max(1, round(n * fraction))
    spark = dates.sparkSession
    drawn = (
        spark.range(estimators).select(F.col("id").cast("int").alias("estimator"), F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"), F.lit(n).cast("long").alias("n"))
        .select("estimator", (hashed(F.lit(seed), F.lit("date"), "estimator", "draw") % F.col("n")).alias("date_idx")).distinct()
    )
    every = spark.range(estimators).select(F.col("id").cast("int").alias("estimator")).join(dates)  # the result's size
    return every.join(drawn.withColumn("bag", F.lit("in")), ["estimator", "date_idx"], "left").select("estimator", date, F.coalesce("bag", F.lit("oob")).alias("bag"))


def no_bootstrap(dates: DataFrame, estimators: int, date: str = "date") -> DataFrame:
    """All dates in every bag."""
    return dates.sparkSession.range(estimators).select(F.col("id").cast("int").alias("estimator")).join(dates).select("estimator", date, F.lit("in").alias("bag"))


def out_of_bag(dates: DataFrame, in_bag: DataFrame, estimators: int, date: str = "date") -> DataFrame:
    """Dates that an estimator hasn't drawn."""
    every = dates.sparkSession.range(estimators).select(F.col("id").cast("int").alias("estimator")).join(dates.select(date))
    return every.join(in_bag.select("estimator", date), ["estimator", date], "left_anti")


def asset_subspace(ids: DataFrame, estimators: int, fraction: float = 1.0, seed: int = 0, id: str = "asset_id") -> DataFrame:
    """(estimator, id): max(1, round-half-even(n f)) ids for each estimator, without replacement: those with the smallest
    hashes. The rank runs over a row per estimator and id."""
    if not 0 < fraction <= 1:
        raise ContractError("the fraction must be in (0, 1]")
    distinct = ids.select(id).distinct()
    keep = max(1, round(distinct.count() * fraction))
    every = ids.sparkSession.range(estimators).select(F.col("id").cast("int").alias("estimator")).join(distinct)
    rank = F.row_number().over(Window.partitionBy("estimator").orderBy(hashed(F.lit(seed), F.lit("asset"), "estimator", id), id))
    return every.withColumn("r", rank).where(F.col("r") <= keep).select("estimator", id)
