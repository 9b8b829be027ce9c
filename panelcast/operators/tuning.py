"""Search grids, random trials, cross-validation of user functions, and batch scoring of windows by user models."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .contracts import ContractError
from .ensemble import aggregate_gaussians
from .splits import hashed
from .windows import zero_fill


def grid(spark: SparkSession, space: dict[str, list]) -> DataFrame:
    """(trial_number, params…): the product of the choices, in their order. The tables are the parameter lists."""
    if not space or any(not choices for choices in space.values()):
        raise ContractError("every parameter needs choices")
    tables = [spark.createDataFrame([(i, c) for i, c in enumerate(choices)], [f"__{name}", name]) for name, choices in space.items()]
    product = reduce(lambda a, b: a.crossJoin(b), tables)
    number = F.lit(0).cast("long")
    for name, choices in space.items():
        number = number * len(choices) + F.col(f"__{name}")
    return product.select(number.alias("trial_number"), *space)


def random_trials(spark: SparkSession, space: dict[str, list], n: int, seed: int = 0) -> DataFrame:
    """n trials, each parameter picked by a hash of (seed, trial, parameter) that SQL can repeat."""
    if n < 1:
        raise ContractError("at least one trial is needed")
    pick = lambda name, choices: F.get(F.array(*map(F.lit, choices)), (hashed(F.lit(seed), F.lit("trial"), "id", F.lit(name)) % len(choices)).cast("int"))
    return spark.range(n).select(F.col("id").alias("trial_number"), *[pick(name, choices).alias(name) for name, choices in space.items()])


def cross_validate(panel: DataFrame, folds: DataFrame, trials: DataFrame, evaluate, date: str = "date") -> DataFrame:
    """(trial_number, fold, loss): evaluate(train, val, params) on pandas frames, for each trial and fold. For models that
    pool all assets: a group is one whole fold of one trial. What is fitted asset by asset goes through
    cross_validate_assets."""
    params = trials.select("trial_number", F.to_json(F.struct(*[c for c in trials.columns if c != "trial_number"])).alias("params"))
    rows = panel.join(folds, date).join(F.broadcast(params))

    def work(group: pd.DataFrame) -> pd.DataFrame:
        keep = [c for c in group.columns if c not in ("split", "fold", "trial_number", "params")]
        train, val = (group.loc[group["split"] == s, keep] for s in ("train", "val"))
        loss = evaluate(train, val, json.loads(group["params"].iat[0]))
        return pd.DataFrame({"trial_number": [group["trial_number"].iat[0]], "fold": [group["fold"].iat[0]], "loss": [float(loss)]})

    return rows.groupBy("trial_number", "fold").applyInPandas(work, "trial_number long, fold int, loss double")


#: Trials that one group evaluates.
TRIALS = 64


def cross_validate_assets(panel: DataFrame, folds: DataFrame, trials: DataFrame, errors, finish=lambda mean: mean, id: str = "asset_id", date: str = "date", bucket_ids: int = 64) -> DataFrame:
    """(trial_number, fold, loss) of models that are fitted asset by asset: errors(train, val, params) gets pandas frames
    with all of a fold's rows of some assets, and gives the sum and the number of their errors. Sums and numbers add up
    over assets; loss = finish(sum / number), finish being an expression (null without errors). A group is a fold of
    about bucket_ids assets, so no group grows with the panel's width, and a row is dealt once a fold for each TRIALS
    trials, whose parameters go with the function."""
    listed = [(r["trial_number"], json.loads(r["params"])) for r in trials.select("trial_number", F.to_json(F.struct(*[c for c in trials.columns if c != "trial_number"])).alias("params")).orderBy("trial_number").collect()]
    buckets = max(1, -(-panel.select(id).distinct().count() // bucket_ids))
    keep = list(panel.columns)
    dealt = panel.join(folds, date).withColumn("__bucket", F.pmod(F.xxhash64(id), F.lit(buckets)))
    dealt = dealt.withColumn("__trials", F.explode(F.sequence(F.lit(0), F.lit(max(0, (len(listed) - 1) // TRIALS)))))

    def work(group: pd.DataFrame) -> pd.DataFrame:
        train, val = (group.loc[group["split"] == s, keep] for s in ("train", "val"))
        fold, block = int(group["fold"].iat[0]), int(group["__trials"].iat[0])
        out = [(number, fold, *errors(train, val, params)) for number, params in listed[block * TRIALS : (block + 1) * TRIALS]]
        return pd.DataFrame(out, columns=["trial_number", "fold", "total", "n"])

    parts = dealt.groupBy("fold", "__bucket", "__trials").applyInPandas(work, "trial_number long, fold int, total double, n long")
    sums = parts.groupBy("trial_number", "fold").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    return sums.select("trial_number", "fold", finish(F.try_divide("total", "n")).alias("loss"))


def trial_values(fold_losses: DataFrame, trials: DataFrame) -> DataFrame:
    """(trial_number, state, value, params…): the mean loss over folds."""
    means = fold_losses.groupBy("trial_number").agg(F.avg("loss").alias("value"))
    params = [c for c in trials.columns if c != "trial_number"]
    out = trials.join(means, "trial_number", "left")
    return out.select("trial_number", F.when(F.col("value").isNotNull(), "COMPLETE").otherwise("FAIL").alias("state"), "value", *params)


def _scored(windows: DataFrame, features, models: dict, mode: str, id: str, by) -> DataFrame:
    """Predictions of each model, with its key as estimator, in one pass over the windows."""
    if mode not in ("tail", "next_step"):
        raise ContractError(f"no mode {mode}")
    names = [f"x_{f}" for f in features]
    keys = [*by, "forecast_start_date"]
    rows = zero_fill(windows).select(*by, F.col(id).alias("asset_id"), "forecast_start_date", "forecast_end_date", *[F.col(n).cast("array<double>").alias(n) for n in names])
    kept = [*by, "forecast_start_date", "forecast_end_date", "asset_id"]
    schema = T.StructType([*(rows.schema[c] for c in kept), T.StructField("estimator", T.IntegerType()), T.StructField("mu", T.DoubleType()), T.StructField("sigma", T.DoubleType())])
    position = 0 if mode == "tail" else -1

    def day(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts).combine_chunks()
        n = len(table)
        x = np.stack([table[name].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1) for name in names], axis=-1)
        pick = lambda a: pa.array(np.asarray(a, float).reshape(n, -1)[:, position])
        for number, model in models.items():
            mu, sigma = model(x)
            columns = [*(table[c].combine_chunks() for c in kept), pa.array(np.full(n, number, np.int32)), pick(mu), pick(sigma)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []  # the rows so far of the date that may go on in the next batch
        key = None
        for batch in batches:
            if not len(batch):
                continue
            codes = [batch.column(k) for k in keys]
            new = np.zeros(len(batch), bool)
            for c in codes:
                new[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
            first = tuple(c[0].as_py() for c in codes)
            if waiting and first != key:
                yield from day(waiting)
                waiting = []
            cuts = [0, *np.flatnonzero(new).tolist(), len(batch)]
            for a, b in zip(cuts, cuts[1:]):
                if a:
                    yield from day(waiting)
                    waiting = []
                waiting.append(batch.slice(a, b - a))
            key = tuple(c[len(batch) - 1].as_py() for c in codes)
        if waiting:
            yield from day(waiting)

    return rows.repartition(*keys).sortWithinPartitions(*keys, "asset_id").mapInArrow(work, schema)


def score_windows(windows: DataFrame, features, model, mode: str = "tail", id: str = "asset_id", by=()) -> DataFrame:
    """Predictions of a user model on windows: model(x) takes a zero-filled array (rows, steps, features) with the
    assets of one forecast date in id order, and gives (mu, sigma) arrays (rows, outputs). The first output counts in
    tail mode, the last one in next-step mode. All assets of a date are in one call; dates are dealt by hash over as many
    tasks as the session shuffles into, and stream through them in order, so a task holds one date at a time."""
    return _scored(windows, features, {0: model}, mode, id, by).drop("estimator")


def score_ensemble(windows: DataFrame, features, models: dict[int, object], mode: str = "tail", aggregation: str = "mean") -> DataFrame:
    """All surviving models on the same windows, in one pass, so that they share one grid; then aggregated."""
    if not models:
        raise ContractError("no models")
    return aggregate_gaussians(_scored(windows, features, models, mode, "asset_id", ()), aggregation)
