"""Reading and writing panels, predictions, fitted state, metrics, backtests, trials and ensemble manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.contracts import ContractError, nan_to_null, require_columns

MANIFEST = "ensemble_type string, aggregation string, estimators array<struct<index: int, estimator_manifest_path: string, oob_val_loss: double>>"
PREDICTION_COLUMNS = ["forecast_start_date", "forecast_end_date", "asset_id", "mu", "sigma"]


def _read(spark: SparkSession, path: str, schema) -> DataFrame:
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path, enforceSchema=False) if schema else reader.csv(path)


def read_panel(spark: SparkSession, path: str, schema=None, required=(), id: str = "asset_id", date: str = "date") -> DataFrame:
    """CSV (with header) or Parquet; required columns are checked, NaN becomes null, dates are parsed (a bad one
    fails when read), rows are dealt by id and in date order."""
    df = _read(spark, path, schema)
    require_columns(df, [id, date, *required])
    if isinstance(df.schema[date].dataType, T.StringType):
        df = df.withColumn(date, F.to_timestamp(date))
    return nan_to_null(df).repartition(id).sortWithinPartitions(id, date)


def read_prediction_panel(spark: SparkSession, path: str, columns, schema=None, id: str = "asset_id", date: str = "date") -> DataFrame:
    """Date, id and the columns of the roles, each once, in that order."""
    df = read_panel(spark, path, schema, columns, id, date)
    return df.select(*dict.fromkeys([date, id, *columns]))


def read_predictions(spark: SparkSession, path: str, names: dict[str, str] | None = None, schema=None) -> DataFrame:
    df = nan_to_null(_read(spark, path, schema).withColumnsRenamed(names or {}))
    require_columns(df, ["asset_id", "forecast_start_date", "mu", "sigma"])
    return df.select("asset_id", F.col("forecast_start_date").cast("timestamp").alias("forecast_start_date"), F.col("mu").cast("double").alias("mu"), F.col("sigma").cast("double").alias("sigma"))


def read_realized(spark: SparkSession, path: str, target: str, id: str = "asset_id", date: str = "date", schema=None) -> DataFrame:
    df = nan_to_null(_read(spark, path, schema))
    require_columns(df, [id, date, target])
    return df.select(F.col(id).alias("asset_id"), F.col(date).cast("timestamp").alias("forecast_start_date"), F.col(target).cast("double").alias("target"))


def _mode(overwrite: bool) -> str:
    return "overwrite" if overwrite else "errorifexists"


def write_predictions(df: DataFrame, path: str, overwrite: bool = False) -> None:
    if df.isEmpty():
        raise ContractError("no predictions")
    df.select(*PREDICTION_COLUMNS).write.mode(_mode(overwrite)).parquet(path)


def write_state(scaler: DataFrame, vocabulary: DataFrame, path: str, overwrite: bool = False) -> None:
    scaler.write.mode(_mode(overwrite)).parquet(f"{path}/scaler.parquet")
    vocabulary.write.mode(_mode(overwrite)).parquet(f"{path}/vocabulary.parquet")


def read_state(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/scaler.parquet"), spark.read.parquet(f"{path}/vocabulary.parquet")


def write_windows(windows: DataFrame, path: str, overwrite: bool = False) -> None:
    """windows with a column split, which partitions the table."""
    require_columns(windows, ["split"])
    windows.write.mode(_mode(overwrite)).partitionBy("split").parquet(path)


def write_metrics(metrics: DataFrame, path: str, overwrite: bool = False) -> None:
    metrics.write.mode(_mode(overwrite)).partitionBy("model").parquet(path)


def write_backtest(weights: DataFrame, returns: DataFrame, metrics: DataFrame, path: str, overwrite: bool = False) -> None:
    for name, table in (("weights", weights), ("returns", returns), ("metrics", metrics)):
        table.write.mode(_mode(overwrite)).parquet(f"{path}/{name}.parquet")


def write_trials(trials: DataFrame, path: str, overwrite: bool = False) -> None:
    require_columns(trials, ["trial_number", "state", "value"])
    trials.write.mode(_mode(overwrite)).parquet(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per estimator: index, path and out-of-bag loss, with the ensemble's type and aggregation."""
    df = spark.read.option("multiLine", True).schema(MANIFEST).json(path)
    return df.select("ensemble_type", "aggregation", F.explode("estimators").alias("e")).select("ensemble_type", "aggregation", "e.*")
