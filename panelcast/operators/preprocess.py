"""Per-asset scaling and categorical vocabularies: fitted state is a table, applied by a join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .contracts import ContractError

MISSING, UNKNOWN, FIRST = 0, 1, 2


def fit_scaler(df: DataFrame, columns, id: str = "asset_id", by=()) -> DataFrame:
    """(by…, id, feature, mean, variance, scale): population variance, nulls skipped; scale 0 counts as 1. All
    features in one aggregation, then one row for each."""
    if not columns:
        raise ContractError("no feature columns to scale")
    wide = df.groupBy(*by, id).agg(*[f(F.col(c).cast("double")).alias(f"{n}_{k}") for k, c in enumerate(columns) for n, f in (("m", F.avg), ("v", F.var_pop))])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"m_{k}").alias("mean"), F.col(f"v_{k}").alias("variance")) for k, c in enumerate(columns)])
    return wide.select(*by, id, F.inline(rows)).withColumn("scale", F.when(F.col("variance") == 0, 1.0).otherwise(F.sqrt("variance")))


def _wide(state: DataFrame, id: str, by=()) -> tuple[DataFrame, list[str]]:
    """State with one row per id, and a map per feature."""
    each = state.groupBy(*by, id).agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("mean", "scale")))).alias("__state"))
    return each, ["__state"]


def _with_state(df: DataFrame, state: DataFrame, id: str, by=(), strict: bool = True) -> DataFrame:
    """Rows with their state. strict: a row without one fails when the plan runs (a ContractError inside `failing`)."""
    each, _ = _wide(state, id, by)
    # The state has a row per asset: the optimiser broadcasts it while it is small.
    out = df.join(each, [*by, id], "left")
    if not strict:
        return out
    told = F.concat(F.lit("no scaler for "), F.to_json(F.struct(*by, id)))
    return out.withColumn("__state", F.coalesce("__state", F.raise_error(told).cast(each.schema["__state"].dataType)))


def scale(df: DataFrame, state: DataFrame, columns, id: str = "asset_id", by=(), strict: bool = True) -> DataFrame:
    s = lambda c: F.col("__state")[c]
    return _with_state(df, state, id, by, strict).select(*[((F.col(c) - s(c)["mean"]) / s(c)["scale"]).alias(c) if c in columns else F.col(c) for c in df.columns])


def unscale(df: DataFrame, state: DataFrame, columns, id: str = "asset_id", by=(), strict: bool = True) -> DataFrame:
    s = lambda c: F.col("__state")[c]
    return _with_state(df, state, id, by, strict).select(*[(F.col(c) * s(c)["scale"] + s(c)["mean"]).alias(c) if c in columns else F.col(c) for c in df.columns])


def unscale_gaussian(predictions: DataFrame, state: DataFrame, target: str, id: str = "asset_id") -> DataFrame:
    """mu and sigma back on the target's scale; unchanged if the target isn't a scaled column."""
    own = state.where(F.col("feature") == target)
    if own.isEmpty():
        return predictions
    joined = _with_state(predictions, own, id)
    s = F.col("__state")[target]
    return joined.select(*[{"mu": F.col("mu") * s["scale"] + s["mean"], "sigma": F.col("sigma") * s["scale"]}.get(c, F.col(c)).alias(c) for c in predictions.columns])


def value_type(kind: T.DataType) -> str:
    if isinstance(kind, T.BooleanType):
        return "bool"
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return "float"
    if isinstance(kind, T.IntegralType):
        return "int"
    if isinstance(kind, T.StringType):
        return "str"
    raise ContractError(f"no token type for {kind.simpleString()}")


def token_key(df: DataFrame, column: str) -> Column:
    """type::value; booleans as True and False, floats in plain decimals."""
    kind = value_type(df.schema[column].dataType)
    c = F.col(column)
    if kind == "bool":
        text = F.initcap(c.cast("string"))
    elif kind == "float":
        plain = c.cast("decimal(38,10)").cast("string")
        short = F.regexp_replace(plain, r"(\.\d+?)0+$", "$1")
        text = F.when(F.abs(c).between(1e-4, 1e16) | (c == 0), short).otherwise(c.cast("string"))
    else:
        text = c.cast("string")
    return F.when(c.isNotNull(), F.concat(F.lit(f"{kind}::"), text))


def fit_vocabulary(df: DataFrame, columns) -> DataFrame:
    """(column, token_key, value_type, value, token_id): distinct keys in lexicographic order, from 2."""
    keys = df.select(*[token_key(df, c).alias(c) for c in columns])
    long = keys.unpivot([], list(columns), "column", "token_key").where("token_key IS NOT NULL").distinct()
    number = F.row_number().over(Window.partitionBy("column").orderBy("token_key")) + (FIRST - 1)
    parts = F.split("token_key", "::", 2)
    return long.select("column", "token_key", parts[0].alias("value_type"), parts[1].alias("value"), number.cast("long").alias("token_id"))


def vocabulary_sizes(vocabulary: DataFrame, columns) -> DataFrame:
    """(column, size): distinct values and the two reserved ids."""
    counts = vocabulary.groupBy("column").agg(F.count("*").alias("n"))
    names = vocabulary.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return names.join(counts, "column", "left").select("column", (F.coalesce("n", F.lit(0)) + FIRST).alias("size"))


def encode(df: DataFrame, vocabulary: DataFrame, columns) -> DataFrame:
    """Null to 0, unseen to 1, else the id."""
    out = df
    for c in columns:
        own = vocabulary.where(F.col("column") == c).select(F.col("token_key").alias("__key"), F.col("token_id").alias("__id"))
        key = token_key(df, c)
        coded = F.when(F.col("__was").isNull(), F.lit(MISSING)).otherwise(F.coalesce("__id", F.lit(UNKNOWN))).cast("long")
        out = out.withColumn("__was", key).join(own, F.col("__was") == F.col("__key"), "left").withColumn(c, coded).drop("__was", "__key", "__id")
    return out.select(*df.columns)


def decode(df: DataFrame, vocabulary: DataFrame, columns) -> DataFrame:
    """0 to null, an unknown id to [UNK], else the value as a string."""
    out = df
    for c in columns:
        own = vocabulary.where(F.col("column") == c).select(F.col("token_id").alias("__id"), F.col("value").alias("__value"))
        text = F.when(F.col(c) == MISSING, None).otherwise(F.coalesce("__value", F.lit("[UNK]")))
        out = out.join(own, F.col(c) == F.col("__id"), "left").withColumn(c, text).drop("__id", "__value")
    return out.select(*df.columns)


def apply_bundle(df: DataFrame, scaler: DataFrame, numeric, vocabulary: DataFrame, categorical, id: str = "asset_id") -> DataFrame:
    """Scale and encode; other columns as they are."""
    return encode(scale(df, scaler, numeric, id), vocabulary, categorical)


def union_all(frames) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def train_then_val(train: DataFrame, val: DataFrame, id: str = "asset_id", date: str = "date") -> DataFrame:
    """Rows of both; of a key in both, the train row."""
    both = train.withColumn("__source", F.lit(0)).unionByName(val.withColumn("__source", F.lit(1)))
    first = F.row_number().over(Window.partitionBy(id, date).orderBy("__source"))
    return both.withColumn("__n", first).where("__n = 1").select(*train.columns)
