"""Checks of panels, and the roles of their columns."""

from __future__ import annotations

import re
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ContractError(ValueError):
    """A panel that doesn't hold what an operator needs."""


@contextmanager
def failing():
    """Rows that a plan refuses (raise_error in one of its expressions) are a ContractError when it runs in here."""
    try:
        yield
    except Exception as error:
        if told := re.search(r"\[USER_RAISED_EXCEPTION\] ([^\n]*)", str(error)):
            raise ContractError(told[1]) from error
        raise


def require_columns(df: DataFrame, columns) -> None:
    if missing := sorted(set(columns) - set(df.columns)):
        raise ContractError(f"missing columns: {missing}")


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes null, once, on the way in: aggregates skip null, but carry NaN."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns])


def repeated_keys(df: DataFrame, id: str = "asset_id", date: str = "date") -> DataFrame:
    """Keys that more than one row has."""
    return df.groupBy(id, date).agg(F.count("*").alias("n")).where("n > 1")


def canonicalize(df: DataFrame, id: str = "asset_id", date: str = "date") -> DataFrame:
    """The panel dealt by id and in date order; fails if a column is missing, a date isn't one, or a key repeats."""
    require_columns(df, [id, date])
    if isinstance(df.schema[date].dataType, T.StringType):
        df = df.withColumn(date, F.to_timestamp(date))  # fails on what is no date
    if rows := repeated_keys(df, id, date).limit(1).collect():
        raise ContractError(f"repeated key: {rows[0].asDict()}")
    return df.repartition(id).sortWithinPartitions(id, date)


def varying_static(df: DataFrame, columns, id: str = "asset_id", count_null: bool = True) -> DataFrame:
    """Per id the number of distinct values of each column, for ids where one exceeds 1; null counts if asked."""
    counts = [(F.count_distinct(c) + (F.max(F.col(c).isNull().cast("int")) if count_null else 0)).alias(c) for c in columns]
    return df.groupBy(id).agg(*counts).where(" OR ".join(f"`{c}` > 1" for c in columns))


def check_static(df: DataFrame, columns, id: str = "asset_id") -> None:
    if rows := varying_static(df, columns, id).limit(1).collect():
        raise ContractError(f"a static feature varies: {rows[0].asDict()}")


@dataclass(frozen=True)
class Roles:
    targets: tuple[str, ...]
    dynamic: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    static: tuple[str, ...] = ()
    id: str = "asset_id"
    date: str = "date"
    names: tuple[str, ...] = field(default=(), compare=False)

    def __post_init__(self):
        for group in ("targets", "dynamic", "categorical", "static"):
            values = tuple(dict.fromkeys(getattr(self, group)))
            if any(not v or v != v.strip() for v in values):
                raise ContractError(f"an empty or untrimmed name in {group}")
            object.__setattr__(self, group, values)
        if clash := sorted(set(self.targets) & (set(self.categorical) | set(self.static))):
            raise ContractError(f"targets can't be categorical: {clash}")


def plan_dynamic(df: DataFrame, targets, id: str = "asset_id", date: str = "date") -> tuple[str, ...]:
    """Numeric columns: targets first, then the others as they stand; id and date aside."""
    numeric = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in (id, date)]
    out = tuple(dict.fromkeys([*(t for t in targets if t in numeric), *numeric]))
    if not out:
        raise ContractError("no numeric column")
    return out


def resolve(df: DataFrame, roles: Roles) -> Roles:
    """The roles with dynamic features planned if none are given; fails if a column is missing."""
    require_columns(df, [roles.id, roles.date, *roles.targets, *roles.dynamic, *roles.categorical, *roles.static])
    if roles.dynamic:
        return roles
    return Roles(roles.targets, plan_dynamic(df, roles.targets, roles.id, roles.date), roles.categorical, roles.static, roles.id, roles.date)
