"""Helpers of the registered queries: rounding on both engines, and text shared by several SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.calendar import federal_holidays
from ..sources import fixtures

DIGITS = 6


def rounded(df: DataFrame, nan_is_null: bool = True) -> DataFrame:
    """Doubles to six decimals, NaN to null. The product is rounded, as the SQL's round does; Spark's own goes by the
    shortest decimal text, which is at times on the other side of a half."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        near = F.when(F.abs(c) < 1e300, F.round(c * 10.0**DIGITS) / 10.0**DIGITS).otherwise(c) + 0.0
        out.append((F.when(~F.isnan(c), near) if nan_is_null else near).alias(f.name) if isinstance(f.dataType, T.DoubleType) else c)
    return df.select(*out)


def oracle(sql: str, *doubles: str) -> str:
    """SQL whose named columns are rounded like the query's."""
    if not doubles:
        return sql
    return f"SELECT * REPLACE ({', '.join(f'round({c}, {DIGITS}) + 0.0 AS {c}' for c in doubles)}) FROM ({sql}) AS answer"


def panel_sql(name: str) -> str:
    return fixtures.on_tables(fixtures.PANELS[name])


def predictions_sql(name: str) -> str:
    return fixtures.on_tables(fixtures.PREDICTIONS[name])


def sessions_sql(source: str) -> str:
    """Sessions between the first and last date of a relation with a date column."""
    closed = ", ".join(f"DATE '{d}'" for d in federal_holidays(1990, 2030))
    return f"""SELECT session FROM (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS session
      FROM (SELECT CAST(min(date) AS TIMESTAMP) AS lo, CAST(max(date) AS TIMESTAMP) AS hi FROM {source}) AS ends) AS days
      WHERE isodow(session) <= 5 AND session NOT IN ({closed})"""
