"""Recursions over time, state = next(state, row) along each key's dates, as a scan in chunks of rows.

Spark's windows can't carry a computed state from row to row, and one loop per key would tie a long history to one task.
Where what a run of rows does to any state has a short summary (as affine steps have: a run of s = a s + b is again such
a step), a key's rows are dealt into chunks of `rows` successive dates: each chunk gives its summary, a fold over a
key's few summaries gives the state in which each chunk starts, and each chunk is then walked from there. One key's
history is so spread over many tasks, and no task holds more of it than a chunk, or one summary a chunk.

All of it is built-in array functions. Rows are shuffled once, by (key, chunk); only summaries are shuffled again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ROWS = 1_024


@dataclass(frozen=True)
class Recursion:
    """state and summary are struct types. next(state, row) gives the state after a row, none() the summary of no rows,
    add(summary, row) that of one more row, carry(state, summary) the state after such a run."""

    state: str
    summary: str
    next: Callable[[Column, Column], Column]
    none: Callable[[], Column]
    add: Callable[[Column, Column], Column]
    carry: Callable[[Column, Column], Column]


def affine(a: str, b: str) -> Recursion:
    """s = a s + b, by the row's columns a and b."""
    return Recursion(
        "struct<s:double>", "struct<a:double,b:double>",
        lambda now, row: F.struct((row[a] * now["s"] + row[b]).alias("s")),
        lambda: F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b")),
        lambda m, row: F.struct((m["a"] * row[a]).alias("a"), (row[a] * m["b"] + row[b]).alias("b")),
        lambda now, m: F.struct((m["a"] * now["s"] + m["b"]).alias("s")),
    )


def with_chunks(df: DataFrame, date: str = "date", rows: int = ROWS, name: str = "__chunk") -> DataFrame:
    """Adds the number of the row's chunk: `rows` successive dates of the whole table each, rows without a date last.
    Dates are numbered in a table of one row per date."""
    number = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.asc_nulls_last("__date"))) - 1
    dates = df.select(F.col(date).alias("__date")).distinct().withColumn(name, F.floor(number / rows))
    return df.join(dates, F.col(date).eqNullSafe(F.col("__date"))).drop("__date")


def _before(rows: Column, first: Column, then: Callable[[Column, Column], Column], state: str) -> Column:
    """The states before each element of an array."""
    kind = f"struct<now:{state},before:array<{state}>>"
    start = F.struct(first.cast(state).alias("now"), F.array().cast(f"array<{state}>").alias("before")).cast(kind)
    move = lambda s, row: F.struct(then(s["now"], row).cast(state).alias("now"), F.array_append(s["before"], s["now"]).alias("before")).cast(kind)
    return F.aggregate(rows, start, move, lambda s: s["before"])


def scan(df: DataFrame, how: Recursion, first: Column, before: str = "before", keys=("asset_id",), date: str = "date", rows: int = ROWS) -> DataFrame:
    """Adds the struct `before`, the state before each row. (keys, date) is unique. first is the state before a key's
    first row: an expression of columns that are constant for a key. Rows that have a chunk (with_chunks) keep it."""
    keys = list(keys)
    payload = [c for c in df.columns if c not in (*keys, date, "__chunk")]
    in_order = lambda x, y: F.when((x[date] < y[date]) | y[date].isNull(), -1).when((x[date] > y[date]) | x[date].isNull(), 1).otherwise(0)
    dealt = df if "__chunk" in df.columns else with_chunks(df, date, rows)
    chunks = dealt.withColumn("__first", first.cast(how.state)).groupBy(*keys, "__chunk").agg(F.array_sort(F.collect_list(F.struct(date, *payload)), in_order).alias("__rows"), F.first("__first").alias("__first"))
    add = lambda m, row: how.add(m, row).cast(how.summary)
    summaries = chunks.select(*keys, "__chunk", "__first", F.aggregate("__rows", how.none().cast(how.summary), add).alias("__m"))
    by_key = summaries.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__chunk", "__m"))).alias("__runs"), F.first("__first").alias("__first"))
    states = _before(F.col("__runs"), F.col("__first"), lambda now, run: how.carry(now, run["__m"]), how.state)
    starts = by_key.select(*keys, F.explode(F.arrays_zip(F.transform("__runs", lambda r: r["__chunk"]).alias("__chunk"), states.alias("__start"))).alias("__z")).select(*keys, "__z.*")
    walked = chunks.join(starts, [*keys, "__chunk"]).select(*keys, "__chunk", F.explode(F.arrays_zip("__rows", _before(F.col("__rows"), F.col("__start"), how.next, how.state).alias("__before"))).alias("__z"))
    row = F.col("__z")["__rows"]
    return walked.select(*[F.col(c) if c in (*keys, "__chunk") else row[c].alias(c) for c in df.columns], F.col("__z")["__before"].alias(before))
