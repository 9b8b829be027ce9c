"""Sliding windows over panel rows: one row per (id, forecast date), one array per feature.

Arrays are made by bounded window frames over (id ordered by date), so memory is bounded by the window's length. For
panels of few ids with long histories, `chunk` deals an id's rows into chunks of so many rows, each with the rows that
its windows need beyond its end; the chunks are then windowed in parallel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .contracts import ContractError, Roles


def _frames(df: DataFrame, roles: Roles, length: int, chunk: int | None, by=()) -> DataFrame:
    """Each row with __rows, the array of structs of the next `length` rows of its (by…, id), where there are so many."""
    columns = list(dict.fromkeys([roles.date, *roles.dynamic, *roles.categorical, *roles.static, *roles.targets]))
    rows = F.struct(*columns)  # structs keep nulls, which a list of scalars would drop
    if chunk is None:
        keys, data, home = [*by, roles.id], df.select(*by, roles.id, *columns), F.lit(True)
    else:
        numbered = df.select(*by, roles.id, *columns).withColumn("__n", F.row_number().over(Window.partitionBy(*by, roles.id).orderBy(roles.date)) - 1)
        own = F.floor(F.col("__n") / chunk)
        first = F.greatest(F.lit(0), F.floor((F.col("__n") - (length - 1)) / chunk))
        data = numbered.withColumn("__own", own).withColumn("__chunk", F.explode(F.sequence(first, own)))
        keys, home = [*by, roles.id, "__chunk"], F.col("__own") == F.col("__chunk")
    w = Window.partitionBy(*keys).orderBy(roles.date).rowsBetween(0, length - 1)
    return data.withColumn("__rows", F.collect_list(rows).over(w)).where(home & (F.size("__rows") == length))


def _arrays(df: DataFrame, framed: DataFrame, roles: Roles, x: tuple[int, int], y: tuple[int, int], by=()) -> DataFrame:
    """x and y: (first, number) in the frame. Float features have masks for null; other types are always observed."""

    def cut(c: str, part: tuple[int, int]):
        return F.slice(F.transform("__rows", lambda r: r[c]), part[0] + 1, part[1])

    def mask(c: str, part: tuple[int, int]):
        floating = isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType))
        return F.transform(cut(c, part), (lambda v: v.isNotNull()) if floating else (lambda v: F.lit(True)))

    last = y[0] + y[1] - 1
    start = F.col("__rows")[y[0] if y[1] < x[1] or y[0] >= x[1] else last][roles.date]
    out = [*map(F.col, by), F.col(roles.id), start.alias("forecast_start_date"), F.col("__rows")[last][roles.date].alias("forecast_end_date")]
    for c in roles.dynamic:
        out += [cut(c, x).alias(f"x_{c}"), mask(c, x).alias(f"x_{c}_mask")]
    out += [cut(c, x).alias(f"c_{c}") for c in roles.categorical]
    out += [F.col("__rows")[0][c].alias(f"s_{c}") for c in roles.static]
    for c in roles.targets:
        out += [cut(c, y).alias("y" if len(roles.targets) == 1 else f"y_{c}"), mask(c, y).alias("y_mask" if len(roles.targets) == 1 else f"y_{c}_mask")]
    return framed.select(*out)


def make_windows(df: DataFrame, roles: Roles, in_steps: int, horizon: int = 1, out_steps: int = 1, mode: str = "tail", chunk: int | None = None, by=()) -> DataFrame:
    """tail: inputs are rows [s, s + in), targets the out_steps rows from s + in + horizon - 1 on. next_step: inputs
    [s, s + in), targets [s + 1, s + 1 + in); dated by the last target. With `by`, no window leaves its group."""
    if min(in_steps, horizon, out_steps) < 1:
        raise ContractError("steps must be positive")
    if mode == "tail":
        length, y = in_steps + horizon + out_steps - 1, (in_steps + horizon - 1, out_steps)
    elif mode == "next_step":
        length, y = in_steps + 1, (1, in_steps)
    else:
        raise ContractError(f"no mode {mode}")
    return _arrays(df, _frames(df, roles, length, chunk, by), roles, (0, in_steps), y, by)


def align_truncate(windows: DataFrame, id: str = "asset_id", date: str = "forecast_start_date") -> DataFrame:
    """Forecast dates that every id with a window has. Only keys are shuffled; the dates are joined back."""
    n_ids = windows.agg(F.count_distinct(id).alias("n_ids"))
    dates = windows.select(id, date).groupBy(date).agg(F.count_distinct(id).alias("n")).join(n_ids, F.col("n") == F.col("n_ids")).select(date)
    return windows.join(dates, date, "left_semi")


def align_pad(windows: DataFrame, pad: float | None = None, id: str = "asset_id", date: str = "forecast_start_date") -> DataFrame:
    """All forecast dates x ids. Cells that are absent get arrays of the pad value with masks false; the end date is
    that of the first id that has it. A pad value that a type can't hold becomes null, -1 or false."""
    dates = windows.groupBy(date).agg(F.min_by("forecast_end_date", id).alias("__end"))
    ids = windows.select(id).distinct()
    grid = dates.join(ids)  # dates x ids is the result itself
    sizes = windows.agg(*[F.max(F.size(c)).alias(c) for c in windows.columns if isinstance(windows.schema[c].dataType, T.ArrayType)]).first()
    out = []
    for c in windows.columns:
        kind = windows.schema[c].dataType
        if c in (id, date):
            out.append(F.col(c))
        elif c == "forecast_end_date":
            out.append(F.coalesce(c, "__end").alias(c))
        elif isinstance(kind, T.ArrayType):
            element = kind.elementType
            if isinstance(element, T.BooleanType):
                value = F.lit(False)
            elif isinstance(element, T.IntegralType):
                value = F.lit(int(pad) if pad is not None and float(pad).is_integer() else -1)
            else:
                value = F.lit(pad)
            out.append(F.coalesce(c, F.array_repeat(value.cast(element), sizes[c] or 0)).alias(c))
        else:
            out.append(F.col(c))
    return grid.join(windows, [date, id], "left").select(*out)


def _complete(windows: DataFrame):
    whole = F.lit(True)
    for c in windows.columns:
        if c.endswith("_mask"):
            whole = whole & F.forall(c, lambda m: m)
    return whole


def drop_incomplete(windows: DataFrame, date: str = "forecast_start_date") -> DataFrame:
    """Forecast dates without any false mask in their cross-section."""
    good = windows.select(date, _complete(windows).alias("whole")).groupBy(date).agg(F.min("whole").alias("whole")).where("whole").select(date)
    return windows.join(good, date, "left_semi")


def zero_fill(windows: DataFrame) -> DataFrame:
    return windows.withColumns({c: F.transform(c, lambda v: F.coalesce(v, F.lit(0.0))) for c in windows.columns if c.startswith("x_") and not c.endswith("_mask")})


def scale_windows(windows: DataFrame, state: DataFrame, id: str = "asset_id", by=(), target: str | None = None) -> DataFrame:
    """Window arrays on the state's scale (keyed by by… and id); y only if the target is a scaled feature."""
    each = state.groupBy(*by, id).agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("mean", "scale")))).alias("__state"))
    features = {c[2:]: c for c in windows.columns if c.startswith("x_") and not c.endswith("_mask")}

    def scaled(column: str, feature: str):
        s = F.col("__state")[feature]
        return F.when(s.isNotNull(), F.transform(column, lambda v: (v - s["mean"]) / s["scale"])).otherwise(F.col(column))

    out = windows.join(each, [*by, id]).withColumns({c: scaled(c, f) for f, c in features.items()})
    if target is not None and "y" in windows.columns:
        out = out.withColumn("y", scaled("y", target))
    return out.select(*windows.columns)
