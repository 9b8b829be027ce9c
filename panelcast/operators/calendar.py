"""Trading sessions, reindexing a panel to them, and returns."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .contracts import ContractError, varying_static

CALENDARS = ("XNYS", "NYSE", "XNAS", "NASDAQ")


def federal_holidays(first: int, last: int) -> list[dt.date]:
    """US federal holidays of these years by their rules; Saturdays are kept on Friday, Sundays on Monday."""

    def nth(year: int, month: int, weekday: int, n: int) -> dt.date:
        if n > 0:
            day = dt.date(year, month, 1)
            return day + dt.timedelta((weekday - day.weekday()) % 7 + 7 * (n - 1))
        day = dt.date(year, month + 1, 1) - dt.timedelta(1)
        return day - dt.timedelta((day.weekday() - weekday) % 7)

    out = set()
    for year in range(first - 1, last + 2):
        fixed = [(1, 1, 1870), (6, 19, 2021), (7, 4, 1870), (11, 11, 1938), (12, 25, 1870)]
        for month, day, since in fixed:
            if year >= since:
                kept = dt.date(year, month, day)
                out.add(kept + dt.timedelta({5: -1, 6: 1}.get(kept.weekday(), 0)))
        out |= {nth(year, 1, 0, 3), nth(year, 2, 0, 3), nth(year, 5, 0, -1), nth(year, 9, 0, 1), nth(year, 10, 0, 2), nth(year, 11, 3, 4)}
    return sorted(d for d in out if first <= d.year <= last)


def sessions(spark: SparkSession, start: dt.date, end: dt.date, holidays=None, calendar: str = "XNYS") -> DataFrame:
    """Weekdays from start to end (inclusive) that aren't holidays: session. Holidays follow the federal rule for the
    named calendar if they aren't given."""
    if start > end:
        raise ContractError("start is after end")
    if holidays is None:
        if calendar not in CALENDARS:
            raise ContractError(f"no rule for calendar {calendar}")
        holidays = federal_holidays(start.year, end.year)
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias("session"))
    closed = spark.createDataFrame([(d,) for d in holidays], "session date")
    return days.where(F.weekday("session") < 5).join(F.broadcast(closed), "session", "left_anti")


def sessions_of(panel: DataFrame, date: str = "date", holidays=None) -> DataFrame:
    """The sessions between a panel's first and last date."""
    ends = panel.agg(F.min(F.to_date(date)), F.max(F.to_date(date))).first()
    if ends[0] is None:
        raise ContractError("no dates")
    return sessions(panel.sparkSession, ends[0], ends[1], holidays)


def next_session(dates: DataFrame, calendar: DataFrame, date: str = "date") -> DataFrame:
    """The first session after each date. Both are date dimensions: a union in date order, and the next one back."""
    both = dates.select(F.to_date(date).alias("d"), F.lit(0).alias("is_session")).distinct().unionByName(calendar.select(F.col("session").alias("d"), F.lit(1).alias("is_session")))
    ahead = Window.partitionBy(F.lit(0)).orderBy("d").rangeBetween(1, Window.unboundedFollowing)
    days = both.withColumn("d", F.unix_date("d")).withColumn("next", F.min(F.when(F.col("is_session") == 1, F.col("d"))).over(ahead))
    return days.where("is_session = 0").select(F.date_from_unix_date("d").alias(date), F.date_from_unix_date("next").alias("next_session"))


def reindex(panel: DataFrame, calendar: DataFrame, static=(), id: str = "asset_id", date: str = "date") -> DataFrame:
    """Every id at every session: rows on other days go, missing ones become null; static columns are filled in."""
    if static and (bad := varying_static(panel, static, id, count_null=False).limit(1).collect()):
        raise ContractError(f"a static column varies: {bad[0].asDict()}")
    ids = panel.groupBy(id).agg(F.count("*").alias("__n"), *[F.max(c).alias(f"__{c}") for c in static]).drop("__n")
    days = F.broadcast(calendar.select(F.col("session").cast(panel.schema[date].dataType).alias(date)))
    grid = ids.join(days)  # ids x sessions is the result itself
    out = grid.join(panel.withColumn(date, F.date_trunc("day", date).cast(panel.schema[date].dataType)), [id, date], "left")
    return out.select(*[F.col(f"__{c}").alias(c) if c in static else F.col(c) for c in panel.columns])


def simple_returns(prices: DataFrame, price: str = "level", id: str = "asset_id", date: str = "date", drop_missing: bool = False) -> DataFrame:
    """ret = price / previous price - 1 along the rows as they are (a gap nulls both sides; x/0 is infinite, 0/0
    null). drop_missing removes each date on which any id's return is null."""
    before = F.lag(price).over(Window.partitionBy(id).orderBy(date))
    over_zero = F.when(F.col(price) > 0, float("inf")).when(F.col(price) < 0, float("-inf"))
    out = prices.withColumn("__before", before).withColumn("ret", F.when(F.col("__before") == 0, over_zero).otherwise(F.try_divide(price, "__before") - 1)).drop("__before")
    if drop_missing:
        whole = out.groupBy(date).agg(F.min(F.col("ret").isNotNull()).alias("whole")).where("whole").select(date)
        out = out.join(whole, date, "left_semi")
    return out


def check_tickers(tickers) -> list[str]:
    """Requested tickers: not empty, trimmed, upper case."""
    if bad := [t for t in tickers if not t or t != t.strip() or t != t.upper()]:
        raise ContractError(f"bad tickers: {bad}")
    return list(tickers)


def upper_columns(prices: DataFrame, date: str = "date") -> DataFrame:
    return prices.withColumnsRenamed({c: c.strip().upper() for c in prices.columns if c != date})


def wide_to_long(wide: DataFrame, date: str = "date", value: str = "ret") -> DataFrame:
    """(date, one column per asset) to (date, asset_id, value, ticker); null cells stay."""
    long = wide.unpivot(date, [c for c in wide.columns if c != date], "asset_id", value)
    return long.withColumn("ticker", F.col("asset_id"))


def long_to_wide(long: DataFrame, ids, value: str = "ret", id: str = "asset_id", date: str = "date") -> DataFrame:
    """One column per given id, the first value of a cell that isn't null."""
    return long.groupBy(date).pivot(id, list(ids)).agg(F.first(value, ignorenulls=True))
