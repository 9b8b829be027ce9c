"""Panels derived from the order and event tables, as SQL that any engine runs on the same tables.

Each text takes table names in braces, {change} or {last_change} for the return and {amount} for a value of four decimals. `{date}` columns are dates for daily panels and timestamps for hourly ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_BEFORE = "lag(level) OVER (PARTITION BY asset_id ORDER BY date)"
_CHANGE = f"level / {_BEFORE} - 1"
#: The same in Spark, whose division by zero is an error: infinite over a level of 0, NaN for 0 / 0.
_SPARK_CHANGE = f"CASE WHEN {_BEFORE} = 0 THEN level * double('infinity') ELSE try_divide(level, {_BEFORE}) END - 1"
#: With levels of no date last, as other engines have them.
_SPARK_LAST_CHANGE = _SPARK_CHANGE.replace("ORDER BY date", "ORDER BY date NULLS LAST")
_RETURN, _LAST_RETURN = "{change} AS ret", "{last_change} AS ret"
_AMOUNT = "CAST(value AS DECIMAL(18,4))"
#: The product is rounded, not the decimal text of the double.
_SPARK_AMOUNT = "CAST(CAST(round(value * 10000) AS DECIMAL(18,0)) * 0.0001BD AS DECIMAL(18,4))"

#: Average unit price per supplier nation and shipping day; many gaps.
NATION_DAY = f"""SELECT asset_id, date, level, {_RETURN} FROM (
  SELECT CAST(s_nationkey AS BIGINT) AS asset_id, CAST(l_shipdate AS DATE) AS date,
    CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS level
  FROM {{lineitem}} JOIN {{supplier}} ON l_suppkey = s_suppkey GROUP BY 1, 2) AS levels"""

#: Average order price per market segment and day.
SEGMENT_DAY = f"""SELECT asset_id, date, level, {_RETURN} FROM (
  SELECT c_mktsegment AS asset_id, CAST(o_orderdate AS DATE) AS date, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS level
  FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey GROUP BY 1, 2) AS levels"""

#: Average value per event type and hour; dense.
EVENT_HOUR = f"""SELECT asset_id, date, level, {_RETURN} FROM (
  SELECT event_type AS asset_id, date_trunc('hour', ts) AS date, CAST(sum({{amount}}) AS DOUBLE) / count(*) AS level
  FROM {{events}} GROUP BY 1, 2) AS levels"""

#: Value per user and day, with the first event type of the day; a wide cross-section.
USER_DAY = f"""SELECT asset_id, date, level, kind, {_LAST_RETURN} FROM (
  SELECT asset_id, date, max(level) AS level, max(CASE WHEN r = 1 THEN event_type END) AS kind FROM (
    SELECT user_id AS asset_id, CAST(ts AS DATE) AS date, event_type, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS r,
      CAST(sum({{amount}}) OVER (PARTITION BY user_id, CAST(ts AS DATE)) AS DOUBLE) AS level FROM {{events}}) AS numbered
  GROUP BY 1, 2) AS levels"""

PANELS = {"nation_day": NATION_DAY, "segment_day": SEGMENT_DAY, "event_hour": EVENT_HOUR, "user_day": USER_DAY}


def _rolling(panel: str) -> str:
    """Predictions for metrics: mean and sample deviation of the 20 returns before."""
    w = "OVER (PARTITION BY asset_id ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"
    return f"""SELECT asset_id, date AS forecast_start_date, date AS forecast_end_date, avg(ret) {w} AS mu, stddev_samp(ret) {w} AS sigma
  FROM ({panel}) AS panel WHERE ret IS NOT NULL"""


PREDICTIONS = {name: _rolling(sql) for name, sql in PANELS.items()}


def on_tables(sql: str) -> str:
    """The text over tables of their own names."""
    return sql.format(change=_CHANGE, last_change=_CHANGE, amount=_AMOUNT, lineitem="lineitem", supplier="supplier", orders="orders", customer="customer", events="events", nation="nation", region="region")


def _frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    names = [n for n in ("lineitem", "supplier", "orders", "customer", "events", "nation", "region") if "{" + n + "}" in sql]
    return spark.sql(sql.replace("{change}", _SPARK_CHANGE).replace("{last_change}", _SPARK_LAST_CHANGE).replace("{amount}", _SPARK_AMOUNT), **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})


def panel(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return _frame(spark, sf_dir, PANELS[name])


def predictions(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return _frame(spark, sf_dir, PREDICTIONS[name])
