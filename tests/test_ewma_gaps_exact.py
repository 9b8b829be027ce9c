"""ewma_vol_gaps against its SQL to the last digit: halves, fine and wide values, 0 / 0, events of no user or no time."""

from __future__ import annotations

import datetime as dt
import random

import pytest

import __spark_entry__ as driver
from panelcast.jobs.common import rounded

RNG = random.Random(4)
#: (user, day or None, value)
CASES = {
    "halves": [(1, 0, 1.41), (1, 0, 11.27), (1, 0, 6.52), (1, 1, 1.04), (1, 1, 37.69), (2, 0, 6.77), (2, 0, 25.23), (2, 3, 15.53)],
    "fine": [(1, 0, 0.00015), (1, 0, 0.0004), (1, 1, 0.00025), (1, 2, 1.00005), (2, 0, -0.00005), (2, 2, 0.00035)],
    "wide": [(user, day, round(10 ** RNG.uniform(-2, 10), 2)) for user in range(12) for day in range(28) if RNG.random() < 0.4],
    "0 / 0": [(1, 0, 0.0), (1, 1, 0.0), (1, 2, 3.0), (2, 0, 1.0), (2, 1, 0.0), (2, 2, 5.0), (3, 2, 1.0)],
    "no user": [(None, 0, 1.0), (None, 1, 2.0), (1, 1, 3.0), (1, 2, 4.0)],
    "no time": [(1, None, 9.0), (1, 0, 1.0), (1, 1, 3.0), (2, 0, 2.0), (2, 1, 1.0), (3, None, 5.0), (None, None, 1.0)],
    "no time at all": [(1, None, 9.0), (None, None, 1.0)],
}


@pytest.mark.parametrize("case", CASES)
def test_exact(spark, tmp_path, case):
    duckdb = pytest.importorskip("duckdb")
    rows = [(k, None if day is None else dt.datetime(2024, 1, 1 + day, 10), user, "view", value, "{}") for k, (user, day, value) in enumerate(CASES[case])]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.sql(driver.oracle_sql()["ewma_vol_gaps"]).fetchall()
    got = driver.queries()["ewma_vol_gaps"](spark, str(tmp_path)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_rounding_is_that_of_the_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    halves = [(k + 0.5) / 1e6 * s for k in range(0, 40_000_000, 39_989) for s in (1.0, -1.0, 1 + 2**-52, 1 - 2**-53, 1e5, 1e8)]
    numbers = [*halves, 38.73 / 19.2 - 1, 0.0, -0.0, -1e-9, 1e300, 1.7e308, float("inf"), float("-inf")]
    df = spark.createDataFrame(list(enumerate(numbers)), "k long, x double")
    got = [r["x"] for r in sorted(rounded(df).collect())]
    want = duckdb.sql("SELECT [round(x, 6) + 0.0 FOR x IN $numbers]", params={"numbers": numbers}).fetchall()[0][0]
    assert list(map(repr, got)) == list(map(repr, want))
    assert [r["x"] for r in rounded(spark.createDataFrame([(float("nan"),), (None,)], "x double")).collect()] == [None, None]
