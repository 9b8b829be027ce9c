"""Queries on returns over a level of 0: infinite, and NaN for 0 / 0, as in their SQL."""

from __future__ import annotations

import datetime as dt
import math

import pytest

import __spark_entry__ as driver

DAYS = {1: [1.0, 2.0, 3.0, 2.5], 2: [1.0, 0.0, 5.0, 4.0], 3: [0.0, 0.0, 2.0, 3.0], 4: [0.0, None, -2.0, 1.0], 5: [0.0, 0.0]}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("zero")
    rows = [(10 * user + day, dt.datetime(2024, 1, 1 + day, 10), user, "view" if day else "click", value, "{}") for user, values in DAYS.items() for day, value in enumerate(values) if value is not None]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(str(folder / "events.parquet"))
    return folder


def plain(rows):
    return sorted((tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r) for r in rows), key=lambda r: r[:2])


def same_as_sql(spark, folder, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    want = con.sql(driver.oracle_sql()[name])
    got = driver.queries()[name](spark, str(folder)).select(*want.columns).collect()
    assert [pytest.approx(r, abs=2e-6) for r in plain(want.fetchall())] == plain(map(tuple, got))


def test_bundle_transform(spark, tables):
    same_as_sql(spark, tables, "bundle_transform")


def test_ewma_vol_gaps(spark, tables):
    same_as_sql(spark, tables, "ewma_vol_gaps")


def test_stored_state(spark, tables):
    same_as_sql(spark, tables, "stored_state")
