"""Queries on events of no user: no rows, as in their SQL, but their kinds are in the vocabulary."""

from __future__ import annotations

import datetime as dt

import pytest
from test_zero_levels import same_as_sql


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("no-user")
    users = [(1, "view"), (1, "view"), (1, "click"), (2, "view"), (2, None), (None, "add"), (None, "view"), (None, "buy")]
    rows = [(k, dt.datetime(2024, 1, 1 + k, 10), user, kind, 1.0 + k * k % 5, "{}") for k, (user, kind) in enumerate(users)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(str(folder / "events.parquet"))
    return folder


@pytest.mark.parametrize("name", ["stored_state", "bundle_transform"])
def test_events_of_no_user(spark, tables, name):
    same_as_sql(spark, tables, name)
