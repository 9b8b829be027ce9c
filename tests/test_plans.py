"""Every registered panel query builds a plan without row-at-a-time Python, cross joins of tables, or unread columns."""

from __future__ import annotations

import re

import pytest

from panelcast.jobs import forecast_queries, panel_queries, stored_queries

FOLDER = "/root/testdata/sf0.001"
#: The smallest tables have too few events an hour for positive definite covariances, and backtests are solved at once.
LARGER = "/root/testdata/sf0.01"
QUERIES = {**panel_queries.QUERIES, **forecast_queries.QUERIES, **stored_queries.QUERIES}
#: Helpers over Arrow batches: user functions and models. Likelihood fits and per-date solves are written before the plan.
IN_PYTHON = {"cv_grid", "score_windows_linear", "score_windows_ensemble"}
#: Their results are products: dates x ids, and trials from lists of choices.
PRODUCTS = {"align_pad", "cv_grid"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan(spark, name):
    plan = QUERIES[name](spark, LARGER if name.startswith("backtest") else FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and ("CartesianProduct" not in plan or name in PRODUCTS)
    assert (name in IN_PYTHON) == bool(re.search("InPandas|InArrow|FlatMapCoGroups|PythonUDF", plan))
    for schema in re.findall(r"FileScan parquet.*?ReadSchema: struct<([^>]*)>", plan, re.S):
        assert "l_returnflag" not in schema and "props" not in schema and "c_name" not in schema


def test_folds_and_filters_reach_the_scan(spark):
    plan = panel_queries.QUERIES["repeated_keys"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int>" in plan


def test_scaled_panel_shuffles_once_by_asset(spark):
    """Fitting and applying the scaler reuse what the panel's window dealt by asset."""
    plan = panel_queries.QUERIES["scaled_panel"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") <= 2
