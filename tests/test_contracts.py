from __future__ import annotations

import datetime as dt
import math

import pytest

from panelcast.functions import gaussian
from panelcast.operators import calendar, contracts
from panelcast.operators.contracts import ContractError, Roles

D = dt.date


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_nan_becomes_null(spark):
    df = contracts.nan_to_null(rows(spark, [(1, float("nan")), (2, 1.0)], "id int, x double"))
    assert [r["x"] for r in df.orderBy("id").collect()] == [None, 1.0]


def test_canonicalize(spark):
    good = rows(spark, [("a", "2024-01-02", 1.0), ("a", "2024-01-01", 2.0)], "asset_id string, date string, ret double")
    assert [r["ret"] for r in contracts.canonicalize(good).collect()] == [2.0, 1.0]
    with pytest.raises(ContractError, match="repeated"):
        contracts.canonicalize(good.union(good.limit(1)))
    with pytest.raises(ContractError, match="missing"):
        contracts.canonicalize(good.drop("date"))
    with pytest.raises(Exception, match="cannot be parsed|CAST_INVALID|malformed"):
        contracts.canonicalize(rows(spark, [("a", "no date", 1.0)], "asset_id string, date string, ret double")).collect()


def test_static(spark):
    drift = rows(spark, [("a", "x"), ("a", "y")], "asset_id string, s string")
    gap = rows(spark, [("a", "x"), ("a", None)], "asset_id string, s string")
    for df in (drift, gap):
        with pytest.raises(ContractError):
            contracts.check_static(df, ["s"])
    assert contracts.varying_static(gap, ["s"], count_null=False).isEmpty()


def test_roles(spark):
    df = rows(spark, [("a", D(2024, 1, 1), 1.0, 2, "k", 3.0)], "asset_id string, date date, ret double, n int, kind string, x double")
    assert contracts.plan_dynamic(df, ["x"]) == ("x", "ret", "n")
    assert contracts.resolve(df, Roles(("ret",), (), ("kind",))).dynamic == ("ret", "n", "x")
    assert Roles(("ret", "ret"), ("x", "x")).dynamic == ("x",)
    for bad in (lambda: Roles(("ret",), categorical=("ret",)), lambda: Roles((" ret",)), lambda: contracts.resolve(df, Roles(("no",))), lambda: contracts.plan_dynamic(df.select("asset_id", "kind"), [])):
        with pytest.raises(ContractError):
            bad()


def test_holidays():
    days = calendar.federal_holidays(2021, 2022)
    assert D(2021, 7, 5) in days and D(2021, 12, 31) in days and D(2022, 6, 20) in days and D(2021, 11, 25) in days and D(2022, 5, 30) in days
    assert D(2021, 7, 4) not in days


def test_sessions_and_reindex(spark):
    with pytest.raises(ContractError):
        calendar.sessions(spark, D(2024, 1, 2), D(2024, 1, 1))
    found = [r["session"] for r in calendar.sessions(spark, D(2023, 12, 29), D(2024, 1, 3)).orderBy("session").collect()]
    assert found == [D(2023, 12, 29), D(2024, 1, 2), D(2024, 1, 3)]
    panel = rows(spark, [("a", D(2024, 1, 2), 10.0, "s"), ("a", D(2024, 1, 4), 0.0, "s"), ("a", D(2024, 1, 6), 5.0, "s"), ("a", D(2024, 1, 8), 8.0, "s"), ("b", D(2024, 1, 2), 1.0, None)], "asset_id string, date date, level double, kind string")
    grid = calendar.reindex(panel, calendar.sessions_of(panel), ["kind"])
    out = {(r["asset_id"], r["date"].day): (r["level"], r["kind"]) for r in grid.collect()}
    assert len(out) == 10 and out["a", 3] == (None, "s") and out["a", 4] == (0.0, "s") and ("a", 6) not in out and out["b", 8] == (None, None)
    ret = {(r["asset_id"], r["date"].day): r["ret"] for r in calendar.simple_returns(panel).collect()}
    assert ret["a", 2] is None and ret["a", 4] == -1.0 and ret["a", 6] == math.inf and ret["a", 8] == pytest.approx(0.6)
    assert calendar.simple_returns(grid, drop_missing=True).isEmpty()
    with pytest.raises(ContractError):
        calendar.reindex(panel.union(rows(spark, [("a", D(2024, 1, 9), 1.0, "t")], panel.schema)), calendar.sessions_of(panel), ["kind"])


def test_next_session(spark):
    dates = rows(spark, [(D(2024, 1, 5),), (D(2024, 1, 6),), (D(2024, 1, 9),)], "date date")
    out = {r["date"].day: r["next_session"] for r in calendar.next_session(dates, calendar.sessions(spark, D(2024, 1, 1), D(2024, 1, 9))).collect()}
    assert out == {5: D(2024, 1, 8), 6: D(2024, 1, 8), 9: None}


def test_tickers_and_shape(spark):
    assert calendar.check_tickers(["A", "B"]) == ["A", "B"]
    for bad in ("", " A", "a"):
        with pytest.raises(ContractError):
            calendar.check_tickers([bad])
    wide = rows(spark, [(D(2024, 1, 1), 1.0, None)], "date date, a double, b double")
    assert calendar.upper_columns(wide).columns == ["date", "A", "B"]
    long = calendar.wide_to_long(wide)
    assert {(r["asset_id"], r["ret"], r["ticker"]) for r in long.collect()} == {("a", 1.0, "a"), ("b", None, "b")}
    assert calendar.long_to_wide(long, ["a", "b"]).collect() == wide.collect()


def test_erf(spark):
    points = [i / 50 for i in range(-320, 321)] + [0.46875, 4.0, 26.9, 40.0]
    got = rows(spark, [(x,) for x in points], "x double").selectExpr("x", f"{gaussian.erf('x')} AS e").collect()
    assert max(abs(r["e"] - math.erf(r["x"])) for r in got) < 1e-15
    assert gaussian.half_width(0.6826894921370859) == pytest.approx(1.0)
    with pytest.raises(ValueError):
        gaussian.half_width(1.0)
