from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelcast.operators import ensemble, preprocess, splits, windows
from panelcast.operators.contracts import ContractError, Roles, failing
from panelcast.sources import io

D = dt.date


def panel(spark, values, start=D(2024, 1, 1)):
    """{asset: [values by day]}"""
    return spark.createDataFrame([(a, start + dt.timedelta(i), v) for a, vs in values.items() for i, v in enumerate(vs)], "asset_id string, date date, ret double")


def test_scaler(spark):
    p = panel(spark, {"a": [1.0, None, 3.0], "b": [2.0, 2.0, 2.0], "c": [None, None, None]})
    state = preprocess.fit_scaler(p, ["ret"])
    got = {r["asset_id"]: (r["mean"], r["variance"], r["scale"]) for r in state.collect()}
    assert got == {"a": (2.0, 1.0, 1.0), "b": (2.0, 0.0, 1.0), "c": (None, None, None)}
    two = panel(spark, {"a": [5.0], "b": [3.0]})
    scaled = preprocess.scale(two, state, ["ret"])
    assert {r["asset_id"]: r["ret"] for r in scaled.collect()} == {"a": 3.0, "b": 1.0}
    assert sorted(preprocess.unscale(scaled, state, ["ret"]).collect()) == sorted(two.collect())
    with pytest.raises(ContractError, match="no scaler"), failing():
        preprocess.scale(panel(spark, {"z": [1.0]}), state, ["ret"]).collect()
    with pytest.raises(ContractError):
        preprocess.fit_scaler(p, [])
    preds = spark.createDataFrame([("a", 1.0, 2.0)], "asset_id string, mu double, sigma double")
    assert preprocess.unscale_gaussian(preds, state, "ret").collect()[0][1:] == (3.0, 2.0)
    assert preprocess.unscale_gaussian(preds, state, "other").collect() == preds.collect()


def test_tokens(spark):
    df = spark.createDataFrame([(9, True, 0.5, "x"), (10, False, 2.0, None), (None, None, None, "y")], "i int, b boolean, f double, s string")
    columns = ["i", "b", "f", "s"]
    v = preprocess.fit_vocabulary(df, columns)
    keys = {(r["column"], r["token_key"]): r["token_id"] for r in v.collect()}
    assert keys == {("i", "int::10"): 2, ("i", "int::9"): 3, ("b", "bool::False"): 2, ("b", "bool::True"): 3, ("f", "float::0.5"): 2, ("f", "float::2.0"): 3, ("s", "str::x"): 2, ("s", "str::y"): 3}
    new = spark.createDataFrame([(9, None, 7.0, "z"), (11, True, 2.0, "y")], df.schema)
    coded = preprocess.encode(new, v, columns)
    assert sorted(map(tuple, coded.collect())) == [(1, 3, 3, 3), (3, 0, 1, 1)]
    back = preprocess.decode(coded, v, columns)
    assert set(map(tuple, back.collect())) == {("9", None, "[UNK]", "[UNK]"), ("[UNK]", "True", "2.0", "y")}
    assert {r["column"]: r["size"] for r in preprocess.vocabulary_sizes(v, columns).collect()} == dict.fromkeys(columns, 4)


def test_state_round_trip(spark, tmp_path):
    p = panel(spark, {"a": [1.0, 3.0]})
    state, v = preprocess.fit_scaler(p, ["ret"]), preprocess.fit_vocabulary(p, ["asset_id"])
    io.write_state(state, v, str(tmp_path / "s"))
    a, b = io.read_state(spark, str(tmp_path / "s"))
    assert a.collect() == state.collect() and b.collect() == v.collect()


def test_train_then_val(spark):
    both = preprocess.train_then_val(panel(spark, {"a": [1.0, 2.0]}), panel(spark, {"a": [9.0, 9.0, 9.0]}))
    assert [r["ret"] for r in both.orderBy("date").collect()] == [1.0, 2.0, 9.0]


ROLES = Roles(("ret",), ("ret",))


@pytest.mark.parametrize("chunk", [None, 3])
@pytest.mark.parametrize(("in_steps", "horizon", "out_steps"), [(2, 1, 1), (3, 2, 2)])
def test_tail_windows(spark, chunk, in_steps, horizon, out_steps):
    values = [0.0, 1.0, None, 3.0, 4.0, 5.0, 6.0, 7.0]
    w = windows.make_windows(panel(spark, {"a": values, "b": values[:3]}), ROLES, in_steps, horizon, out_steps, chunk=chunk)
    got = w.where("asset_id = 'a'").orderBy("forecast_start_date").collect()
    n = len(values) - (in_steps + horizon + out_steps - 1) + 1
    assert len(got) == n
    for s, r in enumerate(got):
        t = s + in_steps + horizon - 1
        assert r["x_ret"] == values[s : s + in_steps] and r["y"] == values[t : t + out_steps]
        assert r["x_ret_mask"] == [v is not None for v in r["x_ret"]] and r["y_mask"] == [v is not None for v in r["y"]]
        assert r["forecast_start_date"] == D(2024, 1, 1) + dt.timedelta(t) and r["forecast_end_date"] == D(2024, 1, 1) + dt.timedelta(t + out_steps - 1)


@pytest.mark.parametrize("chunk", [None, 2])
def test_next_step_windows(spark, chunk):
    values = [float(i) for i in range(6)]
    got = windows.make_windows(panel(spark, {"a": values}), ROLES, 3, mode="next_step", chunk=chunk).orderBy("forecast_start_date").collect()
    assert [(r["x_ret"], r["y"]) for r in got] == [(values[s : s + 3], values[s + 1 : s + 4]) for s in range(3)]
    assert all(r["forecast_start_date"] == r["forecast_end_date"] == D(2024, 1, 4) + dt.timedelta(s) for s, r in enumerate(got))
    with pytest.raises(ContractError):
        windows.make_windows(panel(spark, {"a": values}), ROLES, 0)


def test_alignment(spark):
    p = panel(spark, {"a": [0.0, 1.0, 2.0, None], "b": [5.0, 6.0, 7.0]})
    w = windows.make_windows(p, ROLES, 1)
    assert {(r["asset_id"], r["forecast_start_date"].day) for r in windows.align_truncate(w).collect()} == {(a, d) for a in "ab" for d in (2, 3)}
    padded = {(r["asset_id"], r["forecast_start_date"].day): r for r in windows.align_pad(w, -9.0).collect()}
    assert len(padded) == 6 and padded["b", 4]["x_ret"] == [-9.0] and padded["b", 4]["x_ret_mask"] == [False] and padded["b", 4]["forecast_end_date"] == D(2024, 1, 4)
    assert {r["forecast_start_date"].day for r in windows.drop_incomplete(w).collect()} == {2, 3}
    assert {tuple(r["x_ret"]) for r in windows.zero_fill(windows.align_pad(w)).where("asset_id = 'b'").collect()} == {(5.0,), (6.0,), (0.0,)}
    state = preprocess.fit_scaler(p, ["ret"])
    scaled = windows.scale_windows(w, state, target="ret").where("asset_id = 'b'").orderBy("forecast_start_date").collect()
    assert scaled[0]["x_ret"][0] == pytest.approx(-1.5**0.5) and scaled[0]["y"][0] == pytest.approx(0.0)


def test_no_look_ahead(spark):
    values = [float(i) for i in range(9)]
    changed = values[:6] + [99.0] * 3
    one, two = (windows.make_windows(panel(spark, {"a": v}), ROLES, 3).where("forecast_start_date <= DATE '2024-01-06'").collect() for v in (values, changed))
    assert sorted(one) == sorted(two)


def test_splits(spark):
    dates = splits.date_index(panel(spark, {"a": [1.0] * 10, "b": [None] * 4}))
    assert sorted(r["date_idx"] for r in dates.collect()) == list(range(10))
    count = lambda f: {(r["fold"], r["split"]): r["count"] for r in f.groupBy("fold", "split").count().collect()}
    assert count(splits.holdout(dates, 0.25)) == {(0, "train"): 8, (0, "val"): 2}
    assert count(splits.expanding(dates, 2)) == {(0, "train"): 3, (0, "val"): 3, (1, "train"): 6, (1, "val"): 3}
    assert count(splits.walk_forward(dates, 2, 2)) == {(0, "train"): 2, (0, "val"): 3, (1, "train"): 2, (1, "val"): 3}
    for bad in (lambda: splits.holdout(dates, 1.0), lambda: splits.expanding(dates, 10), lambda: splits.walk_forward(dates, 10), lambda: splits.date_index(panel(spark, {}))):
        with pytest.raises(ContractError):
            bad()
    with pytest.raises(ContractError):
        splits.slice_dates(panel(spark, {"a": [1.0]}), dates.where("date_idx > 5"))


def test_bootstrap(spark):
    dates = splits.date_index(panel(spark, {"a": [1.0] * 25}))
    bags = splits.bootstrap_dates(dates, 5, 0.5, seed=1)
    rows = {(r["estimator"], r["date"]): r["bag"] for r in bags.collect()}
    assert len(rows) == 125 and rows == {(r["estimator"], r["date"]): r["bag"] for r in splits.bootstrap_dates(dates, 5, 0.5, seed=1).collect()}
    assert all(1 <= sum(b == "in" for (e, _), b in rows.items() if e == k) <= 12 for k in range(5))  # 12.5 rounds to 12
    oob = splits.out_of_bag(dates, bags.where("bag = 'in'"), 5)
    assert {(r["estimator"], r["date"]) for r in oob.collect()} == {k for k, b in rows.items() if b == "oob"}
    assert splits.no_bootstrap(dates, 2).where("bag = 'in'").count() == 50
    assets = splits.asset_subspace(panel(spark, {a: [1.0] for a in "abcde"}), 4, 0.5, seed=2)
    assert {r["count"] for r in assets.groupBy("estimator").count().collect()} == {2}  # 2.5 rounds to 2
    with pytest.raises(ContractError):
        splits.bootstrap_dates(dates, 2, 0.0)


def test_bag_scaler_uses_its_bag_only(spark):
    p = panel(spark, {"a": [1.0, 3.0, 100.0]})
    bags = spark.createDataFrame([(0, D(2024, 1, 1), "in"), (0, D(2024, 1, 2), "in"), (0, D(2024, 1, 3), "oob"), (1, D(2024, 1, 3), "in")], "estimator int, date date, bag string")
    got = {r["estimator"]: r["mean"] for r in ensemble.bag_scalers(p, bags, ["ret"]).collect()}
    assert got == {0: 2.0, 1: 100.0}
    with pytest.raises(ContractError):
        ensemble.bag_scalers(p, bags.where(F.col("bag") == "none"), ["ret"])
