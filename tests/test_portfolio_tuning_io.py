from __future__ import annotations

import datetime as dt
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.operators import portfolio, tuning, windows
from panelcast.operators.contracts import ContractError, Roles, failing
from panelcast.sources import io

D = dt.date
START = D(2024, 1, 1)


def day(i):
    return START + dt.timedelta(i)


def panel(spark, x):
    return spark.createDataFrame([(f"a{k}", day(t), None if v != v else float(v)) for t, row in enumerate(x) for k, v in enumerate(row)], "asset_id string, date date, ret double")


def forecasts(spark, rows):
    return spark.createDataFrame([(f"a{k}", day(t), mu, s) for t, k, mu, s in rows], "asset_id string, forecast_start_date date, mu double, sigma double")


def reference_weights(alpha, cov, risk):
    inv, one = np.linalg.inv(cov), np.ones(len(alpha))
    nu = (one @ inv @ alpha - risk) / (one @ inv @ one)
    return inv @ (alpha - nu * one) / risk


def test_backtest_closed_form(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(30, 3)) * 0.01
    f = [(t, k, float(rng.normal()), 0.5 + k) for t in range(3, 30) for k in range(3)]
    how = portfolio.Backtest(window=10, ridge=1e-3, risk_aversion=4.0, chunk=7)
    weights, returns, status = portfolio.backtest(forecasts(spark, f), panel(spark, x), how)
    got = {(r["date"], r["asset_id"]): r["weight"] for r in weights.collect()}
    assert {r["status"]: r["n_dates"] for r in status.collect()} == {"ok": 20, "burn_in": 7}
    ret = {r["date"]: r for r in returns.collect()}
    for t in range(10, 30):
        rows = sorted(r for r in f if r[0] == t)
        raw = np.array([r[2] / r[3] for r in rows])
        w = reference_weights((raw - raw.mean()) / raw.std(), np.cov(x[t - 10 : t].T) + 1e-3 * np.eye(3), 4.0)
        assert np.allclose([got[day(t), f"a{k}"] for k in range(3)], w) and sum(w) == pytest.approx(1)
        assert ret[day(t)]["portfolio_return"] == pytest.approx(w @ x[t]) and ret[day(t)]["hhi"] == pytest.approx(w @ w) and ret[day(t)]["leverage"] == pytest.approx(abs(w).sum())
    # No look-ahead, and chunks don't matter.
    y = x.copy()
    y[20:] = 7.0
    other, _, _ = portfolio.backtest(forecasts(spark, [r for r in f if r[0] <= 20]), panel(spark, y), portfolio.Backtest(window=10, ridge=1e-3, risk_aversion=4.0, chunk=50))
    for r in other.collect():
        assert r["weight"] == pytest.approx(got[r["date"], r["asset_id"]])


def test_backtest_checks(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(12, 3))
    x[9] = np.nan
    f = [(t, k, 1.0 + k, 1.0) for t in (2, 6, 7, 8, 9) for k in range(3)]
    f = [(t, k, None if (t, k) == (7, 0) else mu, s) for t, k, mu, s in f if (t, k) not in ((8, 0), (8, 1))]
    _, _, status = portfolio.backtest(forecasts(spark, f), panel(spark, x), portfolio.Backtest(window=5, drop_date=True))
    assert {r["status"]: r["n_dates"] for r in status.collect()} == {"burn_in": 1, "ok": 1, "missing": 1, "universe": 2}
    for bad in ([(40, 0, 1.0, 1.0)], [(6, 9, 1.0, 1.0)]):
        with pytest.raises(ContractError):
            portfolio.backtest(forecasts(spark, bad), panel(spark, x), portfolio.Backtest(window=5))
    with pytest.raises(ContractError):
        portfolio.Backtest(window=1)


def test_covariance_with_gaps():
    import pandas as pd

    rng = np.random.default_rng(3)
    x = rng.normal(size=(20, 4))
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 3] = np.nan
    x[4, 3] = 1.0
    keep, cov = portfolio.covariance(x, 0.0, False)
    assert keep.tolist() == [0, 1, 2] and np.allclose(cov, pd.DataFrame(x[:, :3]).cov().to_numpy())
    keep, ridged = portfolio.covariance(x, 0.5, True)
    assert np.allclose(ridged - cov, 0.5 * np.diag(cov).mean() * np.eye(3))


def test_long_only():
    rng = np.random.default_rng(5)
    for _ in range(20):
        a, m = rng.normal(size=5), rng.normal(size=(9, 5))
        cov = m.T @ m / 9 + 0.1 * np.eye(5)
        w = portfolio.mean_variance(a, cov, 3.0, shorting=False)
        assert w.min() >= 0 and w.sum() == pytest.approx(1)
        value = lambda v: a @ v - 1.5 * v @ cov @ v
        for i in range(5):
            for j in range(5):
                step = min(1e-3, w[i])
                v = w.copy()
                v[i] -= step
                v[j] += step
                assert value(v) <= value(w) + 2e-2
    assert np.allclose(portfolio.mean_variance(np.array([1.0, 2]), np.eye(2), 2.0, fully_invested=False), [0.5, 1.0])


def test_metrics_and_turnover(spark):
    w = spark.createDataFrame([("a", day(0), 1.0, 0.1), ("a", day(1), 0.5, -0.2), ("b", day(1), 0.5, 0.1), ("b", day(2), 1.0, None), ("c", day(3), 1.0, 0.3)], "asset_id string, date date, weight double, realized_return double")
    r = portfolio.portfolio_returns(w)
    assert {x["date"]: x["portfolio_return"] for x in r.collect()} == {day(0): 0.1, day(1): pytest.approx(-0.05), day(3): 0.3}
    assert {x["k"]: x["turnover"] for x in portfolio.turnover(w).collect()} == {1: 1.0, 2: 1.0, 3: 2.0}
    m = portfolio.portfolio_metrics(r, w).first()
    y = np.array([0.1, -0.05, 0.3])
    assert m["annual_return"] == pytest.approx(np.prod(1 + y) ** 84 - 1) and m["sharpe"] == pytest.approx(y.mean() / y.std() * math.sqrt(252)) and m["max_drawdown"] == pytest.approx(-0.05) and m["mean_turnover"] == pytest.approx(4 / 3)
    empty = portfolio.portfolio_metrics(r.limit(0)).first()
    assert empty["n_days"] == 0 and empty["annual_return"] is None and empty["sharpe"] is None
    one = portfolio.portfolio_metrics(r.limit(1), w.where("date = DATE '2024-01-01'")).first()
    assert one["sharpe"] is None and one["mean_turnover"] is None


def test_benchmarks(spark):
    p = panel(spark, [[0.1, 0.2], [0.1, float("nan")], [0.3, 0.1]])
    r = spark.createDataFrame([(day(0), 0.5), (day(1), 0.5), (day(2), 0.5)], "date date, portfolio_return double")
    got = portfolio.versus_benchmarks(r, p, ["a0", "a1"])
    assert {(x["series"], x["date"]) for x in got.collect()} == {(s, day(i)) for s in ("portfolio", "a0", "a1") for i in (0, 2)}
    for bad in (["zz"],):
        with pytest.raises(ContractError, match="zz"), failing():
            portfolio.versus_benchmarks(r, p, bad).collect()
    with pytest.raises(ContractError, match="common"), failing():
        portfolio.versus_benchmarks(r.where("date > DATE '2025-01-01'"), p, ["a0"]).collect()


def test_dedupe(spark):
    p = spark.createDataFrame([("a", START, None, 1.0, 0), ("a", START, 2.0, 9.0, 1), ("a", START, 3.0, None, 2)], "asset_id string, forecast_start_date date, mu double, sigma double, k int")
    assert portfolio.dedupe_predictions(p, "k").collect()[0][2:] == (2.0, 1.0)


def test_rolling_cov(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(8, 2))
    got = {(r["date"], r["asset_i"], r["asset_j"]): r["cov"] for r in portfolio.rolling_cov(panel(spark, x), 5).collect()}
    assert len(got) == 4 * 3
    for t in range(4, 8):
        c = np.cov(x[t - 4 : t + 1].T)
        assert got[day(t), "a0", "a1"] == pytest.approx(c[0, 1]) and got[day(t), "a1", "a1"] == pytest.approx(c[1, 1])


def test_trials(spark):
    space = {"p": [1, 2, 3], "q": ["x", "y"]}
    g = [tuple(r) for r in tuning.grid(spark, space).orderBy("trial_number").collect()]
    assert g == [(i, p, q) for i, (p, q) in enumerate((p, q) for p in space["p"] for q in space["q"])]
    r = tuning.random_trials(spark, space, 50, 1)
    rows = r.collect()
    assert len(rows) == 50 and {x["p"] for x in rows} == {1, 2, 3} and rows == tuning.random_trials(spark, space, 50, 1).collect()
    for bad in (lambda: tuning.grid(spark, {"p": []}), lambda: tuning.random_trials(spark, space, 0)):
        with pytest.raises(ContractError):
            bad()


def test_cross_validate(spark):
    p = panel(spark, [[float(t)] for t in range(4)])
    folds = spark.createDataFrame([(0, day(0), "train"), (0, day(1), "val"), (1, day(0), "train"), (1, day(1), "train"), (1, day(2), "val")], "fold int, date date, split string")
    trials = tuning.grid(spark, {"add": [0, 10]})
    losses = tuning.cross_validate(p, folds, trials, lambda train, val, params: val["ret"].mean() - train["ret"].mean() + params["add"])
    assert {(r["trial_number"], r["fold"]): r["loss"] for r in losses.collect()} == {(0, 0): 1.0, (0, 1): 1.5, (1, 0): 11.0, (1, 1): 11.5}
    values = tuning.trial_values(losses, trials)
    assert {r["add"]: (r["state"], r["value"]) for r in values.collect()} == {0: ("COMPLETE", 1.25), 10: ("COMPLETE", 11.25)}


def test_scoring(spark):
    w = windows.make_windows(panel(spark, [[1.0, 2.0], [3.0, float("nan")], [5.0, 6.0]]), Roles(("ret",), ("ret",)), 2)
    sizes = []

    def model(x):
        sizes.append(len(x))
        return np.column_stack([x.sum(axis=(1, 2)), np.zeros(len(x))]), np.ones((len(x), 2)) * len(x)

    got = {r["asset_id"]: (r["mu"], r["sigma"]) for r in tuning.score_windows(w, ["ret"], model).collect()}
    assert got == {"a0": (4.0, 2.0), "a1": (2.0, 2.0)}  # the gap is 0, and both assets are in one call
    assert {r["mu"] for r in tuning.score_windows(w, ["ret"], model, "next_step").collect()} == {0.0}
    both = tuning.score_ensemble(w, ["ret"], {0: model, 1: lambda x: (np.zeros(len(x)), np.ones(len(x)))})
    assert {r["asset_id"]: r["mu"] for r in both.collect()} == {"a0": 2.0, "a1": 1.0}
    with pytest.raises(ContractError):
        tuning.score_windows(w, ["ret"], model, "other")


def test_io(spark, tmp_path):
    csv = tmp_path / "panel.csv"
    csv.write_text("date,asset_id,ret,x\n2024-01-02,b,NaN,1\n2024-01-01,b,0.5,2\n")
    p = io.read_panel(spark, str(csv), "date string, asset_id string, ret double, x int", ["ret"])
    assert [(r["ret"], r["x"]) for r in p.collect()] == [(0.5, 2), (None, 1)]
    with pytest.raises(ContractError, match=r"\['no', 'nor'\]"):
        io.read_panel(spark, str(csv), None, ["nor", "no"])
    assert io.read_prediction_panel(spark, str(csv), ["x", "ret", "x"]).columns == ["date", "asset_id", "x", "ret"]
    preds = spark.createDataFrame([(START, START, "a", 1.0, float("nan"))], "forecast_start_date date, forecast_end_date date, asset_id string, mu double, sigma double")
    path = str(tmp_path / "p.parquet")
    io.write_predictions(preds, path)
    assert [(r["mu"], r["sigma"]) for r in io.read_predictions(spark, path).collect()] == [(1.0, None)]
    with pytest.raises(Exception, match="already exists"):
        io.write_predictions(preds, path)
    with pytest.raises(ContractError):
        io.write_predictions(preds.limit(0), path, True)
    assert io.read_realized(spark, str(csv), "ret").columns == ["asset_id", "forecast_start_date", "target"]
    w = preds.withColumn("split", F.lit("train"))
    io.write_windows(w, str(tmp_path / "w"))
    assert spark.read.parquet(str(tmp_path / "w")).where("split = 'train'").count() == 1
    io.write_metrics(preds.withColumn("model", F.lit("m")), str(tmp_path / "m"))
    io.write_backtest(preds, preds, preds, str(tmp_path / "b"))
    io.write_trials(spark.createDataFrame([(0, "COMPLETE", 1.0)], "trial_number int, state string, value double"), str(tmp_path / "t"))
    (tmp_path / "e.json").write_text(json.dumps({"ensemble_type": "bag", "aggregation": "mean", "estimators": [{"index": 0, "estimator_manifest_path": "x", "oob_val_loss": 0.5}, {"index": 1, "estimator_manifest_path": "y", "oob_val_loss": None}]}, indent=1))
    assert [(r["index"], r["oob_val_loss"]) for r in io.read_manifest(spark, str(tmp_path / "e.json")).orderBy("index").collect()] == [(0, 0.5), (1, None)]


@pytest.mark.parametrize("block", [1, 2, 100])
def test_blocks_of_assets_give_the_windows_covariance(spark, block):
    """The backtest in asset blocks equals that with the covariance of whole windows as a plug-in, gaps included."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(60, 5)) * 0.01
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 4] = np.nan
    x[7, 4] = 0.01
    f = [(t, a, rng.normal(), 0.5 + rng.random()) for t in range(60) for a in range(5) if rng.random() < 0.9]
    how = portfolio.Backtest(window=16, ridge=0.5, ridge_relative=True, risk_aversion=3.0, burn_in=4, chunk=13, block_assets=block)
    told = lambda out: sorted(((r["date"], r["asset_id"], round(r["weight"], 8), r["realized_return"]) for r in out[0].collect()), key=str)
    want = told(portfolio.backtest(forecasts(spark, f), panel(spark, x), how, cov_fn=portfolio.covariance))
    have = portfolio.backtest(forecasts(spark, f), panel(spark, x), how)
    assert told(have) == want and len(want) > 60
    status = {r["status"]: r["n_dates"] for r in have[2].collect()}
    row = portfolio.summary(*have, how).collect()[0].asDict()
    assert row["n_rebalance_dates"] == len({r[0] for r in want if r[3] is not None}) and row["n_unique_assets"] == len({r[1] for r in want})
    assert row["skipped_burn_in_dates"] == status.get("burn_in", 0) and row["burn_in_days"] == 4 and row["missing_asset_policy"] == "drop_asset"
    assert row["start_date"] == min(r[0] for r in want if r[3] is not None) and row["end_date"] == max(r[0] for r in want if r[3] is not None)


def test_long_only_backtest(spark):
    """Two assets: without shorting the weight is the closed form's, cut at 0 and 1."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 2)) * 0.1
    f = [(t, a, rng.normal(), 1.0) for t in range(40) for a in range(2)]
    how = portfolio.Backtest(window=10, ridge=1e-3, risk_aversion=40.0, shorting=False)
    weights, _, _ = portfolio.backtest(forecasts(spark, f), panel(spark, x), how)
    got = {}
    for r in weights.orderBy("date", "asset_id").collect():
        got.setdefault(r["date"], []).append((r["weight"], r["alpha"]))
    assert len(got) == 30
    cut = 0
    for k, day in enumerate(sorted(got)):
        s = np.cov(x[k : k + 10].T) + 1e-3 * np.eye(2)
        (w1, a1), (w2, a2) = got[day]
        free = ((a1 - a2) / 40 + s[1, 1] - s[0, 1]) / (s[0, 0] + s[1, 1] - 2 * s[0, 1])
        assert w1 == pytest.approx(min(max(free, 0), 1), abs=1e-9) and w1 + w2 == pytest.approx(1)
        cut += not 0 < free < 1
    assert cut


def test_cross_validate_assets(spark, monkeypatch):
    """Errors of buckets of assets add up to those of whole folds, for more trials than one group takes."""
    rng = np.random.default_rng(6)
    p = panel(spark, rng.normal(size=(12, 5)))
    folds = spark.createDataFrame([(k, day(t), "train" if t < 4 * (k + 1) else "val") for k in range(2) for t in range(4 * (k + 2))], "fold int, date date, split string")
    trials = tuning.grid(spark, {"shrink": [0.0, 0.25, 0.5, 1.0], "add": [0.0, 1.0]})
    square = lambda train, val, params: (val["ret"] - val["asset_id"].map(train.groupby("asset_id")["ret"].mean()) * params["shrink"] - params["add"]) ** 2
    want = {(r["trial_number"], r["fold"]): r["loss"] for r in tuning.cross_validate(p, folds, trials, lambda *a: float(square(*a).mean()) ** 0.5).collect()}
    from pyspark.sql import functions as F

    for group, bucket in [(64, 64), (3, 2)]:
        monkeypatch.setattr(tuning, "TRIALS", group)
        got = tuning.cross_validate_assets(p, folds, trials, lambda *a: (float(square(*a).sum()), len(square(*a))), F.sqrt, bucket_ids=bucket)
        assert {(r["trial_number"], r["fold"]): r["loss"] for r in got.collect()} == pytest.approx(want) and len(want) == 16


def test_scoring_carries_dates_over_batches(spark):
    """Batches of a few rows: each call still has all assets of its date, in order, for every group."""
    x = [[float(10 * t + k) for k in range(7)] for t in range(9)]
    w = windows.make_windows(panel(spark, x), Roles(("ret",), ("ret",)), 2).join(spark.createDataFrame([(1,), (2,)], "side int"))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        rows = tuning.score_windows(w, ["ret"], lambda v: (v[:, -1, 0], np.full(len(v), v[:, -1, 0].sum() + len(v))), by=["side"]).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert len(rows) == 2 * 7 * 7
    for r in rows:
        last = x[(r["forecast_start_date"] - START).days - 1]
        assert r["mu"] == last[int(r["asset_id"][1:])] and r["sigma"] == sum(last) + 7
