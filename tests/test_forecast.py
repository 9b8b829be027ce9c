from __future__ import annotations

import datetime as dt
import math
import random

import numpy as np
import pytest

from panelcast.operators import ensemble, evaluate, signal
from panelcast.operators.contracts import ContractError, failing
from panelcast.operators.forecast import AR1, UnconditionalMean, forecaster, run_forecaster
from panelcast.operators.garch import Garch11, fit_lanes, log_likelihood

D = dt.date
START = D(2024, 1, 1)


def panel(spark, values, start=START):
    return spark.createDataFrame([(a, start + dt.timedelta(i), v) for a, vs in values.items() for i, v in enumerate(vs)], "asset_id string, date date, ret double")


def by_asset(df):
    out = {}
    for r in df.orderBy("asset_id", "forecast_start_date").collect():
        out.setdefault(r["asset_id"], []).append((r["mu"], r["sigma"]))
    return out


def test_mean(spark):
    got = by_asset(run_forecaster(UnconditionalMean(), panel(spark, {"a": [1.0, None, 3.0]}), panel(spark, {"a": [0.0], "new": [0.0]})))
    assert got == {"a": [(2.0, None)], "new": [(None, None)]}


def test_ar1(spark):
    train = {"line": [1.0, None, 2.0, 4.0, 3.0, 5.0], "flat": [2.0, 2.0, 2.0, 5.0], "two": [1.0, 3.0], "none": [None]}
    params = {r["asset_id"]: r for r in AR1().fit(panel(spark, train)).collect()}
    x, y = np.array([1.0, 2, 4, 3]), np.array([2.0, 4, 3, 5])
    (const, phi), *_ = np.linalg.lstsq(np.column_stack([np.ones(4), x]), y, rcond=None)
    assert (params["line"]["const"], params["line"]["phi"]) == (pytest.approx(const), pytest.approx(phi))
    (const2, phi2), *_ = np.linalg.lstsq(np.column_stack([np.ones(3), [2.0, 2, 2]]), [2.0, 2, 5], rcond=None)
    assert (params["flat"]["const"], params["flat"]["phi"]) == (pytest.approx(const2), pytest.approx(phi2))
    assert (params["two"]["const"], params["two"]["phi"], params["two"]["last_value"]) == (2.0, 0.0, 3.0)
    assert (params["none"]["const"], params["none"]["phi"], params["none"]["last_value"]) == (0.0, 0.0, None)
    test = panel(spark, {"line": [None, 7.0, None, 1.0], "unseen": [1.0]}, D(2024, 3, 1))
    got = by_asset(run_forecaster(AR1(), panel(spark, train), test))
    assert list(got) == ["line"] and [m for m, _ in got["line"]] == pytest.approx([const + phi * v for v in (5.0, 5.0, 7.0, 7.0)])
    # No look-ahead: the last value doesn't matter.
    later = by_asset(run_forecaster(AR1(), panel(spark, train), panel(spark, {"line": [None, 7.0, None, 99.0]}, D(2024, 3, 1))))
    assert later["line"] == got["line"]


def simulated(n, seed):
    rng = np.random.default_rng(seed)
    omega, alpha, beta = 0.1, 0.12, 0.8
    v, out = omega / (1 - alpha - beta), []
    for _ in range(n):
        e = math.sqrt(v) * rng.normal()
        out.append(0.05 + e)
        v = omega + alpha * e * e + beta * v
    return np.array(out)


def test_garch_likelihood():
    y = simulated(1000, 1)
    (mu, omega, alpha, beta, last), other = fit_lanes([y, simulated(60, 2)])
    start = np.array([y.var()])
    value = lambda *p: float(log_likelihood(y[:, None], np.ones((len(y), 1), bool), *map(np.array, p), start)[0])
    best = value(mu, omega, alpha, beta)
    assert other is not None and best >= value(0.05, 0.1, 0.12, 0.8)
    for d in (-0.01, 0.01):
        assert best + 1e-4 >= max(value(mu + d, omega, alpha, beta), value(mu, omega + d, alpha, beta), value(mu, omega, alpha + d, beta), value(mu, omega, alpha, beta + d))
    assert abs(alpha - 0.12) < 0.08 and abs(beta - 0.8) < 0.15


def test_garch_roll(spark):
    y = simulated(200, 3) / 100
    train = panel(spark, {"a": y.tolist(), "short": y[:59].tolist(), "edge": y[:60].tolist()})
    model = Garch11()
    params = {r["asset_id"]: r for r in model.fit(train).collect()}
    assert sorted(params) == ["a", "edge"]
    new = [0.01, None, -0.02]
    got = by_asset(model.predict(panel(spark, {"a": new, "z": [1.0]}, D(2025, 1, 1)), model.fit(train)))
    p, want = params["a"], []
    v = p["variance"]
    for x in new:
        want.append((p["mu"] / 100, math.sqrt(v) / 100))
        if x is not None:
            v = p["omega"] + p["alpha"] * (100 * x - p["mu"]) ** 2 + p["beta"] * v
    assert list(got) == ["a"] and np.allclose(got["a"], want, rtol=1e-6)
    with pytest.raises(ContractError):
        forecaster("other")


def frame(spark, data):
    return spark.createDataFrame([("m", a, START + dt.timedelta(i), mu, s, t) for i, (a, mu, s, t) in enumerate(data)], "model string, asset_id string, forecast_start_date date, mu double, sigma double, target double")


def test_metrics(spark):
    data = [("a", 0.0, 1.0, 0.5), ("a", 1.0, 2.0, -2.0), ("b", 0.0, 1.0, None), ("b", 0.0, None, 1.0), ("b", 0.5, 0.0, 1.0)]
    got = {r["asset_id"]: r for r in evaluate.metrics(frame(spark, data)).collect()}
    phi = lambda z: math.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    crps = lambda z, s: s * (z * math.erf(z / math.sqrt(2)) + 2 * phi(z) - 1 / math.sqrt(math.pi))
    nll = lambda z, s: 0.5 * math.log(2 * math.pi * s * s) + z * z / 2
    all_, b = got[None], got["b"]
    assert all_["is_overall"] and not b["is_overall"] and all_["n_rows"] == 5
    assert all_["crps"] == pytest.approx((crps(0.5, 1) + crps(-1.5, 2)) / 2) and all_["mean_nll"] == pytest.approx((nll(0.5, 1) + nll(-1.5, 2)) / 2)
    assert b["coverage_1s"] == 0.0 and b["n_rows"] == 3  # a null target is outside, a null sigma unknown
    assert b["sigma_mean"] == 0.5 and b["mean_nll"] is None and b["rmse_mu"] == pytest.approx(math.sqrt((1 + 0.25) / 2))
    assert all_["coverage_1s"] == 0.25 and all_["coverage_2s"] == 0.5
    point = {r["asset_id"]: r for r in evaluate.metrics(frame(spark, [("a", 1.0, None, 2.0)])).collect()}["a"]
    assert point["rmse_mu"] == 1.0 and all(point[c] is None for c in ("mean_nll", "crps", "coverage_1s", "sigma_mean"))


def test_skill_and_join(spark):
    stacked = evaluate.stack_models({"ref": frame(spark, [("a", 1.0, 1.0, 0.0), ("b", 0.0, 1.0, 0.0)]).drop("model"), "new": frame(spark, [("a", 2.0, 1.0, 0.0), ("b", 2.0, 1.0, 0.0), ("c", 1.0, 1.0, 0.0)]).drop("model")})
    got = {(r["model"], r["asset_id"]): r["rmse_skill"] for r in evaluate.skill(evaluate.metrics(stacked), "ref").collect()}
    assert got["new", "a"] == 2.0 and got["new", "b"] is None and got["new", "c"] is None and got["new", None] == pytest.approx(math.sqrt(3) / math.sqrt(0.5)) and got["ref", "a"] == 1.0
    truth = evaluate.realized(panel(spark, {"x": [1.0]}))
    with pytest.raises(ContractError):
        evaluate.join_realized(stacked.drop("target"), truth, "ref")
    with pytest.raises(ContractError):
        evaluate.stack_models({})


def test_reliability_and_losses(spark):
    rows = frame(spark, [("a", 0.0, 1.0, z) for z in (0.1, 0.5, 1.2, 3.0)] + [("a", 0.0, 1.0, None), ("a", 0.0, 0.0, 1.0)])
    got = {r["nominal"]: r["empirical"] for r in evaluate.reliability(rows, (0.5, 0.9)).collect()}
    assert got == {0.5: 0.5, 0.9: 0.75}
    with pytest.raises(ValueError):
        evaluate.reliability(rows, (1.5,))
    masked = rows.selectExpr("*", "target is not null and sigma > 0 as mask")
    assert evaluate.masked_losses(masked).first()["mse"] == pytest.approx((0.01 + 0.25 + 1.44 + 9) / 4)
    with pytest.raises(ContractError):
        evaluate.masked_losses(masked.where("not mask"))


def test_volatility(spark):
    got = [r["vol"] for r in evaluate.realized_vol(panel(spark, {"a": [1.0, None, 2.0, 3.0]}), 3).orderBy("date").collect()]
    assert got[:2] == [None, None] and got[2:] == pytest.approx([math.sqrt(2.5), math.sqrt(6.5)])
    import pandas as pd

    random.seed(1)
    values = [None if random.random() < 0.3 else random.gauss(0, 1) for _ in range(60)]
    want = np.sqrt((pd.Series(values, dtype=float) ** 2).ewm(alpha=0.06, adjust=False).mean())
    got = [r["ewma_vol"] for r in evaluate.ewma_vol(panel(spark, {"a": values, "b": [None, 2.0]})).where("asset_id = 'a'").orderBy("date").collect()]
    assert np.allclose([np.nan if g is None else g for g in got], want, equal_nan=True)
    with pytest.raises(ContractError):
        evaluate.ewma_vol(panel(spark, values={"a": [1.0]}), 1.0)


def test_bands_and_signal(spark):
    rows = frame(spark, [("a", 1.0, 2.0, 0.0), ("a", 9.0, 1.0, 0.0), ("a", 1.0, 0.0, 0.0)])
    assert evaluate.bands(rows).orderBy("forecast_start_date").first()["lower_2s"] == -3.0
    with pytest.raises(ContractError):
        evaluate.bands(rows.limit(1))
    got = [(r["signal"], r["color"]) for r in evaluate.risk_signal(rows).orderBy("forecast_start_date").collect()]
    assert got[0][0] == 0.5 and got[1] == (3.0, pytest.approx(math.tanh(3 / 2.375))) and got[2] == (None, 0.0)


def cross(spark, values, n_dates=1):
    return spark.createDataFrame([(f"a{i}", START + dt.timedelta(k), float(v), 1.0, float(v)) for k in range(n_dates) for i, v in enumerate(values)], "asset_id string, forecast_start_date date, mu double, sigma double, target double")


def test_buckets(spark):
    import pandas as pd

    ties = [1, 1, 1, 1, 2, 3, 4, 5, 5]
    labels = pd.qcut(pd.Series(ties), 5, labels=False, duplicates="drop") + 1
    assert labels.max() == 4  # equal edges count once
    assert {r["mu"]: r["bucket"] for r in signal.buckets(cross(spark, ties), 5, z="mu").collect()} == dict(zip(map(float, ties), labels))
    assert {r["bucket"] for r in signal.buckets(cross(spark, [1, 1, 2]), 3, z="mu").collect()} == {None}
    random.seed(2)
    for n, size in ((5, 11), (4, 9), (3, 20)):
        values = [random.choice([random.gauss(0, 1), 0.0, 1.0]) for _ in range(size)]
        if len(set(values)) >= n:
            want = pd.qcut(pd.Series(values), n, labels=False, duplicates="drop") + 1
            got = {r["asset_id"]: r["bucket"] for r in signal.buckets(cross(spark, values), n, z="mu").collect()}
            assert [got[f"a{i}"] for i in range(size)] == want.tolist()


def test_zscore_and_spread(spark):
    z = {r["mu"]: r["signal_z"] for r in signal.signal_z(cross(spark, [1, 2, 3])).collect()}
    assert z[3.0] == pytest.approx(math.sqrt(1.5)) and {r["signal_z"] for r in signal.signal_z(cross(spark, [2, 2])).collect()} == {0.0}
    b = signal.buckets(signal.signal_z(cross(spark, [1, 2, 3, 4], 3)), 2)
    s = signal.spread(b, 2)
    assert [r["spread"] for r in s.collect()] == [2.0] * 3
    assert signal.spread_summary(s).first()["sharpe"] == 0.0
    assert {r["bucket"]: (r["mean_per_period"], r["n"]) for r in signal.bucket_stats(b).collect()} == {1: (1.5, 6), 2: (3.5, 6)}
    with pytest.raises(ContractError), failing():
        signal.spread(b.where("bucket = 1"), 2).collect()


def test_growth(spark):
    p = panel(spark, {"a": [-0.5, 1.0, -0.2]})
    got = [(r["date"], r["cumulative"], r["drawdown"]) for r in signal.growth(p, "ret", "date").orderBy("date").collect()]
    assert got[0] == (D(2023, 12, 31), 1.0, None) and [g[1] for g in got[1:]] == pytest.approx([0.5, 1.0, 0.8]) and [g[2] for g in got[1:]] == pytest.approx([0.0, 0.0, -0.2])


def test_ensemble(spark):
    stacked = spark.createDataFrame([(k, "a", START, START, mu, s) for k, mu, s in ((0, 1.0, 1.0), (1, 2.0, 1.0), (2, 6.0, 2.0))], "estimator int, asset_id string, forecast_start_date date, forecast_end_date date, mu double, sigma double")
    for mode, mu in (("mean", 3.0), ("median", 2.0)):
        r = ensemble.aggregate_gaussians(stacked, mode).first()
        assert (r["mu"], r["n_members"]) == (mu, 3) and r["sigma"] == pytest.approx(math.sqrt(2 + np.var([1, 2, 6])))
    ensemble.check_aligned(stacked, 3)
    for bad in (lambda: ensemble.check_aligned(stacked.where("estimator > 0"), 3), lambda: ensemble.aggregate_gaussians(stacked, "max"), lambda: ensemble.prune(stacked, 0), lambda: ensemble.best_trial(stacked, "up")):
        with pytest.raises(ContractError):
            bad()
    losses = spark.createDataFrame([(0, 2.0), (1, None), (2, 1.0)], "estimator int, oob_loss double")
    assert [r["estimator"] for r in ensemble.prune(losses, 9).collect()] == [2, 0, 1]
    assert [(r["estimator"], r["retained"]) for r in ensemble.leaderboard(losses, 3, 1).orderBy("rank").collect()] == [(2, True), (0, False), (1, False)]
    s = ensemble.loss_summary(losses).first()
    assert (s["mean_loss"], s["std_loss"]) == (1.5, 0.5)


def test_bagging(spark):
    from panelcast.operators import splits

    rng = np.random.default_rng(4)
    y = [0.0]
    for _ in range(300):
        y.append(0.6 * y[-1] + rng.normal())
    p = panel(spark, {"a": y, "b": y[::-1]})
    bags = splits.bootstrap_dates(splits.date_index(p), 6, 0.8, seed=1)
    losses, kept, out = ensemble.bag_ar1(p, bags, 4)
    rows = {r["estimator"]: r["oob_loss"] for r in losses.collect()}
    assert len(rows) == 6 and [r["estimator"] for r in kept.collect()] == sorted(rows, key=rows.get)[:4]
    ens = out.collect()
    assert len(ens) == 2 * 300 and all(r["n_members"] == 4 and r["sigma"] > 0.8 for r in ens)
