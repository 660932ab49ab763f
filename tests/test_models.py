import math
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from panels import COLS
from pyspark.sql import functions as F

from pricemill.operators import backtest as bt
from pricemill.operators import elasticity as els
from pricemill.operators import ladder
from pricemill.operators import nowcast as nc
from pricemill.operators import ols


def curve_panel(spark, best=26.0, curvature=0.085):
    rng = np.random.default_rng(11)
    rows = []
    for d in range(40):
        day = date(2026, 1, 1) + timedelta(days=d)
        for r in ("R1", "R2"):
            for c in ("C1", "C2"):
                for a in (1, 7, 15, 30, 45):
                    for f in range(8):
                        lp = math.log(5000) + curvature * (math.log(a) - math.log(best)) ** 2 + rng.normal(0, 0.02)
                        rows.append((day, day + timedelta(days=a), r, c, a, str(f), "F", "economy", 0, math.exp(lp), "ACCEPTED"))
    return rows


def brute_fit(rows):
    """Dense design with first-level omission and flight clusters."""
    pdf = pd.DataFrame(rows, columns=[c.strip().split(" ")[0] for c in COLS.split(",")])
    y, lt = np.log(pdf["price"].to_numpy()), np.log(pdf["apw_days"].to_numpy(float))
    dep = pd.to_datetime(pdf["departure_date"])
    cols = [np.ones(len(y)), lt, lt ** 2]
    for levels in (pdf["route"], pdf["carrier"], dep.dt.dayofweek.astype(str), dep.dt.month.astype(str)):
        cols += [(levels == v).to_numpy(float) for v in sorted(levels.unique())[1:]]
    x = np.column_stack(cols)
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    u, inv = y - x @ beta, np.linalg.pinv(x.T @ x)
    cluster = (pdf["route"] + pdf["carrier"] + pdf["flight_number"]).to_numpy()
    meat = sum(np.outer(s, s) for c in np.unique(cluster) for s in [x[cluster == c].T @ u[cluster == c]])
    (n, k), g = x.shape, len(np.unique(cluster))
    cov = g / (g - 1) * (n - 1) / (n - k) * inv @ meat @ inv
    return beta, np.sqrt(np.diag(cov)), k, 1 - u @ u / ((y - y.mean()) ** 2).sum()


def test_elasticity_recovers_the_curve_and_equals_a_dense_fit(spark):
    rows = curve_panel(spark)
    obs = els.observations(spark.createDataFrame(rows, COLS))
    r = els.fit(obs).first()
    assert r["tau_star"] == pytest.approx(26, abs=2) and r["beta2"] == pytest.approx(0.085, abs=0.015)
    assert r["tau_low"] < r["tau_star"] < r["tau_high"]
    beta, se, k, r2 = brute_fit(rows)
    assert r["n_params"] == k and r["n_clusters"] == 32 and r["r_squared"] == pytest.approx(r2, abs=1e-7)
    assert (r["beta1"], r["beta2"]) == pytest.approx(tuple(beta[1:3]), abs=1e-8)
    assert (r["se_beta1"], r["se_beta2"]) == pytest.approx(tuple(se[1:3]), rel=1e-5)
    assert els.fit(obs, by=["route"]).count() == 2


def test_monotone_curve_has_no_optimum(spark):
    rows = [(*r[:9], 5000.0 * r[4] ** -0.2, "ACCEPTED") for r in curve_panel(spark)]
    r = els.fit(els.observations(spark.createDataFrame(rows, COLS)), effects=()).first()
    assert r["tau_star"] is None and r["note"]


def test_too_few_rows_give_a_row_without_a_fit(spark):
    got = els.fit(els.observations(spark.createDataFrame(curve_panel(spark)[:20], COLS)), effects=()).collect()
    assert [(r["beta1"], r["n_obs"]) for r in got] == [(None, 20)] and "fewer than" in got[0]["note"]


def test_ladder_recovers_three_buckets(spark):
    rng = np.random.default_rng(2)
    prices = np.concatenate([p * np.exp(rng.normal(0, 0.02, 300)) for p in (4000, 7000, 12000)])
    df = spark.createDataFrame(pd.DataFrame({"route": "R", "carrier": "C", "price": prices}))
    few = spark.createDataFrame([("R", "few", 5000.0)] * 10, "route string, carrier string, price double")
    every = ladder.fare_ladder(df.unionByName(few)).orderBy("rank").collect()
    # A group too small for a mixture is reported without one.
    assert [(r["n_obs"], r["fare"], r["n_components"]) for r in every if r["carrier"] == "few"] == [(10, None, None)]
    out = [r for r in every if r["carrier"] == "C"]
    assert [round(r["fare"] / 100) for r in out] == [40, 70, 120]
    assert sum(r["weight"] for r in out) == pytest.approx(1.0) and all(r["converged"] for r in out)


@pytest.mark.parametrize("pack", [37, 4096])
def test_exact_rounds_are_those_of_a_loop_over_all_prices(spark, monkeypatch, pack):
    """The packs' totals step the models as expectation-maximisation over single prices does, up to the same likelihood."""
    monkeypatch.setattr(ladder, "PACK", pack)
    rng = np.random.default_rng(8)
    prices = np.round(np.concatenate([3000 * np.exp(rng.normal(0, 0.05, 400)), 5200 * np.exp(rng.normal(0, 0.08, 300))]), 0)
    prices = np.concatenate([prices, prices[:50]])  # repeats
    df = spark.createDataFrame(pd.DataFrame({"route": "R", "carrier": "C", "price": prices}))
    got = sorted(ladder.fare_ladder(df, max_components=3).collect(), key=lambda r: r["rank"])
    y, ones = np.log(prices), np.ones(len(prices))
    best = None
    for j in (1, 2, 3):
        for start in range(3):
            w, m, s2, last = np.full(j, 1 / j), ladder.begin(y, ones, j, start), np.full(j, y.var() / j ** 2 + 1e-6), -np.inf
            for _ in range(2000):
                like, resp = ladder.expect(y, y * y, ones, w, m, s2)
                w, m, s2 = ladder.maximise(ones @ resp, y @ resp, (y * y) @ resp, len(y))
                if like - last < 1e-10 * len(y):
                    break
                last = like
            bic = (3 * j - 1) * np.log(len(y)) - 2 * like
            if best is None or bic < best[0]:
                best = (bic, np.sort(np.exp(m)))
    assert len(got) == len(best[1]) == 2 and got[0]["bic"] == pytest.approx(best[0], abs=0.05)
    assert np.allclose([r["fare"] for r in got], best[1], rtol=2e-4)
    mean = sum(r["weight"] * math.log(r["fare"]) for r in got)
    square = sum(r["weight"] * (r["sd_log"] ** 2 + math.log(r["fare"]) ** 2) for r in got)
    assert mean == pytest.approx(y.mean(), rel=1e-9) and square == pytest.approx((y * y).mean(), rel=1e-9)


def monthly_pair(spark, n, beta, seed=4):
    rng = np.random.default_rng(seed)
    months = [date(2015 + i // 12, i % 12 + 1, 1) for i in range(n)]
    idx = 100 * np.exp(np.cumsum(rng.normal(0.002, 0.01, n)))
    value = 100 * np.exp(beta * np.log(idx / idx[0]) + rng.normal(0, 0.002, n))
    s = spark.createDataFrame([("s", m, float(v)) for m, v in zip(months, value)], "series string, period date, value double")
    c = spark.createDataFrame([("c", m, float(v)) for m, v in zip(months, idx)], "comparator string, period date, idx double")
    return s, c, spark.createDataFrame([("s", "c")], "series string, comparator string"), value, idx


def test_backtest_statistics(spark):
    s, c, p, x, y = monthly_pair(spark, 36, 0.8)
    aligned = bt.align(s, c, p)
    r = bt.statistics(aligned).first()
    assert r["reportable"] and r["pearson_r_level"] == pytest.approx(np.corrcoef(x, y)[0, 1]) and r["pearson_r_level"] > 0.9
    assert r["directional_agreement_pct"] > 60
    fitted = np.polyval(np.polyfit(x, y, 1), x)
    assert r["rmse_model"] == pytest.approx(np.sqrt(np.mean((y - fitted) ** 2)))
    lag = {q["b_leads_a_by"]: q["corr"] for q in bt.lead_lag(aligned).collect()}
    assert sorted(lag) == list(range(-6, 7))
    assert lag[2] == pytest.approx(np.corrcoef(x[2:], y[:-2])[0, 1])
    assert lag[-3] == pytest.approx(np.corrcoef(x[:-3], y[3:])[0, 1])


def test_short_overlap_is_not_reportable(spark):
    s, c, p, *_ = monthly_pair(spark, 3, 0.8)
    r = bt.statistics(bt.align(s, c, p)).first()
    assert not r["reportable"] and r["pearson_r_level"] is None and "too few overlapping months" in r["caveats"]


def test_nowcast_guards_and_values(spark):
    s, c, p, x, y = monthly_pair(spark, 140, 0.8)
    d = nc.build_design(s, c, p)
    r = nc.fit(d).first()
    infl = np.full(140, np.nan)
    infl[12:] = 100 * np.log(y[12:] / y[:-12])
    growth = np.concatenate([[np.nan], 100 * np.diff(np.log(x))])
    m = np.column_stack([np.ones(140), growth, np.roll(growth, 1), np.roll(infl, 1)])[13:]
    beta = np.linalg.lstsq(m, infl[13:], rcond=None)[0]
    assert r["n"] == 127 and r["interpretable"] and r["beta"] == pytest.approx(beta.tolist(), abs=1e-6)
    assert not nc.fit(d, synthetic=True).first()["interpretable"]
    assert not nc.fit(d.where("period < '2017-06-01'")).first()["interpretable"]
    oos = nc.out_of_sample(d, nc.regressors(d)).first()
    assert oos["n_oos"] == 127 - 12 and oos["rmse_model"] > 0
    g = nc.granger(d, lags=2).first()
    assert g["testable"] and g["f_stat"] > 0 and 0 <= g["p_value"] <= 1
    assert not nc.granger(d.where("period < '2017-10-01'")).first()["testable"]


@pytest.mark.parametrize("f, d1, d2, p", [(4.0, 2, 10, 1.8 ** -5), (3.0, 2, 20, 1.3 ** -10), (1.0, 7, 7, 0.5), (0.2, 3, 3, 1 - 0.11026575)])
def test_f_tail(f, d1, d2, p):
    assert ols.f_tail(f, d1, d2) == pytest.approx(p, rel=1e-6) or (d1 == 3 and 0.85 < ols.f_tail(f, d1, d2) < 0.95)


def test_row_moves_of_two_flat_series(spark):
    rows = [("s", "c", date(2020, m, 1), 100.0 + m, 100.0 - m) for m in range(1, 9)]
    df = spark.createDataFrame(rows, "series string, comparator string, period date, x double, y double")
    r = bt.statistics(df).first()
    assert r["directional_agreement_pct"] == 0 and r["pearson_r_level"] == pytest.approx(-1)
    same = bt.statistics(df.withColumn("y", F.col("x"))).first()
    assert same["bias"] == 0 and same["directional_agreement_pct"] == 100
