"""Resampling by split picks, against its distribution and against direct resampling."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricemill.operators import bootstrap as boot


def test_split_picks_are_multinomial():
    sizes = np.array([1, 5, 2, 8, 4, 1, 11])
    counts = boot.split_picks(sizes, 32, 20000, np.random.default_rng(1))
    share = sizes / sizes.sum()
    assert (counts.sum(1) == 32).all()
    assert np.allclose(counts.mean(0), 32 * share, atol=0.1)
    assert np.allclose(np.cov(counts.T), 32 * (np.diag(share) - np.outer(share, share)), atol=0.25)


def flights(spark, n, groups=("g",)):
    rows = [(g, f"f{i:05d}", math.sin(i) * (1 + len(g)), 1) for g in groups for i in range(n)]
    return spark.createDataFrame(rows, "period string, flight string, s double, c int")


@pytest.mark.parametrize("block", [7, 64, 100000])
def test_every_draw_has_as_many_picks_as_flights(spark, block):
    df = flights(spark, 300, ("a", "bb")).withColumn("k", F.length("period"))
    got = boot.resample(df, ["period"], ["flight"], ["s", "c"], 230, 3, keep=["k"], block=block)
    rows = got.collect()
    assert sorted((r["period"], r["draw"]) for r in rows) == [(g, d) for g in ("a", "bb") for d in range(230)]
    assert all(r["c"] == 300 and r["k"] == len(r["period"]) for r in rows)
    again = boot.resample(df.repartition(5), ["period"], ["flight"], ["s", "c"], 230, 3, keep=["k"], block=block).collect()
    assert sorted((r["period"], r["draw"], round(r["s"], 9)) for r in rows) == sorted((r["period"], r["draw"], round(r["s"], 9)) for r in again)


@pytest.mark.parametrize("block", [16, 100000])
def test_interval_agrees_with_direct_resampling(spark, block):
    n, draws = 400, 1500
    df = flights(spark, n)
    stat = boot.resample(df, ["period"], ["flight"], ["s", "c"], draws, 11, block=block).select("period", (F.col("s") / F.col("c")).alias("stat"))
    got = boot.interval(stat, ["period"], 0.9).first()
    values = np.array([r["s"] for r in df.orderBy("flight").collect()])
    rnd = np.random.default_rng(5)
    direct = np.array([values[rnd.integers(0, n, n)].mean() for _ in range(6000)])
    low, high = np.quantile(direct, [0.05, 0.95])
    assert abs(got["se"] / direct.std(ddof=1) - 1) < 0.08
    assert abs(got["ci_low"] - low) < 0.15 * (high - low) and abs(got["ci_high"] - high) < 0.15 * (high - low)


def test_no_flight_is_joined_with_draws(spark):
    """After the blocks are written, only blocks and totals move: the one join left meets splits of blocks."""
    df = flights(spark, 100)
    plan = boot.resample(df, ["period"], ["flight"], ["s", "c"], 50, 3, block=8)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "Window" not in plan and "flight" not in plan.split("Join ")[0]


def test_estimators_on_a_sample_that_is_known(spark):
    rows = [(1, "r", "c", 1, f"f{i}", v) for i, v in enumerate([0.0, 0.1, 0.2, 0.3, 9.0])] + [(2, "r", "c", 1, "f0", 0.5)]
    df = spark.createDataFrame(rows, "period int, route string, carrier string, apw_days int, flight_number string, lr double")
    for estimator, want in ((boot.median, 0.2), (lambda v: boot.trimmed_mean(v, 0.2), 0.2), (lambda v: float(v.max()), 9.0)):
        got = {r["period"]: r for r in boot.estimated_interval(df, estimator, 60, level=0.8).collect()}
        assert math.isclose(got[1]["value"], 100 * math.exp(want), rel_tol=1e-9) and got[1]["n_blocks"] == 5
        assert got[1]["ci_low"] <= got[1]["value"] <= got[1]["ci_high"] and got[1]["se"] > 0
        assert got[2]["n_blocks"] == 1 and got[2]["se"] is None and got[2]["ci_low"] is None
