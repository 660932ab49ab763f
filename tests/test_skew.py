"""The skew-safe building blocks against plain definitions, with one group holding most rows."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pricemill.functions.ordered import split_lag
from pricemill.functions.quantiles import grouped_quantiles, median_and_mad


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"g": np.where(np.arange(6000) % 3 > 0, "hot", (np.arange(6000) % 40).astype(str)), "h": 1,
                        "v": np.round(rng.normal(0, 50, 6000), 1)})
    return pdf, spark.createDataFrame(pdf)


def test_quantiles_equal_numpy(skewed):
    pdf, df = skewed
    probs = {"q0": 0.0, "q1": 0.25, "q2": 0.5, "q3": 0.9, "q4": 1.0}
    got = grouped_quantiles(df, ["g", "h"], F.col("v"), probs).toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        assert got.loc[g, "n_values"] == len(part)
        for name, p in probs.items():
            assert got.loc[g, name] == pytest.approx(np.percentile(part["v"], 100 * p), abs=1e-9)


def test_median_and_mad(skewed):
    pdf, df = skewed
    got = median_and_mad(df, ["g"], F.col("v")).toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        med = part["v"].median()
        assert got.loc[g, "med"] == pytest.approx(med)
        assert got.loc[g, "mad"] == pytest.approx((part["v"] - med).abs().median(), abs=1e-9)


def test_no_window_over_the_raw_group(skewed):
    _, df = skewed
    plan = grouped_quantiles(df, ["g"], F.col("v"), {"m": 0.5})._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.split("\n") if "Window [" in line]
    assert windows and all("_m#" in w or "_b#" in w for w in windows)


def test_split_lag_equals_lag(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise((F.col("id") % 7).cast("string")).alias("k"),
                                  (F.col("id") * 7919 % 3001).alias("t"), F.col("id").alias("v"))
    got = split_lag(df, ["k"], ["t"], "v", "prev", F.floor(F.col("t") / 100))
    want = df.withColumn("want", F.lag("v").over(W.partitionBy("k").orderBy("t")))
    assert got.join(want, ["k", "t", "v"]).where(~F.col("prev").eqNullSafe(F.col("want"))).count() == 0
    assert got.count() == 3000
