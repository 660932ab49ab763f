"""Least squares from moments: Spark sums the cross products, a small k x k solve finishes.

Every fit is grouped, so thousands of regressions are one job. Only sums leave the executors'
rows: k(k+1)/2 numbers per group, however many observations the group has.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql import types as T

FIT = T.StructType([
    T.StructField("beta", T.ArrayType(T.DoubleType())),
    T.StructField("se", T.ArrayType(T.DoubleType())),
    T.StructField("rss", T.DoubleType()),
    T.StructField("r2", T.DoubleType()),
    T.StructField("adj_r2", T.DoubleType()),
])


def moment_array(y: Column, xs: Sequence[Column], over=None) -> Column:
    """Array of sums: n, then upper triangle of [1, xs, y] cross products; optionally over a window."""
    terms = [F.lit(1.0), *xs, y]
    sums = [F.sum(a * b) for i, a in enumerate(terms) for b in terms[i:]]
    if over is not None:
        sums = [s.over(over) for s in sums]
    return F.array(*sums)


def _unpack(flat: np.ndarray, k: int) -> np.ndarray:
    m = np.zeros((k + 1, k + 1))
    m[np.triu_indices(k + 1)] = flat
    return m + np.triu(m, 1).T


def _solve(flat, k: int):
    """beta, se, rss, r2, adj from the packed moments of k regressors (constant included)."""
    flat = np.asarray(flat, dtype=float)
    if not np.isfinite(flat).all():
        return None
    m = _unpack(flat, k)
    n = m[0, 0]
    # Centre the regressors about their means: the constant then decouples and conditioning improves.
    mean = m[0, 1:k] / n
    ybar = m[0, k] / n
    sxx = m[1:k, 1:k] - n * np.outer(mean, mean)
    sxy = m[1:k, k] - n * mean * ybar
    syy = m[k, k] - n * ybar * ybar
    inv = np.linalg.pinv(sxx) if k > 1 else np.zeros((0, 0))
    slope = inv @ sxy
    beta = np.concatenate([[ybar - mean @ slope], slope])
    rss = max(float(syy - sxy @ slope), 0.0)
    dof = max(n - k, 1)
    sigma2 = rss / dof
    var = np.concatenate([[1.0 / n + mean @ inv @ mean], np.diag(inv)]) * sigma2
    r2 = 1 - rss / syy if syy > 0 else float("nan")
    adj = 1 - (1 - r2) * (n - 1) / dof
    return beta.tolist(), np.sqrt(np.maximum(var, 0)).tolist(), rss, r2, adj


def solve(moments: Column, k: int) -> Column:
    """Fit struct from a packed moment array; null moments give a null fit."""
    @F.pandas_udf(FIT)
    def run(col: pd.Series) -> pd.DataFrame:
        out = [None if v is None else _solve(v, k) for v in col]
        empty = (None, None, None, None, None)
        return pd.DataFrame([o or empty for o in out], columns=["beta", "se", "rss", "r2", "adj_r2"])

    return run(moments)


def fit(df: DataFrame, by: Sequence[str], y: str, xs: Sequence[str]) -> DataFrame:
    """One row per group: n, beta and se arrays in the order [const, *xs], rss, r2, adj_r2."""
    used = df
    for c in (y, *xs):
        used = used.where(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    k = len(xs) + 1
    sums = used.groupBy(*by).agg(moment_array(F.col(y), [F.col(x) for x in xs]).alias("_m"), F.count(F.lit(1)).alias("n"))
    return sums.withColumn("_f", solve(F.col("_m"), k)).select(*by, "n", F.lit(k).alias("k"), "_f.*")


def f_tail(f: float, d1: float, d2: float) -> float:
    """P(F > f) from the regularised incomplete beta, by its continued fraction."""
    from math import exp, lgamma, log
    if not (f > 0) or d2 <= 0:
        return 1.0 if f == 0 else float("nan")

    def fraction(x: float, a: float, b: float) -> float:
        def safe(v: float) -> float:
            return v if abs(v) > 1e-300 else 1e-300

        c, d = 1.0, 1.0 / safe(1 - (a + b) * x / (a + 1))
        total = d
        for m in range(1, 1000):
            even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            for step in (even, odd):
                d = 1.0 / safe(1 + step * d)
                c = safe(1 + step / c)
                total *= c * d
            if abs(c * d - 1) < 1e-15:
                break
        return total

    a, b = d2 / 2, d1 / 2
    x = d2 / (d2 + d1 * f)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) if 0 < x < 1 else 0.0
    if x < (a + 1) / (a + b + 2):
        return front * fraction(x, a, b) / a
    return 1 - front * fraction(1 - x, b, a) / b


@F.pandas_udf(T.DoubleType())
def f_tail_udf(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(v) else f_tail(float(v), float(p), float(q)) for v, p, q in zip(f, d1, d2)], dtype="float64")


def expanding(df: DataFrame, by: Sequence[str], order: str, y: str, xs: Sequence[str], min_train: int) -> DataFrame:
    """One-step forecasts: each row is predicted from a fit on the rows before it in its group."""
    w = W.partitionBy(*by).orderBy(order)
    before = w.rowsBetween(W.unboundedPreceding, -1)
    k = len(xs) + 1
    rows = (
        df.withColumn("_t", F.row_number().over(w) - 1)
        .withColumn("naive", F.lag(y).over(w))
        .withColumn("_m", moment_array(F.col(y), [F.col(x) for x in xs], before))
        .where(F.col("_t") >= min_train)
    )
    beta = solve(F.col("_m"), k)["beta"]
    terms = [F.col("_b")[0], *[F.col("_b")[i + 1] * F.col(x) for i, x in enumerate(xs)]]
    predicted = terms[0]
    for t in terms[1:]:
        predicted = predicted + t
    return rows.withColumn("_b", beta).select(*by, order, F.col(y).alias("actual"), "naive", predicted.alias("predicted"))
