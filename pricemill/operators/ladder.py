"""Fare ladder: Gaussian mixtures of log prices of all groups at once, their size chosen by BIC.

Every group is first folded to its distinct prices with counts, which stand for all quotes exactly.

1. Starts: prices are folded further into narrow bins with their count, sum and sum of squares, a bounded table per group. On it
   expectation-maximisation runs to its end for every (group, number of components, start) as a row of work of its own; the likeliest start goes on.
2. Exact rounds: distinct prices lie in packs of bounded size. A round joins the present parameters to the packs, each pack hands on
   mass, sum and sum of squares by component, and their totals are the next parameters. Models that have converged leave; most do at once,
   since the bins were narrow. So a group of any size spreads over its packs, and only parameters and totals move.
3. The group's number of components is the one of least BIC at the exact likelihood.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import materialise

MIN_OBS = 50
BINS_PER_LOG_UNIT = 250
PACK = 4096
STARTS = 3
# Rounds on bins and on exact prices; a model has converged when a round gains less than this per quote (the surveyed fit stops at 1e-3).
BIN_ROUNDS, BIN_CLOSE = 200, 1e-5
EXACT_ROUNDS, EXACT_CLOSE = 25, 1e-4
LEAST_VARIANCE = 1e-6


def expect(v: np.ndarray, sq: np.ndarray, n: np.ndarray, weight: np.ndarray, mean: np.ndarray, var: np.ndarray):
    """Log likelihood and responsibilities of values with mean ``v`` and mean square ``sq``, ``n`` of each."""
    off = sq[:, None] - 2 * v[:, None] * mean + mean ** 2
    logp = np.log(weight) - 0.5 * (np.log(2 * np.pi * var) + off / var)
    top = logp.max(axis=1, keepdims=True)
    norm = top[:, 0] + np.log(np.exp(logp - top).sum(axis=1))
    return float(n @ norm), np.exp(logp - norm[:, None])


def maximise(mass: np.ndarray, s: np.ndarray, q: np.ndarray, total: float):
    mass = mass + 1e-12
    mean = s / mass
    return mass / total, mean, np.maximum(q / mass - mean ** 2, LEAST_VARIANCE)


def begin(v: np.ndarray, n: np.ndarray, j: int, start: int) -> np.ndarray:
    """Start means: quantiles, an even spread, or values drawn far from one another."""
    order = np.argsort(v)
    share = np.cumsum(n[order]) / n.sum()
    if start == 0:
        return v[order][np.searchsorted(share, (np.arange(j) + 0.5) / j)]
    if start == 1:
        return np.linspace(v.min(), v.max(), j + 2)[1:-1]
    rnd = np.random.default_rng([j, start, len(v)])
    chosen = [rnd.choice(v, p=n / n.sum())]
    while len(chosen) < j:
        far = n * (v[:, None] - np.array(chosen)).__abs__().min(1) ** 2
        chosen.append(rnd.choice(v, p=far / far.sum() if far.sum() > 0 else n / n.sum()))
    return np.array(chosen)


def _fit_bins(by: Sequence[str], rounds: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        j, start = int(key[-2]), int(key[-1])
        n, s, q = (pdf[c].to_numpy(float) for c in ("n", "s", "q"))
        v, total = s / n, n.sum()
        grand = max(q.sum() / total - (s.sum() / total) ** 2, 1e-8)
        weight, mean, var, last = np.full(j, 1 / j), begin(v, n, j, start), np.full(j, grand / j ** 2 + 1e-6), -np.inf
        for _ in range(rounds):
            like, resp = expect(v, q / n, n, weight, mean, var)
            weight, mean, var = maximise(n @ resp, s @ resp, q @ resp, total)
            if like - last < BIN_CLOSE * total:
                break
            last = like
        like, _ = expect(v, q / n, n, weight, mean, var)
        return pd.DataFrame({**{b: [key[i]] for i, b in enumerate(by)}, "j": [j], "start": [start], "like": [like], "weight": [weight], "mean": [mean], "var": [var]})
    return run


def _expected(by: Sequence[str], models: T.StructType):
    """Totals of a pack by model and component; the likelihood stands with component 0."""
    def run(batches):
        for batch in batches:
            out = {c: [] for c in ("row", "j", "c", "mass", "s", "q", "like")}
            for row in range(batch.num_rows):
                v = np.asarray(batch.column("v")[row].values)
                n = np.asarray(batch.column("n")[row].values).astype(float)
                for model in batch.column("models")[row].as_py():
                    like, resp = expect(v, v * v, n, *(np.array(model[c]) for c in ("weight", "mean", "var")))
                    k = resp.shape[1]
                    for c, values in (("row", [row] * k), ("j", [model["j"]] * k), ("c", range(k)), ("mass", n @ resp), ("s", (n * v) @ resp), ("q", (n * v * v) @ resp),
                                      ("like", [like] + [0.0] * (k - 1))):
                        out[c].extend(values)
            at = pa.array(out.pop("row"), pa.int32())
            kinds = {"j": pa.int32(), "c": pa.int32()}
            yield pa.RecordBatch.from_arrays([*[batch.column(b).take(at) for b in by], *[pa.array(x, kinds.get(c, pa.float64())) for c, x in out.items()]], [*by, *out])
    return run


def exact_rounds(packs: DataFrame, models: DataFrame, by: Sequence[str], rounds: int = EXACT_ROUNDS) -> DataFrame:
    """``models`` (by, j, total, weight, mean, var) carried on over the exact values, with ``like``, ``rounds`` and ``converged``."""
    by = list(by)
    kinds = {f.name: f.dataType for f in packs.schema.fields}
    schema = T.StructType([*[T.StructField(b, kinds[b]) for b in by], T.StructField("j", T.IntegerType()), T.StructField("c", T.IntegerType()),
                           *[T.StructField(c, T.DoubleType()) for c in ("mass", "s", "q", "like")]])
    now = materialise(models.select(*by, "j", "total", "weight", "mean", "var", F.lit(float("-inf")).alias("like"), F.lit(0).alias("rounds"), F.lit(False).alias("converged")), "ladder")
    model = F.struct("j", "weight", "mean", "var")
    for _ in range(rounds):
        active = now.where(~F.col("converged"))
        if active.isEmpty():
            break
        listed = active.groupBy(*by).agg(F.collect_list(model).alias("models"))  # a handful of models per group
        parts = packs.join(listed, by).select(*by, "v", "n", "models").mapInArrow(_expected(by, schema), schema)
        totals = parts.groupBy(*by, "j", "c").agg(*[F.sum(c).alias(c) for c in ("mass", "s", "q", "like")])
        heard = totals.groupBy(*by, "j").agg(F.sort_array(F.collect_list(F.struct("c", "mass", "s", "q"))).alias("t"), F.sum("like").alias("_like"))
        stepped = active.join(heard, [*by, "j"])
        mass = lambda x: x["mass"] + 1e-12
        new = stepped.select(
            *by, "j", "total", F.transform("t", lambda x: mass(x) / F.col("total")).alias("weight"), F.transform("t", lambda x: x["s"] / mass(x)).alias("mean"),
            F.transform("t", lambda x: F.greatest(x["q"] / mass(x) - F.pow(x["s"] / mass(x), 2), F.lit(LEAST_VARIANCE))).alias("var"),
            F.col("_like").alias("like"), (F.col("rounds") + 1).alias("rounds"), (F.col("_like") - F.col("like") < EXACT_CLOSE * F.col("total")).alias("converged"))
        now = materialise(now.where("converged").unionByName(new), "ladder")
    return now


def fare_ladder(quotes: DataFrame, by: Sequence[str] = ("route", "carrier"), price: str = "price", max_components: int = 6) -> DataFrame:
    """One row per bucket of every group, in ascending order: fare, sd_log, weight; with n_obs, n_components, bic and whether the fit converged.

    A group of fewer than ``MIN_OBS`` prices has one row with nulls.
    """
    by = list(by)
    values = quotes.where(F.col(price) > 0).groupBy(*by, F.ln(price).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    values = materialise(values, "log-prices")
    sizes = values.groupBy(*by).agg(F.sum("n").alias("n_obs"), F.count(F.lit(1)).alias("_distinct"))
    enough = sizes.where(F.col("n_obs") >= MIN_OBS)
    kept = values.join(enough, by)
    bins = kept.groupBy(*by, F.floor(F.col("v") * BINS_PER_LOG_UNIT).alias("_b")).agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("v")).alias("s"), F.sum(F.col("n") * F.col("v") * F.col("v")).alias("q"))
    kinds = {f.name: f.dataType for f in values.schema.fields}
    numbers = T.ArrayType(T.DoubleType())
    schema = T.StructType([*[T.StructField(b, kinds[b]) for b in by], T.StructField("j", T.IntegerType()), T.StructField("start", T.IntegerType()),
                           T.StructField("like", T.DoubleType()), *[T.StructField(c, numbers) for c in ("weight", "mean", "var")]])
    tries = F.explode(F.flatten(F.array(*[F.array(*[F.struct(F.lit(j).alias("j"), F.lit(s).alias("start")) for s in range(STARTS if j > 1 else 1)]) for j in range(1, max_components + 1)])))
    work = bins.select("*", tries.alias("_t")).select(*by, "n", "s", "q", "_t.*")
    # Small tables and much work: a row of work stays where its hash puts it, or adaptive execution would merge the partitions.
    spread = work.repartition(max(quotes.sparkSession.sparkContext.defaultParallelism, int(quotes.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *by, "j", "start")
    fitted = spread.groupBy(*by, "j", "start").applyInPandas(_fit_bins(by, BIN_ROUNDS), schema)
    likeliest = fitted.groupBy(*by, "j").agg(F.max_by(F.struct("weight", "mean", "var"), F.struct("like", -F.col("start"))).alias("_m")).select(*by, "j", "_m.*")
    models = likeliest.join(enough.select(*by, F.col("n_obs").cast("double").alias("total")), by)
    pack = F.pmod(F.xxhash64("v"), F.ceil(F.col("_distinct") / PACK))
    packs = materialise(kept.withColumn("_pack", pack).groupBy(*by, "_pack").agg(F.sort_array(F.collect_list(F.struct("v", "n"))).alias("_x")).select(
        *by, F.col("_x.v").alias("v"), F.col("_x.n").alias("n")), "packs")
    done = exact_rounds(packs, models, by)
    bic = (3 * F.col("j") - 1) * F.ln("total") - 2 * F.col("like")
    best = done.withColumn("bic", bic).groupBy(*by).agg(F.min_by(F.struct("j", "bic", "total", "weight", "mean", "var", "converged"), F.struct("bic", "j")).alias("_m")).select(*by, "_m.*")
    bucket = F.array_sort(F.arrays_zip("mean", "var", "weight"))
    ladder = best.select(*by, F.col("total").cast("long").alias("n_obs"), F.col("j").alias("n_components"), "bic", "converged", F.posexplode(bucket).alias("_i", "_b")).select(
        *by, "n_obs", "n_components", "bic", (F.col("_i") + 1).alias("rank"), F.exp("_b.mean").alias("fare"), F.sqrt("_b.var").alias("sd_log"), F.col("_b.weight").alias("weight"), "converged")
    few = sizes.where(F.col("n_obs") < MIN_OBS).select(*by, F.col("n_obs").cast("long").alias("n_obs"))
    return ladder.unionByName(few, allowMissingColumns=True)
