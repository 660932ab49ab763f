"""Exact grouped quantiles that never bring a whole group into one task.

A window or ``percentile`` over a hot group sorts or hashes that group in a single task. Here the
group's value range is cut into monotone buckets. Counts of long stretches of buckets, which fold
before any shuffle, tell which stretches hold a wanted rank; only their values are reduced to distinct
ones with counts and shuffled, and only inside the buckets that hold a wanted rank are they ranked.
A hot group is thereby spread over its buckets, and most of its values are never moved.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import materialise

BUCKETS_PER_LOG_UNIT = 2048
BUCKETS_PER_STRETCH = 32


def _bucket(value: Column) -> Column:
    step = F.floor(F.signum(value) * F.log1p(F.abs(value)) * F.lit(BUCKETS_PER_LOG_UNIT)).cast("long")
    return F.coalesce(step, F.lit(0).cast("long"))


def present_values(df: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """(keys, v, n) with n = 1: what every quantile below starts from; null keys form no group."""
    present = F.col("v").isNotNull()
    for k in keys:
        present = present & F.col(k).isNotNull()
    return df.select(*keys, value.cast("double").alias("v")).where(present).withColumn("n", F.lit(1).cast("long"))


def _in_stretches(values: DataFrame, keys: Sequence[str], probs: dict[str, float], total: str) -> DataFrame:
    """The rows of (keys, v, n) that lie in a stretch of buckets with a wanted rank, with the count before it as ``_before``.

    Stretches are counted map-side. The table of those with a wanted rank has a few rows per group: it is written, so that its size is
    known when the values, of which most fall out here, join it.
    """
    stretched = values.withColumn("_s", F.floor(_bucket(F.col("v")) / BUCKETS_PER_STRETCH))
    by_key = W.partitionBy(*keys)
    stretches = (
        stretched.groupBy(*keys, "_s").agg(F.sum("n").alias("_m"))
        .withColumn("_before", F.sum("_m").over(by_key.orderBy("_s")) - F.col("_m"))
        .withColumn(total, F.sum("_m").over(by_key))
    )
    wanted = _holds(_ranks(probs, total), F.col("_before"), F.col("_m"))
    hit = materialise(stretches.where(wanted).select(*keys, "_s", "_before", total), "stretches")
    return stretched.join(hit, [*keys, "_s"])


def _ranks(probs: dict[str, float], total: str) -> dict[str, tuple[Column, Column, Column]]:
    places = {name: (F.col(total) - 1) * F.lit(float(p)) for name, p in probs.items()}
    return {name: (F.floor(pos), F.ceil(pos), pos - F.floor(pos)) for name, pos in places.items()}


def _holds(ranks: dict[str, tuple[Column, Column, Column]], start: Column, size: Column) -> Column:
    """Whether a bucket of ``size`` rows after ``start`` others holds a wanted rank."""
    wanted = F.lit(False)
    for lo, hi, _ in ranks.values():
        for rank in (lo, hi):
            wanted = wanted | ((rank >= start) & (rank < start + size))
    return wanted


def quantiles_of_counts(
    counts: DataFrame, keys: Sequence[str], probs: dict[str, float], total: str = "n_values"
) -> DataFrame:
    """Linear-interpolated quantiles of (keys, v, n); one output column per entry of ``probs``.

    ``counts`` is read twice, so it should be a written table; a value may have several rows.
    """
    keys = list(keys)
    kept = _in_stretches(counts, keys, probs, total).groupBy(*keys, "_s", "_before", total, "v").agg(F.sum("n").alias("n"))
    # Both branches below read this one exchange: bucket totals on one side, ranking on the other.
    kept = kept.withColumn("_b", _bucket(F.col("v"))).repartition(*keys, "_b")
    buckets = (
        kept.groupBy(*keys, "_s", "_b")
        .agg(F.sum("n").alias("_m"), F.first("_before").alias("_before"), F.first(total).alias(total))
        .withColumn("_start", F.col("_before") + F.sum("_m").over(W.partitionBy(*keys, "_s").orderBy("_b")) - F.col("_m"))
    )
    ranks = _ranks(probs, total)
    hit = buckets.where(_holds(ranks, F.col("_start"), F.col("_m"))).select(*keys, "_b", "_start")

    inside = W.partitionBy(*keys, "_b").orderBy("v")
    ranked = kept.join(hit, [*keys, "_b"]).withColumn(
        "_from", F.col("_start") + F.sum("n").over(inside) - F.col("n")
    )
    upto = F.col("_from") + F.col("n")
    aggs = [F.first(total).alias(total)]
    for name, (lo, hi, _) in ranks.items():
        aggs.append(F.max(F.when((lo >= F.col("_from")) & (lo < upto), F.col("v"))).alias(f"_lo_{name}"))
        aggs.append(F.max(F.when((hi >= F.col("_from")) & (hi < upto), F.col("v"))).alias(f"_hi_{name}"))
    out = ranked.groupBy(*keys).agg(*aggs)
    cols = [
        (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * frac).alias(n)
        for n, (_, _, frac) in ranks.items()
    ]
    return out.select(*keys, total, *cols)


def grouped_quantiles(
    df: DataFrame, keys: Sequence[str], value: Column, probs: dict[str, float], total: str = "n_values"
) -> DataFrame:
    return quantiles_of_counts(materialise(present_values(df, keys, value), "values"), keys, probs, total)


def median_and_mad(df: DataFrame, keys: Sequence[str], value: Column, extra: dict[str, float] | None = None,
                   total: str = "n_values") -> DataFrame:
    """Median, MAD and any ``extra`` quantiles per group, from one pass over the rows.

    The values are written once, without any other column, and serve every branch below; so is the result, which has a row per group.
    """
    keys = list(keys)
    values = materialise(present_values(df, keys, value), "values")
    centre = materialise(quantiles_of_counts(values, keys, {"med": 0.5, **(extra or {})}, total), "centres")
    deviations = values.join(centre.select(*keys, "med"), keys).select(*keys, F.abs(F.col("v") - F.col("med")).alias("v"), "n")
    mad = quantiles_of_counts(deviations, keys, {"mad": 0.5}, "_n_dev").drop("_n_dev")
    return materialise(centre.join(mad, keys), "quantiles")
