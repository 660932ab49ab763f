"""Flight-block bootstrap with hash-seeded draws.

A resample of n flights is a multinomial vector of multiplicities. The flights of a group lie in blocks of bounded size, and a draw is
split down a tree of blocks: each split gives one side a binomial share of the picks, in proportion to its flights. What
arrives at a block are its numbers of picks per draw; the picks themselves are made where the flights lie, as hashes of (seed, group,
draw, slot). So flights are shuffled once into their blocks, and after that only totals by block and draw move. A lost
executor recomputes the same resample. A group that fits one block has nothing to split.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..schemas import CELL
from ..session import materialise
from .elementary import blend

# Flights of a block; draws that one row of work covers.
BLOCK, DRAWS_PER_ROW = 1024, 100


def hashed_pick(seed: int, parts: Sequence[Column], n: Column) -> Column:
    text = F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % n


def split_picks(sizes: np.ndarray, picks: int, draws: int, rng: np.random.Generator) -> np.ndarray:
    """(draws, blocks) numbers of picks by conditional binomial splitting; each row is multinomial with shares ``sizes``."""
    before = np.append(0, np.cumsum(sizes))
    out = np.zeros((draws, len(sizes)), np.int64)
    todo = [(0, len(sizes), np.full(draws, picks, np.int64))]
    while todo:
        low, high, count = todo.pop()
        if high - low == 1:
            out[:, low] = count
            continue
        middle = (low + high) // 2
        left = rng.binomial(count, (before[middle] - before[low]) / (before[high] - before[low]))
        todo += [(low, middle, left), (middle, high, count - left)]
    return out


def _splitter(group: Sequence[str], draws: int, seed: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_block")
        digest = hashlib.md5("|".join(map(str, (seed, *key))).encode()).digest()
        last = min(int(key[-1]) + DRAWS_PER_ROW, draws)
        counts = split_picks(pdf["_m"].to_numpy(), int(pdf["_m"].sum()), last - int(key[-1]), np.random.default_rng(int.from_bytes(digest[:8], "big")))
        return pd.DataFrame({**{g: pdf[g] for g in group}, "_start": pdf["_start"], "_block": pdf["_block"], "_picks": list(counts.T)})
    return run


def blocks_of(flights: DataFrame, group: Sequence[str], order: Sequence[str], sums: Sequence[str], keep: Sequence[str] = (), block: int = BLOCK) -> DataFrame:
    """One row per (group, block): its flights in order as ``_rows``, ``_m`` of them, of ``_n`` in the group."""
    size = flights.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    pairs = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)]
    named = size.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], "_n")
    placed = flights.join(named, pairs).withColumn("_block", F.pmod(F.xxhash64(*order, F.lit("block")), F.ceil(F.col("_n") / block)).cast("int"))
    row = F.struct(*order, *[F.col(s).cast("double").alias(f"_{s}") for s in sums])
    whole = placed.groupBy(*group, "_block", "_n").agg(F.sort_array(F.collect_list(row)).alias("_rows"), *[F.first(k).alias(k) for k in keep])
    return whole.withColumn("_m", F.size("_rows").cast("long"))


def _totals(work: DataFrame, group: Sequence[str], keep: Sequence[str], sums: Sequence[str], draws: int, seed: int, label: Sequence[Column], picks: Callable) -> DataFrame:
    """(group, keep, draw) with the sums of the picked flights of every row of ``work`` (``_rows``, ``_m``, ``_start``)."""
    last = F.least(F.col("_start") + DRAWS_PER_ROW - 1, F.lit(draws - 1))

    def draw(d: Column) -> Column:
        count = picks(d)
        slots = F.when(count > 0, F.sequence(F.lit(0).cast("long"), count.cast("long") - 1)).otherwise(F.array().cast("array<bigint>"))
        chosen = F.transform(slots, lambda slot: hashed_pick(seed, [*label, d, slot], F.col("_m")).cast("int"))
        total = lambda at, s: F.aggregate(at, F.lit(0.0), lambda acc, i: acc + F.get(F.col("_rows"), i)[f"_{s}"])
        return F.transform(F.array(chosen), lambda at: F.struct(d.alias("draw"), *[total(at, s).alias(s) for s in sums]))[0]  # the picks are made once

    rows = F.transform(F.sequence(F.col("_start"), last), draw)
    return work.select(*group, *keep, F.explode(rows).alias("_t")).select(*group, *keep, "_t.draw", *[f"_t.{s}" for s in sums])


def resample(flights: DataFrame, group: Sequence[str], order: Sequence[str], sums: Sequence[str], draws: int, seed: int,
             keep: Sequence[str] = (), block: int = BLOCK) -> DataFrame:
    """(group, keep, draw) with the totals of ``sums`` over n flights drawn with replacement; ``keep`` are constants of a group."""
    group, keep = list(group), list(keep)
    starts = F.explode(F.sequence(F.lit(0), F.lit(draws - 1), F.lit(DRAWS_PER_ROW))).alias("_start")
    held = materialise(blocks_of(flights, group, order, sums, keep, block), "flight-blocks")
    # A few flights times many draws is much work in few rows, so rows are spread before draws are made.
    spark = flights.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spread = lambda df: df.repartition(tasks)
    alone = held.where(F.col("_m") == F.col("_n"))
    label = [F.col(g) for g in group]
    out = _totals(spread(alone.select("*", starts)), group, keep, sums, draws, seed, label, lambda d: F.col("_n"))
    shared = held.where(F.col("_m") < F.col("_n"))
    if shared.isEmpty():
        return out
    kinds = {f.name: f.dataType for f in held.schema.fields}
    schema = T.StructType([*[T.StructField(g, kinds[g]) for g in group], T.StructField("_start", T.IntegerType()), T.StructField("_block", T.IntegerType()),
                           T.StructField("_picks", T.ArrayType(T.LongType()))])
    picks = shared.select(*group, "_block", "_m", starts).groupBy(*group, "_start").applyInPandas(_splitter(group, draws, seed), schema)
    sides = picks.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_block").alias("_b"), "_start", "_picks")
    same = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)]
    work = shared.join(sides, [F.col("_block") == F.col("_b"), *same])
    parts = _totals(spread(work), group, keep, sums, draws, seed, [*label, F.col("_block")], lambda d: F.get(F.col("_picks"), d - F.col("_start")))
    return out.unionByName(parts.groupBy(*group, *keep, "draw").agg(*[F.sum(s).alias(s) for s in sums]))


def interval(stats: DataFrame, by: Sequence[str], level: float) -> DataFrame:
    """se and percentile bounds over the draws of each key (as many values as draws)."""
    alpha = (1 - level) / 2
    n = F.count("stat")
    q = F.percentile("stat", F.array(F.lit(alpha), F.lit(1 - alpha)))
    return (
        stats.groupBy(*by)
        .agg(F.when(n >= 2, F.stddev_samp("stat")).alias("se"), F.when(n >= 2, q).alias("_q"))
        .select(*by, "se", F.col("_q")[0].alias("ci_low"), F.col("_q")[1].alias("ci_high"))
    )


def headline_interval(blocks: DataFrame, cells: DataFrame, weights: DataFrame, draws: int = 500, seed: int = 7,
                      level: float = 0.90, adjust: bool = True) -> DataFrame:
    """Resample flights inside each live cell, rebuild the blend at observed availability, re-weight."""
    key = ["period", *CELL]
    live = weights.select(*key, "weight", "availability")
    usable = blocks.where((F.col("lr_n") > 0) | F.col("laf_lr").isNotNull())
    inputs = usable.select(
        *key, "flight_number",
        F.coalesce("lr_sum", F.lit(0.0)).alias("s"), F.col("lr_n").alias("c"),
        F.coalesce("laf_lr", F.lit(0.0)).alias("l"), F.col("laf_lr").isNotNull().cast("int").alias("h"))
    drawn = resample(inputs.join(live, key), key, ["flight_number"], ["s", "c", "l", "h"], draws, seed, keep=["weight", "availability"])
    matched = F.when(F.col("c") > 0, 100 * F.exp(F.col("s") / F.col("c")))
    laf = F.when(F.col("h") > 0, 100 * F.exp(F.col("l") / F.col("h")))
    value = blend(matched, laf, F.col("availability")) if adjust else matched
    stats = (
        drawn.withColumn("v", value)
        .where(F.col("v").isNotNull())
        .groupBy("period", "draw")
        .agg(F.when(F.sum("weight") > 0, F.sum(F.col("weight") * F.col("v")) / F.sum("weight")).alias("stat"))
    )
    return interval(stats, ["period"], level)


def transport(interval_df: DataFrame, smoothed: DataFrame, raw: DataFrame) -> DataFrame:
    """Move an interval of the unsmoothed headline onto the smoothed scale."""
    factor = F.coalesce(F.col("value") / F.nullif(F.col("value_unsmoothed"), F.lit(0.0)), F.lit(1.0))
    return (
        smoothed.join(raw.select("period", F.col("value").alias("value_unsmoothed")), "period", "left")
        .join(interval_df, "period", "left")
        .withColumn("_f", factor)
        .withColumn("se", F.col("se") * F.col("_f"))
        .withColumn("ci_low", F.col("ci_low") * F.col("_f"))
        .withColumn("ci_high", F.col("ci_high") * F.col("_f"))
        .drop("_f")
    )


def pooled_interval(blocks: DataFrame, draws: int = 200, seed: int = 7, level: float = 0.90) -> DataFrame:
    """All flights of a period pooled, unweighted; fewer than two blocks give no interval.

    The bounds are widened to hold the point value. The flight label includes its cell.
    """
    inputs = blocks.where(F.col("lr_n") > 0).select(
        "period", *CELL, "flight_number", F.col("lr_sum").alias("s"), F.col("lr_n").alias("c"))
    point = inputs.groupBy("period").agg(
        (100 * F.exp(F.sum("s") / F.sum("c"))).alias("value"), F.count(F.lit(1)).alias("n_blocks"))
    drawn = resample(inputs, ["period"], [*CELL, "flight_number"], ["s", "c"], draws, seed)
    stats = drawn.select("period", "draw", (100 * F.exp(F.col("s") / F.col("c"))).alias("stat"))
    enough = F.col("n_blocks") >= 2
    return (
        point.join(interval(stats, ["period"], level), "period", "left")
        .withColumn("se", F.when(enough, F.col("se")))
        .withColumn("ci_low", F.when(enough, F.least("ci_low", "value")))
        .withColumn("ci_high", F.when(enough, F.greatest("ci_high", "value")))
    )


def median(values: np.ndarray) -> float:
    return float(np.median(values))


def trimmed_mean(values: np.ndarray, share: float = 0.1) -> float:
    """Mean without the ``share`` smallest and greatest values."""
    cut = int(share * len(values))
    return float(np.sort(values)[cut:len(values) - cut].mean())


def estimated_interval(relatives: DataFrame, estimator: Callable[[np.ndarray], float], draws: int = 200, seed: int = 7, level: float = 0.90,
                       order: Sequence[str] = (*CELL, "flight_number"), value: str = "lr") -> DataFrame:
    """Interval of any estimator of pooled log relatives, flights resampled as in ``pooled_interval``.

    ``estimator`` maps the pooled sample of a period, repeats included, to a number; the index is 100 times its exponential. It runs in
    tasks, one per period and ``DRAWS_PER_ROW`` draws, over the period's flights. A period has as many rows here as there are matched products,
    however many quotes they had; an estimator that needs the whole sample needs them in one place.
    """
    held = relatives.where(F.col(value).isNotNull()).groupBy("period", *order).agg(F.sort_array(F.collect_list(value)).alias("_v"))
    kind = held.schema["period"].dataType
    out = T.StructType([T.StructField("period", kind), T.StructField("draw", T.IntegerType()), T.StructField("stat", T.DoubleType()), T.StructField("n_blocks", T.LongType())])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        period, start = key
        flights = [np.asarray(v, float) for v in pdf.sort_values(list(order))["_v"]]
        n, rows = len(flights), []
        if start == 0:
            rows.append((period, -1, estimator(np.concatenate(flights)), n))
        for draw in range(start, min(start + DRAWS_PER_ROW, draws)):
            picks = [int(hashlib.md5(f"{seed}|{period}|{draw}|{slot}".encode()).hexdigest()[:8], 16) % n for slot in range(n)]
            rows.append((period, draw, estimator(np.concatenate([flights[i] for i in picks])), n))
        return pd.DataFrame(rows, columns=out.fieldNames())

    starts = F.explode(F.sequence(F.lit(0), F.lit(draws - 1), F.lit(DRAWS_PER_ROW))).alias("_start")
    stats = materialise(held.select("*", starts).groupBy("period", "_start").applyInPandas(run, out), "estimates").withColumn("stat", 100 * F.exp("stat"))
    point = stats.where("draw = -1").select("period", F.col("stat").alias("value"), "n_blocks")
    enough = F.col("n_blocks") >= 2
    return point.join(interval(stats.where("draw >= 0"), ["period"], level), "period", "left").select(
        "period", "value", "n_blocks", F.when(enough, F.col("se")).alias("se"),
        F.when(enough, F.least("ci_low", "value")).alias("ci_low"), F.when(enough, F.greatest("ci_high", "value")).alias("ci_high"))
