"""Validity gates, robust outlier labels, the jump test and dispositions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.quantiles import grouped_quantiles, median_and_mad
from ..functions.scalars import positive_ln
from ..params import APW_WINDOWS, FARE_CEILING, MAD_TO_SIGMA, SIGMA_PER_MAD
from ..schemas import CABINS, CELL, FARE_LINE, PRODUCT
from ..session import materialise

CELL_DAY = [*CELL, "collected_date"]


def validity_gates(df: DataFrame, distances: DataFrame | None = None,
                   windows: Sequence[int] = APW_WINDOWS) -> DataFrame:
    """Deterministic rejects; the first reason that applies is the one recorded."""
    def part(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(0.0)) if c in df.columns else F.lit(0.0)

    total = F.col("total_fare")
    statutory = part("udf") + part("asf") + part("rcs_levy")
    reason = (
        F.when(total.isNull() | (total <= 0), "NONPOSITIVE_FARE")
        .when(total < statutory, "BELOW_STATUTORY_FLOOR")
        .when(F.col("currency").isNull() | (F.col("currency") != "INR"), "NON_INR_CURRENCY")
        .when(F.col("apw_days").isNull() | ~F.col("apw_days").isin(list(windows)), "APW_NOT_IN_WINDOW_SET")
        .when(F.col("cabin").isNull() | ~F.col("cabin").isin(CABINS), "BAD_CABIN")
    )
    out = df
    if distances is not None:
        out = out.join(distances.select("route", F.col("km").alias("_km")), "route", "left")
        expected = 900 + 1.6 * F.coalesce(F.col("_km"), F.lit(1000.0))
        reason = reason.when((total < 0.35 * expected) | (total > FARE_CEILING), "IMPLAUSIBLE_FOR_DISTANCE")
    out = out.withColumn("gate_reason", F.coalesce(reason, F.lit("")))
    return out.withColumn("gate_failed", F.col("gate_reason") != "").drop("_km")


def cell_day_stats(df: DataFrame, value: Column) -> DataFrame:
    """Quartiles, median and MAD per cell and collection date."""
    return median_and_mad(df, CELL_DAY, value, {"q1": 0.25, "q3": 0.75})


def flag_outliers(df: DataFrame, tukey_k: float = 3.0, hampel_z: float = 3.5, price: str = "price_T") -> DataFrame:
    """Tukey fences and a MAD filter on log prices within the cell-day, four values or more."""
    y = positive_ln(F.col(price))
    stats = cell_day_stats(df, y).where(F.col("n_values") >= 4)
    spread = F.col("q3") - F.col("q1")
    out = (
        df.join(stats, CELL_DAY, "left")
        .withColumn("_y", y)
        .withColumn("fence_low", F.col("q1") - tukey_k * spread)
        .withColumn("fence_high", F.col("q3") + tukey_k * spread)
    )
    tukey = (F.col("_y") < F.col("fence_low")) | (F.col("_y") > F.col("fence_high"))
    score = F.when(F.col("mad") > 0, MAD_TO_SIGMA * (F.col("_y") - F.col("med")) / F.col("mad"))
    out = out.withColumn("tukey_hit", F.coalesce(tukey, F.lit(False))).withColumn(
        "hampel_hit", F.coalesce(F.abs(score) > hampel_z, F.lit(False)))
    blank = F.col("gate_reason") == "" if "gate_reason" in df.columns else F.lit(True)
    before = F.col("gate_reason") if "gate_reason" in df.columns else F.lit("")
    flagged = F.when((F.col("tukey_hit") | F.col("hampel_hit")) & blank, "OUTLIER_CELL").otherwise(before)
    return out.withColumn("quality_flag", flagged).drop("q1", "q3", "med", "mad", "n_values")


def price_space_flags(df: DataFrame, tukey_k: float = 3.0, hampel_z: float = 3.5, price: str = "total_fare") -> DataFrame:
    """The raw-price variant: Tukey needs four values, Hampel three; zero MAD collapses the bounds."""
    stats = cell_day_stats(df, F.col(price))
    p, spread = F.col(price), F.col("q3") - F.col("q1")
    scale = SIGMA_PER_MAD * F.col("mad")
    enough_tukey, enough_hampel = F.col("n_values") >= 4, F.col("n_values") >= 3
    low, high = F.col("q1") - tukey_k * spread, F.col("q3") + tukey_k * spread
    half = hampel_z * scale
    return (
        df.join(stats, CELL_DAY, "left")
        .withColumn("tukey_low", F.when(enough_tukey, low))
        .withColumn("tukey_high", F.when(enough_tukey, high))
        .withColumn("tukey_hit", F.coalesce(enough_tukey & ((p < low) | (p > high)), F.lit(False)))
        .withColumn("hampel_hit", F.coalesce(
            enough_hampel & ((p < F.col("med") - half) | (p > F.col("med") + half)), F.lit(False)))
        .drop("q1", "q3", "med", "mad", "n_values")
    )


def daily_moves(df: DataFrame, price: str = "price_T") -> DataFrame:
    """|change in log price| of each fare line since its previous collection date.

    The input is folded to one row per fare line and date first, so the window below sees at most
    one row per date however many quotes a fare line holds. The moves are written: their spread reads them too.
    """
    daily = df.groupBy(*FARE_LINE, "collected_date").agg(F.avg(positive_ln(F.col(price))).alias("ly"))
    prev = F.lag("ly").over(W.partitionBy(*FARE_LINE).orderBy("collected_date"))
    return materialise(daily.withColumn("jump", F.abs(F.col("ly") - prev)), "daily-moves")


def jump_hits(df: DataFrame, sigma: float = 3.0, price: str = "price_T") -> DataFrame:
    """Fare lines and dates whose move exceeds sigma times the spread of moves in their cell."""
    moves = daily_moves(df, price)
    spread = materialise(
        moves.groupBy(*CELL)
        .agg(F.count("jump").alias("_n"), F.stddev_samp("jump").alias("_sd"))
        .select(*CELL, F.when(F.col("_n") > 2, F.col("_sd")).alias("jump_sigma")), "move-spread")
    return (
        moves.join(spread, CELL)
        .withColumn("is_jump", F.coalesce(F.col("jump") > sigma * F.col("jump_sigma"), F.lit(False)))
    )


def flag_jumps(df: DataFrame, sigma: float = 3.0, price: str = "price_T", history: DataFrame | None = None) -> DataFrame:
    """Mark rows of ``df`` whose fare line jumps in ``history`` (``df`` itself unless given).

    The jumps, few beside the rows, are written, so that the join knows their size.
    """
    hits = jump_hits(df if history is None else history, sigma, price).where("is_jump").select(*FARE_LINE, "collected_date", "is_jump")
    hits = materialise(hits, "jumps")
    return (
        df.join(hits, [*FARE_LINE, "collected_date"], "left")
        .withColumn("quality_flag", F.when(F.col("is_jump") & (F.col("quality_flag") == ""), "LONGITUDINAL_JUMP")
                    .otherwise(F.col("quality_flag")))
        .drop("is_jump")
    )


def assign_dispositions(df: DataFrame, price: str = "price_T") -> DataFrame:
    """Label every row; extremes are pulled to the fence, nothing is deleted."""
    sold = F.coalesce(F.col("is_sold_out"), F.lit(False)) if "is_sold_out" in df.columns else F.lit(False)
    flag = F.when(sold, "SOLD_OUT").otherwise(F.col("quality_flag"))
    label = (
        F.when(sold, "QUARANTINED")
        .when(F.col("gate_failed"), "EXCLUDED")
        .when(flag == "OUTLIER_CELL", "WINSORISED")
        .when(flag == "LONGITUDINAL_JUMP", "QUARANTINED")
        .otherwise("ACCEPTED")
    )
    pulled = F.exp(F.least(F.greatest(F.col("_y"), F.col("fence_low")), F.col("fence_high")))
    capped = F.col("disposition") == "WINSORISED"
    fee = F.coalesce(F.col("convenience_fee"), F.lit(0.0)) if price == "price_T" and "convenience_fee" in df.columns else F.lit(0.0)
    return (
        df.withColumn("disposition", label)
        .withColumn("quality_flag", F.nullif(flag, F.lit("")))
        .withColumn(price, F.when(capped, pulled).otherwise(F.col(price)))
        .withColumn("total_fare_capped", F.when(capped, F.col(price) + fee))
        .drop("_y")
    )


def clean(df: DataFrame, distances: DataFrame | None = None, tukey_k: float = 3.0, hampel_z: float = 3.5,
          jump_sigma: float = 3.0, windows: Sequence[int] = APW_WINDOWS, price: str = "price_T", earlier: DataFrame | None = None,
          written: bool = False) -> DataFrame:
    """Gates, outliers, jumps and dispositions. The gated rows feed several branches: they are written once.

    ``earlier`` holds the stored prices of this batch's cells (``stored_prices``), for the jump test.
    ``written`` says that ``df`` is made row by row from a written table: then the branches read that table, and gates are judged in passing.
    """
    gated = validity_gates(df, distances, windows)
    if not written:
        gated = materialise(gated, "gated")
    flagged = flag_outliers(gated, tukey_k, hampel_z, price)
    history = gated.select(*FARE_LINE, "collected_date", price)
    if earlier is not None:
        history = history.unionByName(earlier.select(*FARE_LINE, "collected_date", price))
    return assign_dispositions(flag_jumps(flagged, jump_sigma, price, history), price)


def stored_prices(store: DataFrame, batch: DataFrame) -> DataFrame:
    """Prices of all stored rows in the cells of ``batch``, as they were before winsorising, without rows that ``batch`` repeats.

    Rows of any disposition count, as they do within a batch: after a move that stays, only its first day is a jump.
    """
    key = [*PRODUCT, "collected_date", "source"]
    kept = store.join(batch.select(*CELL).distinct(), CELL, "left_semi").join(batch.select(*key).distinct(), key, "left_anti")
    before = F.col("total_fare") - F.coalesce(F.col("convenience_fee"), F.lit(0.0))
    return kept.select(*FARE_LINE, "collected_date", before.alias("price_T"))


def disposition_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("disposition").agg(F.count(F.lit(1)).alias("n"))
