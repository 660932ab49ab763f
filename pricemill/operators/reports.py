"""Aggregates behind the published views: components, availability, coverage, status, heatmap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..schemas import COMPONENTS
from .quality import published


def component_averages(quotes: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    rows = published(quotes)
    if start:
        rows = rows.where(F.col("collected_date") >= F.lit(start).cast("date"))
    if end:
        rows = rows.where(F.col("collected_date") <= F.lit(end).cast("date"))
    cols = [F.avg(c).alias(c) for c in (*COMPONENTS, "total_fare")]
    return rows.groupBy(F.col("collected_date").alias("period")).agg(*cols, F.count(F.lit(1)).alias("n"))


def availability_by_day(quotes: DataFrame, route: str | None = None) -> DataFrame:
    rows = quotes.where(F.col("route") == route) if route else quotes
    sold = F.col("is_sold_out").cast("int")
    return (
        rows.groupBy(F.col("collected_date").alias("period"))
        .agg(F.countDistinct(F.when(sold == 0, F.col("fare_family"))).alias("families_offered"),
             F.countDistinct("fare_family").alias("families_total"),
             F.sum(sold.cast("long")).alias("n_sold_out"),
             F.count(F.lit(1)).alias("n_quotes"))
        .withColumn("availability_ratio", F.round(F.col("families_offered") / F.col("families_total"), 4))
    )


def level_series(cells: DataFrame, route: str | None = None, apw_days: int | None = None) -> DataFrame:
    """Period means of matched, lowest-fare and adjusted levels over live cells."""
    rows = cells.where(~F.col("suppressed"))
    if route:
        rows = rows.where(F.col("route") == route)
    if apw_days is not None:
        rows = rows.where(F.col("apw_days") == apw_days)
    return (
        rows.groupBy("period")
        .agg(F.avg("matched").alias("matched"), F.avg("laf").alias("laf"),
             F.avg("adjusted_raw").alias("adjusted"), F.avg("adjusted").alias("adjusted_smoothed"),
             F.avg("availability").alias("availability"), F.sum("n_matched").alias("n_matched"),
             F.sum("n_quotes").alias("n_quotes"))
        .withColumn("matched_vs_adjusted", F.round(F.col("adjusted") - F.col("matched"), 4))
    )


def basket_coverage(basket: DataFrame, quotes: DataFrame) -> DataFrame:
    seen = quotes.groupBy("route").agg(
        F.count(F.lit(1)).alias("n_quotes"), F.min("collected_date").alias("first_seen"),
        F.max("collected_date").alias("last_seen"))
    return (
        basket.join(seen, "route", "left")
        .withColumn("n_quotes", F.coalesce("n_quotes", F.lit(0).cast("long")))
        .withColumn("collected", F.col("n_quotes") > 0)
    )


def coverage_rollup(basket: DataFrame, quotes: DataFrame) -> DataFrame:
    """Grand total and strata in one pass; the grand total has stratum ALL."""
    got = F.col("collected")
    return (
        basket_coverage(basket, quotes).rollup("stratum")
        .agg(
            F.count(F.lit(1)).alias("routes"),
            F.count_if(got).alias("collected"),
            F.sum("weight_wr").alias("weight"),
            F.round(100.0 * F.count_if(got) / F.count(F.lit(1)), 2).alias("by_count_pct"),
            F.round(100.0 * F.sum(F.when(got, F.col("weight_wr")).otherwise(0.0)) / F.sum("weight_wr"), 2).alias("by_weight_pct"),
            F.count_if(got & F.col("in_named_list")).alias("named_collected"),
            F.concat_ws(",", F.array_sort(F.collect_list(F.when(~got, F.col("route"))))).alias("uncollected"),
        )
        .withColumn("stratum", F.coalesce("stratum", F.lit("ALL")))
    )


def uncollected_routes(basket: DataFrame, quotes: DataFrame) -> DataFrame:
    # The seen side is folded to its few routes before it meets the basket.
    return basket.select("route").subtract(quotes.select("route").distinct())


def source_outcomes(ledger: DataFrame) -> DataFrame:
    o = F.col("outcome")
    return ledger.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_records"),
        F.sum("n_quotes").alias("n_quotes"),
        F.count_if(o == "OK").alias("n_ok"),
        F.count_if(o == "ROBOTS_BLOCKED").alias("n_robots_blocked"),
        F.count_if(o.isin("HARD_BLOCK", "CIRCUIT_OPEN")).alias("n_blocked"))


def store_status(quotes: DataFrame, basket: DataFrame) -> DataFrame:
    size = basket.agg(F.count(F.lit(1)).alias("n")).scalar()
    return quotes.agg(
        F.count(F.lit(1)).alias("n_quotes"), F.min("collected_date").alias("first_date"),
        F.max("collected_date").alias("last_date"), F.countDistinct("route").alias("n_routes"),
    ).withColumn("basket_pct", F.round(100.0 * F.col("n_routes") / size, 2))


def heatmap(cells: DataFrame, windows: Sequence[int]) -> DataFrame:
    """One cell per (route, window): live before suppressed, then most matches, then first carrier."""
    rank = F.struct(F.col("suppressed"), -F.col("n_matched"), F.col("carrier"))
    best = cells.groupBy("period", "route", "apw_days").agg(F.min_by("adjusted", rank).alias("v"))
    return best.groupBy("period", "route").pivot("apw_days", list(windows)).agg(F.first("v"))


def headline_kpis(headline: DataFrame, cells: DataFrame) -> DataFrame:
    per = cells.groupBy("period").agg(F.count_if(~F.col("suppressed")).alias("n_cells"))
    joined = headline.join(per, "period", "left")
    first, last = F.min_by("value", "period"), F.max_by("value", "period")
    return joined.agg(
        F.max("period").alias("latest_period"), last.alias("latest_value"),
        (100 * (last / first - 1)).alias("change_pct"), F.count(F.lit(1)).alias("n_periods"),
        F.max_by("coverage_pct", "period").alias("coverage_pct"), F.max_by("n_cells", "period").alias("latest_cells"))


def series(index_values: DataFrame, code: str, frequency: str, basis: str, preset: str,
           start: str | None = None, end: str | None = None) -> DataFrame:
    keep: Column = ((F.col("index_code") == code) & (F.col("frequency") == frequency)
                    & (F.col("basis") == basis) & (F.col("omega_preset") == preset))
    if start:
        keep = keep & (F.col("period") >= F.lit(start).cast("date"))
    if end:
        keep = keep & (F.col("period") <= F.lit(end).cast("date"))
    return index_values.where(keep).orderBy("period")


def subseries(index_values: DataFrame, code: str, route: str | None = None) -> DataFrame:
    """Route and window detail rows, their keys read back from the code."""
    tail = F.col("index_code")
    rows = index_values.where(tail.startswith(f"{code}:"))
    if route:
        rows = rows.where(tail.startswith(f"{code}:route={route}:"))
    return (
        rows.withColumn("route", F.nullif(F.regexp_extract(tail, r":route=([^:]+)", 1), F.lit("")))
        .withColumn("apw_days", F.regexp_extract(tail, r":apw=(\d+)", 1).try_cast("int"))
    )


def traffic_weights(traffic: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Route and within-route carrier shares from passenger counts; an unknown carrier is UN."""
    from pyspark.sql import Window as W
    rows = traffic.withColumn("carrier", F.coalesce("carrier", F.lit("UN")))
    per = rows.groupBy("route", "carrier").agg(F.sum("passengers").alias("pax"))
    carriers = per.withColumn("phi", F.col("pax") / F.sum("pax").over(W.partitionBy("route")))
    total = traffic.agg(F.sum("passengers").alias("t")).scalar()
    routes = traffic.groupBy("route").agg(F.sum("passengers").alias("pax")).withColumn("w", F.col("pax") / total)
    return routes, carriers


def derived_weights(routes: DataFrame, carriers: DataFrame, override: DataFrame | None = None,
                    stage_prior: str | None = None) -> DataFrame:
    """phi from share x seats x load factor (x a stage prior), w from passengers; an override wins whole."""
    from pyspark.sql import Window as W
    if override is not None and not override.isEmpty():
        return override
    prior = F.col(stage_prior) if stage_prior else F.lit(1.0)
    mass = prior * F.col("share") * F.col("seats") * F.col("load_factor")
    total = routes.agg(F.sum("passengers").alias("t")).scalar()
    return (
        routes.join(carriers, "route")
        .withColumn("mass", mass)
        .withColumn("phi", F.col("mass") / F.sum("mass").over(W.partitionBy("route")))
        .withColumn("w", F.col("passengers") / total)
        .select("route", "carrier", "phi", "w")
    )


def latest_run(runs: DataFrame) -> DataFrame:
    done = runs.where(F.col("status") == "completed")
    return done.agg(F.max_by(F.struct(*runs.columns), F.struct("completed_at", "run_id")).alias("_r")).select("_r.*")


def synthetic_stamp(df: DataFrame) -> DataFrame:
    return df.agg(F.max(F.col("is_synthetic").cast("int")).alias("is_synthetic"),
                  F.max("method_version").alias("method_version"))
