"""Smoothing, the three weighted stages, roll-ups and linking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.scalars import geo_mean, positive_ln
from ..params import checked_link
from ..schemas import CELL


def smooth(cells: DataFrame, by: Sequence[str] = (), window: int = 7) -> DataFrame:
    """Centred geometric moving average by row; keeps the unsmoothed level as ``adjusted_raw``."""
    out = cells.withColumn("adjusted_raw", F.col("adjusted"))
    if window <= 1:
        return out
    half = window // 2
    near = W.partitionBy(*by, *CELL).orderBy("period").rowsBetween(-half, half)
    return out.withColumn("adjusted", F.exp(F.avg(positive_ln(F.col("adjusted_raw"))).over(near)))


def _weighted(weight: str, value: str) -> Column:
    """Weighted mean renormalised over what is present; plain mean when no weight is known."""
    w, v = F.col(weight), F.col(value)
    return F.when(F.sum(w) > 0, F.sum(w * v) / F.sum(w)).otherwise(F.avg(v))


def carrier_stage(cells: DataFrame, phi: DataFrame, by: Sequence[str] = (), value: str = "adjusted") -> DataFrame:
    live = cells.where(~F.col("suppressed") & F.col(value).isNotNull())
    return (
        live.join(phi, ["route", "carrier"], "left")
        .withColumn("phi", F.coalesce("phi", F.lit(0.0)))
        .groupBy(*by, "period", "route", "apw_days")
        .agg(
            _weighted("phi", value).alias("value"),
            F.count(F.lit(1)).alias("n_carriers"),
            F.sum("n_matched").alias("n_matched"),
            F.sum("phi").alias("carrier_weight_sum"),
        )
    )


def route_stage(by_route: DataFrame, weights: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Coverage is the surviving share of the whole basket's weight, not of what survived."""
    full = weights.agg(F.sum("w").alias("full")).scalar()
    return (
        by_route.join(weights, "route", "left")
        .withColumn("w", F.coalesce("w", F.lit(0.0)))
        .groupBy(*by, "period", "apw_days")
        .agg(
            _weighted("w", "value").alias("value"),
            F.count(F.lit(1)).alias("n_routes"),
            F.sum("n_matched").alias("n_matched"),
            F.sum("w").alias("_got"),
        )
        .withColumn("coverage_pct", F.try_divide(100 * F.col("_got"), F.nullif(full, F.lit(0.0))))
        .drop("_got")
    )


def lead_stage(by_apw: DataFrame, omega: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The headline. ``omega`` is (omega_preset, apw_days, omega); every preset yields a series."""
    presets = omega.groupBy(F.lit(1).alias("_one")).agg(F.array_sort(F.collect_set("omega_preset")).alias("p"))
    stacked = by_apw.withColumn("omega_preset", F.explode(presets.select("p").scalar()))
    got = F.sum("omega")
    return (
        stacked.join(omega, ["omega_preset", "apw_days"], "left")
        .withColumn("omega", F.coalesce("omega", F.lit(0.0)))
        .groupBy(*by, "omega_preset", "period")
        .agg(
            _weighted("omega", "value").alias("value"),
            F.count(F.lit(1)).alias("n_apw"),
            F.sum("n_matched").alias("n_matched"),
            F.avg("coverage_pct").alias("coverage_pct"),
            F.when(got > 0, got).otherwise(1.0).alias("omega_covered"),
        )
    )


def effective_weights(cells: DataFrame, phi: DataFrame, weights: DataFrame, omega: DataFrame,
                      by: Sequence[str] = (), value: str = "adjusted") -> DataFrame:
    """The three stages folded into one weight per live cell; they sum to one in each period."""
    by = [*by, "period"]
    live = cells.where(~F.col("suppressed") & F.col(value).isNotNull())

    def share(df: DataFrame, weight: str, within: Sequence[str], out: str) -> DataFrame:
        group = W.partitionBy(*within)
        total = F.sum(weight).over(group)
        return df.withColumn(out, F.when(total > 0, F.col(weight) / total).otherwise(
            1.0 / F.count(F.lit(1)).over(group)))

    def known(df: DataFrame, table: DataFrame, on: Sequence[str], col: str) -> DataFrame:
        return df.join(table, list(on), "left").withColumn(col, F.coalesce(col, F.lit(0.0)))

    carriers = share(known(live, phi, ["route", "carrier"], "phi"), "phi", [*by, "apw_days", "route"], "_c")
    routes = live.select(*by, "apw_days", "route").distinct()
    routes = share(known(routes, weights, ["route"], "w"), "w", [*by, "apw_days"], "_r").drop("w")
    windows = live.select(*by, "apw_days").distinct()
    windows = share(known(windows, omega.select("apw_days", "omega"), ["apw_days"], "omega"), "omega", by, "_o").drop("omega")
    return (
        carriers.join(routes, [*by, "apw_days", "route"])
        .join(windows, [*by, "apw_days"])
        .withColumn("weight", F.col("_c") * F.col("_r") * F.col("_o"))
        .drop("phi", "_c", "_r", "_o")
    )


def headline_counts(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return cells.groupBy(*by, "period").agg(
        F.count_if(~F.col("suppressed")).alias("n_cells"), F.sum("n_quotes").alias("n_quotes"))


def diagnostics(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    bad, n = F.count_if("suppressed"), F.count(F.lit(1))
    return cells.groupBy(*by).agg(
        F.countDistinct("period").alias("n_periods"),
        n.alias("n_cells"),
        bad.alias("n_suppressed"),
        F.round(100.0 * bad / F.greatest(n, F.lit(1)), 2).alias("suppression_pct"),
        F.round(F.avg("availability"), 4).alias("mean_availability"),
    )


def to_frequency(series: DataFrame, frequency: str, by: Sequence[str] = ()) -> DataFrame:
    """Monday weeks or calendar months; geometric mean of the positive levels."""
    unit = {"weekly": "week", "monthly": "month", "quarterly": "quarter", "yearly": "year"}[frequency]
    return (
        series.withColumn("period", F.date_trunc(unit, F.col("period")).cast("date"))
        .groupBy(*by, "period")
        .agg(
            geo_mean(F.col("value")).alias("value"),
            F.sum("n_matched").alias("n_matched"),
            F.count(F.lit(1)).alias("n_days"),
            F.avg("coverage_pct").alias("coverage_pct"),
        )
    )


def to_frequency_run(series: DataFrame, frequency: str, by: Sequence[str] = ()) -> DataFrame:
    """The run-versioned variant: errors averaged, counts summed, no interval, empty buckets dropped."""
    unit = {"weekly": "week", "monthly": "month", "quarterly": "quarter", "yearly": "year"}[frequency]
    return (
        series.withColumn("period", F.date_trunc(unit, F.col("period")).cast("date"))
        .groupBy(*by, "period")
        .agg(
            geo_mean(F.col("value")).alias("value"),
            F.avg("se").alias("se"),
            F.sum("n_matched").alias("n_matched"),
            F.sum("n_quotes").alias("n_quotes"),
            F.sum("n_cells").alias("n_cells"),
            F.max("n_apw").alias("n_apw"),
            F.max("omega_covered").alias("omega_covered"),
            F.avg("coverage_pct").alias("coverage_pct"),
        )
        .where(F.col("value").isNotNull())
        .withColumn("ci_low", F.lit(None).cast("double"))
        .withColumn("ci_high", F.lit(None).cast("double"))
    )


def link(df: DataFrame, factor: float, levels: Sequence[str] = ("value",)) -> DataFrame:
    """Multiply every published level by factor/100; the measured level stays as value_native."""
    scale = checked_link(factor) / 100.0
    out = df.withColumn("value_native", F.col(levels[0]))
    for c in levels:
        out = out.withColumn(c, F.col(c) * F.lit(scale))
    return out


def withhold_thin(headline: DataFrame, minimum: float = 0.60) -> DataFrame:
    return headline.where(F.coalesce(F.col("omega_covered"), F.lit(0.0)) >= minimum)


def withheld_count(headline: DataFrame, minimum: float = 0.60, by: Sequence[str] = ()) -> DataFrame:
    thin = F.coalesce(F.col("omega_covered"), F.lit(0.0)) < minimum
    return headline.groupBy(*by).agg(
        F.count_if(thin).alias("n_withheld"), F.count_if(~thin).alias("n_published"))


def adjacent_elasticity(by_apw: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Slope of log index on log lead time between neighbouring windows, and from one day to the farthest."""
    by = [*by, "period"]
    w = W.partitionBy(*by).orderBy("apw_days")
    whole = W.partitionBy(*by)
    li, lt = F.ln("value"), F.ln(F.col("apw_days").cast("double"))
    ends = F.struct(F.col("apw_days"), li.alias("li"), lt.alias("lt"))
    far, near = F.max(ends).over(whole), F.max(F.when(F.col("apw_days") == 1, ends)).over(whole)
    return (
        by_apw.where(F.col("value") > 0)
        .withColumn("next_apw", F.lead("apw_days").over(w))
        .withColumn("eta", (F.lead(li).over(w) - li) / (F.lead(lt).over(w) - lt))
        .withColumn("eta_near_far", F.try_divide(far["li"] - near["li"], F.nullif(far["lt"] - near["lt"], F.lit(0.0))))
        .where(F.col("next_apw").isNotNull())
        .select(*by, "apw_days", "next_apw", "eta", "eta_near_far")
    )
