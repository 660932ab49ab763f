"""The data-quality contract: every check yields one row (class, name, severity, passed, observed)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.quantiles import grouped_quantiles
from ..functions.scalars import positive_ln
from ..schemas import CABINS, CELL, COMPONENTS, DISPOSITIONS, PRODUCT, PUBLISHABLE, REQUIRED_QUOTE_COLUMNS

BLOCK, ALERT, QUARANTINE = "BLOCK", "ALERT", "QUARANTINE"
SPREAD_KEY = ["collected_date", "route", "carrier", "flight_number", "apw_days", "fare_family"]


class PublicationBlocked(RuntimeError):
    """A BLOCK check failed; nothing may be written."""


def result(df: DataFrame, check_class: str, name: str, severity: str, passed: Column, observed: Column) -> DataFrame:
    return df.select(
        F.lit(check_class).alias("check_class"),
        F.lit(name).alias("check_name"),
        F.lit(severity).alias("severity"),
        F.coalesce(passed, F.lit(False)).alias("passed"),
        observed.cast("double").alias("observed"),
    )


def required_columns(df: DataFrame, spark: SparkSession | None = None,
                     columns: Sequence[str] = (*REQUIRED_QUOTE_COLUMNS, "disposition")) -> DataFrame:
    """Compares schemas only; no data is read."""
    missing = [c for c in columns if c not in df.columns]
    one = (spark or df.sparkSession).range(1)
    return result(one, "schema", "required_columns_present", BLOCK, F.lit(not missing), F.lit(len(missing)))


def required_column_values(df: DataFrame, columns: Sequence[str] = (*REQUIRED_QUOTE_COLUMNS, "disposition")) -> DataFrame:
    """(column, present, n_values) for every required column, from one scan; a column that isn't there has no values."""
    counts = df.agg(*[(F.count(F.col(c)) if c in df.columns else F.lit(0)).cast("long").alias(c) for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(c in df.columns).alias("present"), F.col(c).alias("n_values")) for c in columns])
    return counts.select(F.explode(rows).alias("_c")).select("_c.*")


def non_empty(df: DataFrame) -> DataFrame:
    n = df.agg(F.count(F.lit(1)).alias("n"))
    return result(n, "completeness", "batch_non_empty", BLOCK, F.col("n") > 0, F.col("n"))


def domain(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """Distinct values of the column outside the allowed set."""
    outside = df.select(column).where(F.col(column).isNotNull()).distinct().where(~F.col(column).isin(list(allowed)))
    n = outside.agg(F.count(F.lit(1)).alias("n"))
    return result(n, "schema", f"{column}_domain", BLOCK, F.col("n") == 0, F.col("n"))


def disposition_domain(df: DataFrame) -> DataFrame:
    return domain(df, "disposition", DISPOSITIONS)


def cabin_domain(df: DataFrame) -> DataFrame:
    return domain(df, "cabin", CABINS)


def published(df: DataFrame) -> DataFrame:
    return df.where(F.col("disposition").isin(PUBLISHABLE))


def fare_range(df: DataFrame) -> DataFrame:
    good = (F.col("base_fare") > 0) & (F.col("base_fare") < F.col("total_fare"))
    n = published(df).agg(F.count_if(~F.coalesce(good, F.lit(False))).alias("n"))
    return result(n, "range", "0_lt_base_lt_total", BLOCK, F.col("n") == 0, F.col("n"))


def component_sum(df: DataFrame, tolerance: float = 1.0) -> DataFrame:
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in COMPONENTS[1:]), F.coalesce(F.col(COMPONENTS[0]), F.lit(0.0)))
    worst = published(df).agg(F.max(F.abs(F.col("total_fare") - total)).alias("m"))
    seen = F.coalesce(F.col("m"), F.lit(0.0))
    return result(worst, "arithmetic", "components_resum_to_total", BLOCK, seen <= tolerance, F.round(seen, 4))


def unique_key(df: DataFrame) -> DataFrame:
    per_key = df.groupBy(*PRODUCT, "collected_date", "source").agg((F.count(F.lit(1)) - 1).alias("extra"))
    n = per_key.agg(F.coalesce(F.sum("extra"), F.lit(0)).alias("n"))
    return result(n, "uniqueness", "no_duplicate_product_date_source", BLOCK, F.col("n") == 0, F.col("n"))


def stale_routes(df: DataFrame, basket: DataFrame) -> DataFrame:
    """Basket routes without a quote on the latest collection date."""
    latest = df.agg(F.max("collected_date").alias("d")).scalar()
    seen = df.where(F.col("collected_date") == latest).select("route").distinct()
    return basket.select("route").join(seen, "route", "left_anti")


def freshness(df: DataFrame, basket: DataFrame) -> DataFrame:
    n = stale_routes(df, basket).agg(F.count(F.lit(1)).alias("n"))
    return result(n, "freshness", "every_basket_route_quoted_today", ALERT, F.col("n") == 0, F.col("n"))


def cell_days(df: DataFrame) -> DataFrame:
    return published(df).groupBy(*CELL, "collected_date").agg(F.count(F.lit(1)).alias("n"))


def fill_rate(df: DataFrame, target: float = 0.80) -> DataFrame:
    days = cell_days(df)
    full = days.agg(F.max("n").alias("m")).scalar()
    n = days.agg(F.count_if(F.col("n") / full < target).alias("below"))
    return result(n, "completeness", "cell_fill_rate", ALERT, F.col("below") == 0, F.col("below"))


def far_from_median(df: DataFrame, price: str = "price_T", sigmas: float = 4.0) -> DataFrame:
    """Published quotes further than ``sigmas`` standard deviations from their cell median, in logs."""
    pub = published(df)
    y = positive_ln(F.col(price))
    centre = grouped_quantiles(pub, CELL, y, {"med": 0.5}).select(*CELL, "med")
    spread = pub.groupBy(*CELL).agg(F.stddev_samp(y).alias("sd"))
    stats = centre.join(spread, CELL).where(F.col("sd") > 0)
    return pub.withColumn("_y", y).join(stats, CELL).where(F.abs(F.col("_y") - F.col("med")) > sigmas * F.col("sd"))


def distribution(df: DataFrame, price: str = "price_T") -> DataFrame:
    n = far_from_median(df, price).agg(F.count(F.lit(1)).alias("n"))
    return result(n, "distributional", "cell_median_within_4_sigma", QUARANTINE, F.col("n") == 0, F.col("n"))


def chain_intact(ledger: DataFrame) -> DataFrame:
    from .ledger import chain_summary
    s = chain_summary(ledger)
    return result(s, "referential", "provenance_hash_chain_intact", BLOCK, F.col("n_broken") == 0, F.col("first_broken_seq"))


def unresolved(df: DataFrame, ledger: DataFrame, key: str = "provenance_id") -> DataFrame:
    return df.join(ledger.select(key), key, "left_anti")


def provenance_resolves(df: DataFrame, ledger: DataFrame, key: str = "provenance_id") -> DataFrame:
    n = unresolved(df, ledger, key).agg(F.count(F.lit(1)).alias("n"))
    return result(n, "referential", "every_provenance_id_resolves", BLOCK, F.col("n") == 0, F.col("n"))


def cross_source_spread(df: DataFrame, price: str = "price_T") -> DataFrame:
    """(max - min) / min in percent where a fare line was quoted more than once on a date."""
    return (
        published(df).groupBy(*SPREAD_KEY)
        .agg(F.min(price).alias("low"), F.max(price).alias("high"), F.count(price).alias("n_quotes"),
             F.countDistinct("source").alias("n_sources"))
        .where("n_quotes > 1")
        .withColumn("spread_pct", 100 * (F.col("high") - F.col("low")) / F.col("low"))
    )


def cross_source(df: DataFrame, price: str = "price_T", limit: float = 5.0) -> DataFrame:
    """Passes when only one source is live."""
    sources = published(df).agg(F.countDistinct("source").alias("k")).scalar()
    worst = cross_source_spread(df, price).agg(F.max("spread_pct").alias("m"))
    seen = F.when(sources > 1, F.col("m"))
    return result(worst, "cross_source", "same_flight_within_5pct", ALERT,
                  F.coalesce(seen <= limit, F.lit(True)), F.round(seen, 3))


def row_checks(df: DataFrame) -> DataFrame:
    """Every check that is one aggregate over rows, from a single scan."""
    pub = F.col("disposition").isin(PUBLISHABLE)
    has_fares = {"base_fare", "total_fare"} <= set(df.columns)
    has_parts = {*COMPONENTS, "total_fare"} <= set(df.columns)
    good = (F.col("base_fare") > 0) & (F.col("base_fare") < F.col("total_fare")) if has_fares else F.lit(True)
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in COMPONENTS), F.lit(0.0)) if has_parts else F.lit(0.0)
    gap = F.abs(F.col("total_fare") - total) if has_parts else F.lit(0.0)

    def outside(column: str, allowed: Sequence[str]) -> Column:
        return F.countDistinct(F.when(~F.col(column).isin(list(allowed)), F.col(column)))

    one = df.agg(
        F.count(F.lit(1)).alias("n"), outside("disposition", DISPOSITIONS).alias("bad_disposition"),
        outside("cabin", CABINS).alias("bad_cabin"), F.count_if(pub & ~F.coalesce(good, F.lit(False))).alias("bad_range"),
        F.round(F.coalesce(F.max(F.when(pub, gap)), F.lit(0.0)), 4).alias("worst_gap"))
    rows = [
        ("completeness", "batch_non_empty", F.col("n") > 0, F.col("n")),
        ("schema", "disposition_domain", F.col("bad_disposition") == 0, F.col("bad_disposition")),
        ("schema", "cabin_domain", F.col("bad_cabin") == 0, F.col("bad_cabin")),
    ]
    if has_fares:
        rows.append(("range", "0_lt_base_lt_total", F.col("bad_range") == 0, F.col("bad_range")))
    if has_parts:
        rows.append(("arithmetic", "components_resum_to_total", F.col("worst_gap") <= 1.0, F.col("worst_gap")))
    listed = F.array(*[F.struct(F.lit(c).alias("check_class"), F.lit(n).alias("check_name"), F.lit(BLOCK).alias("severity"),
                                p.alias("passed"), o.cast("double").alias("observed")) for c, n, p, o in rows])
    return one.select(F.explode(listed).alias("_c")).select("_c.*")


def contract(df: DataFrame, basket: DataFrame | None = None, ledger: DataFrame | None = None) -> DataFrame:
    """All checks that the batch has columns for, as one table."""
    schema = required_columns(df)
    if any(c not in df.columns for c in (*REQUIRED_QUOTE_COLUMNS, "disposition")):
        return schema
    checks = [schema, row_checks(df)]
    if "source" in df.columns:
        checks.append(unique_key(df))
    if basket is not None:
        checks.append(freshness(df, basket))
    checks.append(fill_rate(df))
    if "price_T" in df.columns:
        checks.append(distribution(df))
        if "source" in df.columns:
            checks.append(cross_source(df))
    if ledger is not None:
        checks.append(chain_intact(ledger))
        if "provenance_id" in df.columns:
            checks.append(provenance_resolves(df, ledger))
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def summarise(checks: DataFrame) -> DataFrame:
    failed = ~F.col("passed")
    return checks.agg(
        F.count(F.lit(1)).alias("n_checks"),
        F.count_if("passed").alias("n_passed"),
        F.count_if(failed).alias("n_failed"),
        F.concat_ws(",", F.array_sort(F.collect_list(F.when(failed & (F.col("severity") == BLOCK), F.col("check_name"))))).alias("blocking"),
        F.concat_ws(",", F.array_sort(F.collect_list(F.when(failed & (F.col("severity") == ALERT), F.col("check_name"))))).alias("alerts"),
    )


def enforce(checks: DataFrame) -> None:
    """Raise before any write; the check table has a dozen rows."""
    names = [r["check_name"] for r in checks.where((F.col("severity") == BLOCK) & ~F.col("passed")).collect()]
    if names:
        raise PublicationBlocked("blocked by: " + ", ".join(sorted(names)))
