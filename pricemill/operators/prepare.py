"""From stored quotes to one log price per product and period."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..schemas import PRODUCT, PUBLISHABLE, REQUIRED_QUOTE_COLUMNS

VARIANT_COLUMNS = {"B": "price_B", "T": "price_T", "A": "price_A"}


def require_columns(df: DataFrame, columns: Sequence[str] = (*REQUIRED_QUOTE_COLUMNS, "price")) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"quotes lack required columns: {missing}")


def publishable(df: DataFrame, price: str = "price") -> DataFrame:
    kept = df.where(F.col("disposition").isin(PUBLISHABLE)) if "disposition" in df.columns else df
    return kept.where(F.col(price) > 0)


def with_period(df: DataFrame, basis: str) -> DataFrame:
    source = {"book": "collected_date", "travel": "departure_date"}[basis]
    return df.withColumn("period", F.col(source))


def both_bases(df: DataFrame, bases: Sequence[str] = ("book", "travel")) -> DataFrame:
    """One row per quote and time basis, so that the bases become a key and not a loop."""
    source = {"book": "collected_date", "travel": "departure_date"}
    pairs = [F.struct(F.lit(b).alias("basis"), F.col(source[b]).alias("period")) for b in bases]
    return df.withColumn("_p", F.explode(F.array(*pairs))).select("*", "_p.*").drop("_p")


def all_variants(df: DataFrame, variants: Sequence[str] = ("B", "T", "A")) -> DataFrame:
    """One row per quote and price variant."""
    pairs = [F.struct(F.lit(v).alias("variant"), variant_price(v).alias("price")) for v in variants]
    return df.drop("price", "variant").withColumn("_v", F.explode(F.array(*pairs))).select("*", "_v.*").drop("_v")


def variant_price(variant: str) -> Column:
    if variant not in VARIANT_COLUMNS:
        raise ValueError(f"unknown price variant {variant!r}")
    return F.col(VARIANT_COLUMNS[variant])


def collapse_sources(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Geometric mean over repeated quotes of a product in a period.

    ``avg(ln)`` is a partial aggregate, so a product held by very many quotes is folded on the map
    side. Products with a null key part cannot be matched and are left out.
    """
    whole = F.lit(True)
    for c in PRODUCT:
        whole = whole & F.col(c).isNotNull()
    return (
        df.where(whole)
        .groupBy(*by, *PRODUCT, "period")
        .agg(F.avg(F.ln("price")).alias("lp"), F.count(F.lit(1)).alias("n_sources"))
        .withColumn("price", F.exp("lp"))
    )


def fold_variants(df: DataFrame, variants: Sequence[str] = ("B", "T", "A")) -> DataFrame:
    """Sums and counts of log prices by product and both dates, a column per price variant: all that any time basis needs."""
    whole = F.lit(True)
    for c in PRODUCT:
        whole = whole & F.col(c).isNotNull()
    logs = {v: F.when(variant_price(v) > 0, F.ln(variant_price(v))) for v in variants}
    return df.where(whole).groupBy(*PRODUCT, "collected_date", "departure_date").agg(
        *[F.sum(x).alias(f"_sum_{v}") for v, x in logs.items()], *[F.count(x).alias(f"_n_{v}") for v, x in logs.items()])


def collapse_variants(folded: DataFrame, variants: Sequence[str] = ("B", "T", "A"), by: Sequence[str] = ("basis",)) -> DataFrame:
    """``collapse_sources`` of folded rows (``fold_variants``) with their period, in one aggregate; the variant becomes a key afterwards."""
    n = {v: F.sum(f"_n_{v}") for v in variants}
    folded = folded.groupBy(*by, *PRODUCT, "period").agg(
        *[F.when(n[v] > 0, F.sum(f"_sum_{v}") / n[v]).alias(f"_lp_{v}") for v in variants], *[n[v].alias(f"_n_{v}") for v in variants])
    stacked = F.array(*[F.struct(F.lit(v).alias("variant"), F.col(f"_lp_{v}").alias("lp"), F.col(f"_n_{v}").alias("n_sources")) for v in variants])
    return (
        folded.select(*by, *PRODUCT, "period", F.explode(stacked).alias("_v")).select("_v.variant", *by, *PRODUCT, "period", "_v.lp", "_v.n_sources")
        .where(F.col("lp").isNotNull()).withColumn("price", F.exp("lp"))
    )


def window_coverage(prepared: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Lead-time windows that hold a price, per period."""
    priced = F.when(F.col("lp").isNotNull(), F.col("apw_days"))
    return prepared.groupBy(*by, "period").agg(F.countDistinct(priced).alias("n_apw"))


def base_periods(prepared: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Earliest period carrying the most lead-time windows; one row per ``by`` key."""
    best = F.max_by("period", F.struct(F.col("n_apw"), -F.unix_date("period")))
    return window_coverage(prepared, by).groupBy(*by).agg(best.alias("base_period"))


def pinned_base(prepared: DataFrame, base_period: str) -> str:
    """A pinned base must hold quotes; anything else is an error, not an empty index."""
    day = F.lit(base_period).cast("date")
    if prepared.where(F.col("period") == day).isEmpty():
        raise ValueError(f"pinned base period {base_period} has no publishable quotes")
    return base_period


def rebuild_variants(df: DataFrame) -> DataFrame:
    """Variant prices from stored components, honouring a capped total where there is one."""
    def part(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(0.0)) if c in df.columns else F.lit(0.0)

    capped = F.col("total_fare_capped")
    effective = F.coalesce(capped, F.col("total_fare"))
    base, gst = part("base_fare"), part("gst")
    rate = F.when(base > 0, gst / base).otherwise(0.0)
    fixed = part("udf") + part("asf") + part("rcs_levy") + part("convenience_fee")
    base_effective = F.when(capped.isNotNull(), (effective - fixed) / (1 + rate)).otherwise(base)
    return (
        df.withColumn("total_fare_effective", effective)
        .withColumn("price_B", base_effective + part("yq_yr"))
        .withColumn("price_T", effective - part("convenience_fee"))
        .withColumn("price_A", effective)
    )
