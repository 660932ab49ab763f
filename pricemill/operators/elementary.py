"""Elementary aggregates: matched, lowest-fare and availability-adjusted indices per cell."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..schemas import CELL, FLIGHT, PRODUCT

FLOOR = 1e-6


def attach_base(prepared: DataFrame, bases: DataFrame | Column, by: Sequence[str] = ()) -> DataFrame:
    """Base-period log price of each product as ``lp0`` and its log relative as ``lr``.

    ``bases`` is either a base date or a table (by..., base_period) with one row per series key. After
    source collapse a product has one row per period, so its window group is as long as the calendar and no longer.
    """
    by = list(by)
    if isinstance(bases, DataFrame):
        df = prepared.join(bases, by) if by else prepared.withColumn("base_period", bases.scalar())
    else:
        df = prepared.withColumn("base_period", bases)
    product = W.partitionBy(*by, *PRODUCT)
    lp0 = F.max(F.when(F.col("period") == F.col("base_period"), F.col("lp"))).over(product)
    return df.withColumn("lp0", lp0).withColumn("lr", F.col("lp") - F.col("lp0"))


def attach_base_by_join(prepared: DataFrame, base_period: Column) -> DataFrame:
    """The same as an inner equi join: products without a base price drop out."""
    base = prepared.where(F.col("period") == base_period).select(*PRODUCT, F.col("lp").alias("lp0"))
    return prepared.join(base, PRODUCT).withColumn("lr", F.col("lp") - F.col("lp0"))


def jevons(relatives: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return (
        relatives.where(F.col("lr").isNotNull())
        .groupBy(*by, "period", *CELL)
        .agg((100 * F.exp(F.avg("lr"))).alias("matched"), F.count("lr").alias("n_matched"))
    )


def elementary_family(relatives: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Jevons, Dutot, Carli and the delta-method error of Jevons, in one pass."""
    p0 = F.exp("lp0")
    level = 100 * F.exp(F.avg("lr"))
    n = F.count("lr")
    return (
        relatives.where(F.col("lr").isNotNull())
        .groupBy(*by, "period", *CELL)
        .agg(
            level.alias("jevons"),
            (100 * F.avg("price") / F.avg(p0)).alias("dutot"),
            (100 * F.avg(F.exp("lr"))).alias("carli"),
            F.when(n >= 2, level * F.stddev_samp("lr") / F.sqrt(n.cast("double"))).alias("jevons_se"),
            n.alias("n_matched"),
        )
    )


def flight_blocks(relatives: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per flight and period: sum and count of matched log relatives, and the lowest-fare relative."""
    by = list(by)
    flights = (
        relatives.groupBy(*by, "period", *FLIGHT)
        .agg(
            F.sum("lr").alias("lr_sum"),
            F.count("lr").alias("lr_n"),
            F.min("lp").alias("llow"),
            F.count(F.lit(1)).alias("n_quotes"),
            F.first("base_period").alias("base_period"),
        )
    )
    base = F.max(F.when(F.col("period") == F.col("base_period"), F.col("llow"))).over(W.partitionBy(*by, *FLIGHT))
    return flights.withColumn("laf_lr", F.col("llow") - base).drop("llow", "base_period")


def lowest_fare_index(blocks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return (
        blocks.where(F.col("laf_lr").isNotNull())
        .groupBy(*by, "period", *CELL)
        .agg((100 * F.exp(F.avg("laf_lr"))).alias("laf"))
    )


def family_counts(prepared: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Fare families on offer, against the most ever seen in the cell, and their ratio."""
    per_period = prepared.groupBy(*by, "period", *CELL).agg(F.countDistinct("fare_family").alias("n_families"))
    ref = F.max("n_families").over(W.partitionBy(*by, *CELL))
    return per_period.withColumn("n_families_ref", ref).withColumn("availability", availability_ratio())


def availability_ratio(offered: str = "n_families", reference: str = "n_families_ref") -> Column:
    ratio = F.col(offered) / F.col(reference)
    return F.when(F.col(reference) <= 0, 1.0).otherwise(F.least(F.greatest(ratio, F.lit(FLOOR)), F.lit(1.0)))


def blend(matched: Column, laf: Column, availability: Column) -> Column:
    """Geometric blend; whichever side is missing or not positive yields to the other."""
    both = F.exp(availability * F.ln(matched) + (1 - availability) * F.ln(laf))
    return F.when((matched > 0) & (laf > 0), both).when(matched > 0, matched).otherwise(F.when(laf > 0, laf))


def cell_levels(relatives: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """What a period says about its cells, whatever other periods hold: matched, n_matched, n_quotes, n_families, laf."""
    by = list(by)
    index = (
        relatives.groupBy(*by, "period", *CELL)
        .agg(
            (100 * F.exp(F.avg("lr"))).alias("matched"),
            F.count("lr").alias("n_matched"),
            F.count(F.lit(1)).alias("n_quotes"),
            F.countDistinct("fare_family").alias("n_families"),
        )
    )
    return index.join(lowest_fare_index(flight_blocks(relatives, by), by), [*by, "period", *CELL], "left")


def with_availability(levels: DataFrame, by: Sequence[str] = (), n_min: int = 5, adjust: bool = True) -> DataFrame:
    """Cells from the levels of all periods: reference families, availability, adjusted, suppressed."""
    out = levels.withColumn("n_families_ref", F.max("n_families").over(W.partitionBy(*by, *CELL))).withColumn("availability", availability_ratio())
    level = blend(F.col("matched"), F.col("laf"), F.col("availability")) if adjust else F.col("matched")
    return out.withColumns({"adjusted": level, "suppressed": F.col("n_matched") < n_min})


def cells(relatives: DataFrame, by: Sequence[str] = (), n_min: int = 5, adjust: bool = True) -> DataFrame:
    """One row per (period, cell): matched, laf, availability, adjusted, n_matched, suppressed."""
    return with_availability(cell_levels(relatives, by), by, n_min, adjust)
