"""Effective-dated charges and the split of a total fare into its components."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def history(scd: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """One row per key holding its dated versions, oldest first.

    The input is a dimension (a few versions per key), so the array is short; looking it up costs
    the fact side one equi join and no regrouping, and overlapping versions cannot multiply rows.
    """
    entry = F.struct("effective_from", "effective_to", *values)
    return scd.groupBy(key).agg(F.sort_array(F.collect_list(entry)).alias("_versions"))


def in_force(versions: Column, day: Column) -> Column:
    """First version with effective_from <= day < effective_to; null when none applies."""
    live = F.filter(versions, lambda v: (v["effective_from"] <= day)
                    & (v["effective_to"].isNull() | (v["effective_to"] > day)))
    return F.get(live, F.lit(0))


def lookup(df: DataFrame, scd: DataFrame, key: str, fact_key: str, day: str, values: dict[str, str]) -> DataFrame:
    """Interval lookup; ``values`` maps dimension columns to output names, absent ones become 0."""
    book = history(scd, key, list(values)).withColumnRenamed(key, "_scd_key")
    joined = df.join(book, F.col(fact_key) == F.col("_scd_key"), "left").withColumn(
        "_v", in_force(F.col("_versions"), F.col(day)))
    for source, name in values.items():
        joined = joined.withColumn(name, F.coalesce(F.col("_v")[source], F.lit(0.0)))
    return joined.drop("_scd_key", "_versions", "_v")


def airport_charges(df: DataFrame, charges: DataFrame, day: str = "collected_date") -> DataFrame:
    return lookup(df, charges, "airport_iata", "origin_iata", day, {"udf_domestic": "udf", "asf": "asf"})


def gst_rate(df: DataFrame, taxes: DataFrame, day: str = "collected_date") -> DataFrame:
    return lookup(df, taxes, "cabin", "cabin", day, {"gst_rate": "gst_rate"})


def rcs_levy(df: DataFrame, routes: DataFrame, levy: float) -> DataFrame:
    marked = routes.select("route").distinct().withColumn("_rcs", F.lit(True))
    return df.join(marked, "route", "left").withColumn(
        "rcs_levy", F.when(F.col("_rcs"), F.lit(float(levy))).otherwise(0.0)).drop("_rcs")


def decompose(df: DataFrame, charges: DataFrame, taxes: DataFrame, routes: DataFrame, *,
              fee: float, levy: float, day: str = "collected_date") -> DataFrame:
    """Solve total = F + statutory + g*F for the fare base F and attach the three variants."""
    full = rcs_levy(gst_rate(airport_charges(df, charges, day), taxes, day), routes, levy)
    total = F.col("total_fare")
    base = (total - F.col("udf") - F.col("asf") - F.col("rcs_levy") - F.col("convenience_fee")) / (1 + F.col("gst_rate"))
    parts = sum((F.col(c) for c in ("yq_yr", "udf", "asf", "rcs_levy", "gst", "convenience_fee")), F.col("base_fare"))
    return (
        full.withColumn("convenience_fee", F.lit(float(fee)))
        .withColumn("base_fare", base)
        .withColumn("yq_yr", F.lit(0.0))
        .withColumn("gst", F.col("base_fare") * F.col("gst_rate"))
        .withColumn("price_B", F.col("base_fare") + F.col("yq_yr"))
        .withColumn("price_T", total - F.col("convenience_fee"))
        .withColumn("price_A", total)
        .withColumn("decomp_residual", F.abs(total - parts))
        .drop("gst_rate")
    )
