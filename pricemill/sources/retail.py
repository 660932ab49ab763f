"""The quote view over the order/line-item tables, with its literal dimension tables.

Line items play the part of price quotes: the customer's region is the route, the return flag the
carrier, the part number picks the lead-time window. Order dates are truncated so that matched
products recur from period to period.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..params import APW_WINDOWS, OMEGA_PRESETS
from ..schemas import CHARGES, TAXES
from ..session import literal_table

MONTHS_PER_PERIOD = {"month": 1, "quarter": 3, "year": 12}

# The literal dimensions of the view.
ROUTE_WEIGHTS = {"AFRICA": 0.15, "AMERICA": 0.30, "ASIA": 0.25, "EUROPE": 0.20, "MIDDLE EAST": 0.10}
CARRIER_WEIGHTS = {
    "AFRICA": {"A": 0.5, "N": 0.3, "R": 0.2},
    "AMERICA": {"A": 0.4, "N": 0.4, "R": 0.2},
    "ASIA": {"A": 0.6, "N": 0.3, "R": 0.1},
    "EUROPE": {"A": 0.2, "N": 0.3, "R": 0.5},
}
DISTANCES = {"AFRICA": 900.0, "AMERICA": 2100.0, "ASIA": 1400.0, "EUROPE": 600.0}
STRATA = {"AFRICA": "regional", "AMERICA": "metro", "ASIA": "metro", "EUROPE": "metro",
          "MIDDLE EAST": "regional", "OCEANIA": "island"}
RCS_ROUTES = ("AFRICA",)
RCS_LEVY = 50.0
CONVENIENCE_FEE = 299.0
SPLIT = date(1998, 1, 1)
START = date(1990, 1, 1)
UDF_ASF = {"AFRICA": (129.0, 200.0, 236.0), "AMERICA": (152.0, 310.0, 236.0), "ASIA": (91.0, 120.0, 236.0),
           "EUROPE": (406.0, 610.0, 236.0), "MIDDLE EAST": (77.0, 85.0, 236.0)}
GST = {"economy": (0.05, 0.06), "other_than_economy": (0.12, 0.18)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def retail_quotes(spark: SparkSession, sf_dir: str, grain: str = "quarter") -> DataFrame:
    """One row per line item in quote form."""
    return quote_view(table(spark, sf_dir, "lineitem"), spark, sf_dir, grain)


def quote_view(line: DataFrame, spark: SparkSession, sf_dir: str, grain: str = "quarter") -> DataFrame:
    """Quote form of line items, batch or stream; no join here carries a hint, sizes decide.

    Orders find their route before the lines join them, so that the lines are shuffled twice, by part and by order, and no more;
    what they need of a column is computed before. Orders come last: what is then grouped by the order among other keys needs no further shuffle.
    """
    where = (
        table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
        .join(table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"),
              F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region").select("r_regionkey", "r_name"),
              F.col("n_regionkey") == F.col("r_regionkey"))
        .select("c_custkey", F.col("r_name").alias("route"))
    )
    orders = (
        table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
        .join(where, F.col("o_custkey") == F.col("c_custkey"))
        .select("o_orderkey", "route", F.date_trunc(grain, F.col("o_orderdate")).cast("date").alias("collected_date"), F.col("o_orderdate").alias("ordered_at"))
    )
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    lines = line.select(
        "l_orderkey", "l_partkey", (F.col("l_suppkey") % 3).cast("string").alias("flight_number"), "l_returnflag", "l_extendedprice", "l_linestatus",
        "l_quantity", "l_discount", "l_tax", "l_linenumber")
    slot = (F.col("l_partkey") % len(APW_WINDOWS)).cast("int")
    windows = F.array(*[F.lit(w) for w in APW_WINDOWS])
    return (
        lines.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            "collected_date",
            F.add_months("collected_date", slot * MONTHS_PER_PERIOD[grain]).alias("departure_date"),
            "route",
            F.col("l_returnflag").alias("carrier"),
            F.get(windows, slot).alias("apw_days"),
            "flight_number",
            F.col("p_type").alias("fare_family"),
            F.lit("economy").alias("cabin"),
            F.lit(0).alias("stops"),
            F.col("l_extendedprice").alias("price"),
            F.col("l_linestatus").alias("source"),
            F.lit("ACCEPTED").alias("disposition"),
            F.col("l_orderkey").alias("order_id"),
            F.col("l_quantity").alias("quantity"),
            F.col("l_discount").alias("discount"),
            F.col("l_tax").alias("tax"),
            F.col("l_linenumber").alias("line_number"),
            "ordered_at",
        )
    )


def retail_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as collected observations with partly missing, partly inconsistent components."""
    q = retail_quotes(spark, sf_dir)
    total = F.col("price").cast("decimal(12,2)")
    base = (F.col("price") * 0.5).cast("decimal(12,2)")
    known = F.col("discount") != 0.03
    fixed = F.lit("100.00").cast("decimal(12,2)")
    rest = (total - base - fixed * 4).cast("decimal(12,2)")
    booked = F.to_date("ordered_at")
    return q.select(
        "order_id", "line_number",
        F.upper(F.substring("route", 1, 3)).alias("origin_airport"),
        F.when(F.col("carrier") == "A", "DEL").when(F.col("carrier") == "N", "BOM").otherwise("XXX").alias("destination_airport"),
        F.when(F.col("carrier") == "A", "6E").when(F.col("carrier") == "N", "AI").otherwise("ZZ").alias("carrier"),
        F.concat(F.lit("F"), "flight_number").alias("flight_number"),
        F.col("source"),
        F.when(F.col("line_number") % 4 == 0, "public_api").when(F.col("line_number") % 4 == 1, "static_html")
        .when(F.col("line_number") % 4 == 2, "document").otherwise("unlisted").alias("collector"),
        (F.col("ordered_at") + F.make_dt_interval(hours=F.col("line_number"))).alias("collected_at"),
        booked.alias("booking_date"), F.date_add(booked, F.col("apw_days")).alias("travel_date"),
        F.col("apw_days").alias("lead_time_days"),
        F.when(F.col("fare_family") != "PROMO", F.col("fare_family")).alias("fare_brand"),
        F.lit("economy").alias("cabin_class"),
        F.when(F.col("quantity") >= 50, "sold_out").otherwise("available").alias("availability"),
        base.alias("base_fare"), F.when(known, fixed).alias("taxes"), fixed.alias("airport_fee"), fixed.alias("udf"),
        fixed.alias("convenience_fee"), F.when(F.col("discount") == 0.05, rest + 1).otherwise(rest).cast("decimal(12,2)").alias("other_fee"),
        total.alias("total_fare"),
    )


def retail_raw_quotes(spark: SparkSession, sf_dir: str, grain: str = "quarter") -> DataFrame:
    """The same rows before cleaning: a total fare, a currency, a sold-out flag, some bad cabins."""
    return (
        retail_quotes(spark, sf_dir, grain)
        .withColumnRenamed("price", "total_fare")
        .withColumn("currency", F.when(F.col("tax") == 0.08, "USD").otherwise("INR"))
        .withColumn("is_sold_out", F.col("quantity") >= 50)
        .withColumn("cabin", F.when(F.col("discount") == 0.10, "bad").otherwise("economy"))
        .withColumn("origin_iata", F.col("route"))
        .drop("disposition")
    )


def route_weights(spark: SparkSession) -> DataFrame:
    return literal_table(spark, sorted(ROUTE_WEIGHTS.items()), "route string, w double")


def carrier_weights(spark: SparkSession) -> DataFrame:
    rows = [(r, c, v) for r, t in sorted(CARRIER_WEIGHTS.items()) for c, v in sorted(t.items())]
    return literal_table(spark, rows, "route string, carrier string, phi double")


def omega_weights(spark: SparkSession, presets: dict[str, dict[int, float]] = OMEGA_PRESETS) -> DataFrame:
    rows = [(p, a, v) for p, t in presets.items() for a, v in t.items()]
    return literal_table(spark, rows, "omega_preset string, apw_days int, omega double")


def distances(spark: SparkSession) -> DataFrame:
    return literal_table(spark, sorted(DISTANCES.items()), "route string, km double")


def basket(spark: SparkSession) -> DataFrame:
    """Configured routes, one of which has no quotes."""
    rows = [(r, s, ROUTE_WEIGHTS.get(r, 0.05), r in ("ASIA", "EUROPE")) for r, s in sorted(STRATA.items())]
    return literal_table(spark, rows, "route string, stratum string, weight_wr double, in_named_list boolean")


def charges(spark: SparkSession) -> DataFrame:
    rows = []
    for airport, (before, after, asf) in sorted(UDF_ASF.items()):
        rows += [(airport, before, asf, START, SPLIT), (airport, after, asf, SPLIT, None)]
    return literal_table(spark, rows, CHARGES)


def taxes(spark: SparkSession) -> DataFrame:
    rows = []
    for cabin, (before, after) in sorted(GST.items()):
        rows += [(cabin, before, START, SPLIT), (cabin, after, SPLIT, None)]
    return literal_table(spark, rows, TAXES)


def rcs_routes(spark: SparkSession) -> DataFrame:
    return literal_table(spark, [(r,) for r in RCS_ROUTES], "route string")
