"""Registered queries: reference-file loaders and exports, round-tripped through files Spark writes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import materialise, work_dir
from ..sources import export as ex
from ..sources import reference as ref
from ..sources import retail as R
from .index_family import TRAVEL, frames
from .registry import query
from .reporting import fact_index
from .sqltext import sql

MONTHS = ("January", "feb", "MAR", "4", "May", "june", "Jul", "08", "Sept", "oct", "November", "12.0")


def month_text(col):
    return F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.month(col))


def write_csv(df, path):
    df.write.option("header", True).csv(path)
    return path


def cpi_files(spark, sf):
    """Two usable files of different depth and one without an index column."""
    q = R.retail_quotes(spark, sf, "month")
    base = (q.groupBy("collected_date", "route", "source", "fare_family").agg(F.round(F.avg("price"), 2).alias("Index"))
            .select(F.year("collected_date").alias(" Year"), month_text("collected_date").alias("Month"), F.col("route").alias("State"),
                    F.when(F.col("source") == "O", "Urban").otherwise("Rural").alias("Sector"), F.lit("Transport").alias("Division"),
                    F.when(F.col("fare_family") != "PROMO", F.concat(F.lit("Air fare "), F.col("fare_family"))).alias("Item"), "Index"))
    base = materialise(base, "cpi-rows")  # all three files are made of it
    root = work_dir(spark, "cpi")
    return {write_csv(base, f"{root}/deep"): 2024, write_csv(base.drop("Item"), f"{root}/flat"): 2012,
            write_csv(base.drop("Index"), f"{root}/broken"): 2010}


CPI = """
  SELECT y.base_year, CAST(date_trunc('month', o_orderdate) AS DATE) AS period, r_name AS state, CASE l_linestatus WHEN 'O' THEN 'Urban' ELSE 'Rural' END AS sector,
         CASE WHEN y.base_year = 2024 AND p_type <> 'PROMO' THEN 'item' ELSE 'division' END AS level,
         CASE WHEN y.base_year = 2024 AND p_type <> 'PROMO' THEN 'Air fare ' || p_type ELSE 'Transport' END AS label, p_type, round(avg(l_extendedprice), 2) AS idx
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey, (VALUES (2024), (2012)) y(base_year) GROUP BY ALL"""


def cpi(spark, sf):
    return ref.load_cpi(spark, cpi_files(spark, sf))


@query("S5_S6_U1_cpi_load", f"SELECT base_year, level, label, sector, state, period, count(*) AS n FROM ({CPI}) GROUP BY ALL")
def _(spark, sf):
    tidy, skipped = cpi(spark, sf)
    if len(skipped) != 1:
        raise AssertionError(f"one file lacks an index column, skipped: {skipped}")
    return tidy.groupBy("base_year", "level", "label", "sector", "state", "period").agg(F.count(F.lit(1)).alias("n"))


@query("A24_cpi_catalogue", f"""
  SELECT base_year, level, label, sector, count(*) AS n, min(period) AS first_period, max(period) AS last_period FROM ({CPI}) GROUP BY ALL""")
def _(spark, sf):
    return ref.cpi_catalogue(cpi(spark, sf)[0])


@query("U6_labels_like_air", f"SELECT DISTINCT base_year, level, label FROM ({CPI}) WHERE lower(label) LIKE '%air%'")
def _(spark, sf):
    return ref.labels_like(cpi(spark, sf)[0])


def fares(spark, sf):
    q = R.retail_quotes(spark, sf, "month")
    rows = q.groupBy("collected_date", "route").agg(F.round(F.max("price"), 2).alias("fare"))
    text = rows.select(F.date_format("collected_date", "yyyy-MM").alias("Month"), F.lower(F.concat(F.lit(" "), "route", F.lit(" "))).alias("Route"),
                       F.when(F.month("collected_date") == 12, "n/a").when(F.month("collected_date") == 11, "-1").otherwise(F.col("fare").cast("string")).alias("Average_Fare"))
    root = work_dir(spark, "fares")  # one file each, of a row per month and route, as its checksum stands for the file
    return ref.load_fares(spark, write_csv(text.coalesce(1), f"{root}/official"), "https://example.org/fares").unionByName(
        ref.load_fares(spark, write_csv(text.coalesce(1), f"{root}/sample")))


FARES = sql("SELECT 1", "qm").rsplit("\nSELECT 1", 1)[0] + """, fares AS (SELECT * FROM (SELECT period, route, round(max(price), 2) AS average_fare FROM qm GROUP BY ALL)
  WHERE month(period) < 11)
"""


@query("S7_fare_load", FARES + "SELECT period, route, average_fare, 64 AS checksum_length, p AS is_placeholder FROM fares, (VALUES (TRUE), (FALSE)) x(p)")
def _(spark, sf):
    return fares(spark, sf).select("period", "route", "average_fare", F.length("file_sha256").alias("checksum_length"), "is_placeholder")


@query("A25_fare_series", FARES + "SELECT period, round(avg(average_fare), 4) AS average_fare, count(*) AS n_routes FROM fares GROUP BY 1")
def _(spark, sf):
    return ref.fare_series(fares(spark, sf)).select("period", F.round("average_fare", 4).alias("average_fare"), "n_routes")


@query("A26_fare_provenance", FARES + """SELECT u AS source_url, u IS NULL AS is_placeholder, count(*) AS n, min(period) AS first_period, max(period) AS last_period
  FROM fares, (VALUES ('https://example.org/fares'), (NULL)) x(u) GROUP BY ALL""")
def _(spark, sf):
    return ref.fare_provenance(fares(spark, sf)).drop("file_sha256")


@query("S8_alias_tolerant_load", FARES.replace("WHERE month(period) < 11", "") + """
  SELECT period, route, 'average_fare' AS metric, average_fare AS value, TRUE AS has_raw FROM fares""")
def _(spark, sf):
    q = R.retail_quotes(spark, sf, "month")
    rows = q.groupBy("collected_date", "route").agg(F.round(F.max("price"), 2).alias("fare"))
    text = rows.select(F.date_format("collected_date", "yyyy-MM-dd").alias("Date"), F.col("route").alias("Sector Pair"),
                       F.concat(F.lit("₹ "), F.format_number("fare", 2)).alias("Avg Fare"))
    loaded = ref.load_observations(spark, write_csv(text, f"{work_dir(spark, 'alias')}/x"), "dgca", "average_fare")
    return loaded.select("period", "route", "metric", "value", F.col("raw_row").contains("avg_fare").alias("has_raw"))


@query("S9_payload_csv", """
  SELECT event_type, count(*) AS n, count(k) AS with_k, count(u) AS with_user FROM
    (SELECT event_type, CASE WHEN event_type <> 'view' THEN props->>'$.k' END AS k, CASE WHEN event_type = 'view' THEN user_id END AS u FROM events) GROUP BY 1""")
def _(spark, sf):
    ev = R.table(spark, sf, "events")
    raw = ev.select("event_type", F.when(F.col("event_type") == "view", F.to_json(F.struct(F.col("user_id").alias("user")))).otherwise(F.col("props")).alias("record_json"))
    path = f"{work_dir(spark, 'payload')}/csv"
    ex.write_payload_csv(raw, path)
    back = spark.read.option("header", True).csv(path)
    return back.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count("k").alias("with_k"), F.count("user").alias("with_user"))


@query("S10_flat_export_rows", sql("""
  SELECT origin_airport || '-' || destination_airport AS route, CAST(total_fare AS VARCHAR) AS total_fare, CAST(travel_date AS VARCHAR) AS travel_date, count(*) AS n
  FROM obs GROUP BY ALL""", "obs"))
def _(spark, sf):
    return ex.flat_rows(R.retail_observations(spark, sf)).groupBy("route", "total_fare", "travel_date").agg(F.count(F.lit(1)).alias("n"))


@query("S11_series_csv", sql("""
  SELECT period, round(value, 6) AS value, CAST(NULL AS DOUBLE) AS se FROM head_travel WHERE omega_preset = 'uniform'""", "head_travel"))
def _(spark, sf):
    path = f"{work_dir(spark, 'series')}/csv"
    rows = frames(spark, sf, TRAVEL).headline.withColumns({"index_code": F.lit("IDX-T"), "frequency": F.lit("daily"), "basis": F.lit("travel")})
    ex.write_series_csv(rows, path, ex.RUN_EXPORT)
    return spark.read.option("header", True).csv(path).select(
        F.col("period").cast("date").alias("period"), F.col("value").cast("double").alias("value"), F.col("se").cast("double").alias("se"))


@query("S12_sdmx_round_trip", sql("""
  SELECT omega_preset, round(sum(value), 4) AS total FROM head_travel GROUP BY 1""", "head_travel"))
def _(spark, sf):
    path = f"{work_dir(spark, 'sdmx')}/json"
    ex.write_sdmx(fact_index(spark, sf).where(F.col("index_code") == "IDX-T"), path)
    shape = ("data struct<structure:struct<dimensions:struct<series:array<struct<id:string,values:array<struct<id:string,name:string>>>>>>,"
             "dataSets:array<struct<series:map<string,struct<observations:map<string,array<double>>>>>>>")
    body = F.from_json("value", shape)["data"]
    preset = F.lower(body["structure"]["dimensions"]["series"][2]["values"][0]["id"])
    points = body["dataSets"][0]["series"]["0:0:0"]["observations"]
    total = F.aggregate(F.map_values(points), F.lit(0.0), lambda acc, v: acc + v[0])
    return spark.read.text(path).select(preset.alias("omega_preset"), F.round(total, 4).alias("total"))
