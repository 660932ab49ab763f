"""Registered queries: published views, coverage, weights, series selection, sinks' key logic."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.digests import merkle_sql
from ..operators import aggregate as agg
from ..operators import quality as q
from ..operators import reports as rp
from ..params import APW_WINDOWS
from ..schemas import CELL
from ..session import materialise, work_dir
from ..sources import retail as R
from .index_family import TRAVEL, frames
from .registry import query
from .sqltext import CELL as CELL_SQL
from .sqltext import sql
from .stage_zero import decomposed, stored_quotes

# Event type -> ledger outcome.
OUTCOMES = {"view": "OK", "click": "OK", "error": "HARD_BLOCK", "signup": "ROBOTS_BLOCKED", "purchase": "CIRCUIT_OPEN"}
OUTCOME_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in OUTCOMES.items()) + " END"


def outcome(col="event_type"):
    out = None
    for k, v in OUTCOMES.items():
        out = F.when(F.col(col) == k, v) if out is None else out.when(F.col(col) == k, v)
    return out


def fetch_log(spark, sf):
    """Events as ledger records: the user picks the source, the type the outcome."""
    return R.table(spark, sf, "events").select(
        F.concat(F.lit("src"), (F.col("user_id") % 7).cast("string")).alias("source"), outcome().alias("outcome"),
        F.get_json_object("props", "$.k").cast("long").alias("n_quotes"), "ts")


def publishable_decomposed(spark, sf):
    return decomposed(spark, sf).withColumn(
        "disposition", F.when(F.col("currency") == "INR", "ACCEPTED").otherwise("EXCLUDED"))


@query("A19_component_averages", sql("""
  SELECT collected_date AS period, round(avg(base_fare), 4) AS base_fare, round(avg(yq_yr), 4) AS yq_yr, round(avg(udf), 4) AS udf,
         round(avg(asf), 4) AS asf, round(avg(rcs_levy), 4) AS rcs_levy, round(avg(gst), 4) AS gst,
         round(avg(convenience_fee), 4) AS convenience_fee, round(avg(total_fare), 4) AS total_fare, count(*) AS n
  FROM decomp WHERE currency = 'INR' GROUP BY 1""", "decomp"))
def _(spark, sf):
    out = rp.component_averages(publishable_decomposed(spark, sf))
    return out.select("period", "n", *[F.round(c, 4).alias(c) for c in out.columns if c not in ("period", "n")])


@query("A20_availability_by_day", sql("""
  SELECT collected_date AS period, count(DISTINCT CASE WHEN NOT is_sold_out THEN fare_family END) AS families_offered,
         count(DISTINCT fare_family) AS families_total, count(*) FILTER (is_sold_out) AS n_sold_out, count(*) AS n_quotes,
         round(count(DISTINCT CASE WHEN NOT is_sold_out THEN fare_family END) / count(DISTINCT fare_family), 4) AS availability_ratio
  FROM raw_quotes GROUP BY 1""", "raw_quotes"))
def _(spark, sf):
    return rp.availability_by_day(R.retail_raw_quotes(spark, sf))


@query("A21_level_series", sql("""
  SELECT period, round(avg(matched), 6) AS matched, round(avg(laf), 6) AS laf, round(avg(adjusted_raw), 6) AS adjusted,
         round(avg(adjusted), 6) AS adjusted_smoothed, round(avg(availability), 6) AS availability,
         CAST(sum(n_matched) AS BIGINT) AS n_matched, CAST(sum(n_quotes) AS BIGINT) AS n_quotes,
         round(avg(adjusted_raw) - avg(matched), 4) AS matched_vs_adjusted
  FROM smooth_book WHERE NOT suppressed GROUP BY 1""", "smooth_book"))
def _(spark, sf):
    return rp.level_series(frames(spark, sf).cells)


@query("A22_J13_coverage_ledger", sql("""
  SELECT coalesce(stratum, 'ALL') AS stratum, count(*) AS routes, count(*) FILTER (got) AS collected, round(sum(weight_wr), 6) AS weight,
         round(100.0 * count(*) FILTER (got) / count(*), 2) AS by_count_pct,
         round(100.0 * coalesce(sum(weight_wr) FILTER (got), 0) / sum(weight_wr), 2) AS by_weight_pct,
         count(*) FILTER (got AND in_named_list) AS named_collected,
         coalesce(string_agg(route, ',' ORDER BY route) FILTER (NOT got), '') AS uncollected
  FROM (SELECT b.*, n IS NOT NULL AS got FROM d_basket b LEFT JOIN (SELECT route, count(*) AS n FROM quotes GROUP BY 1) USING (route))
  GROUP BY ROLLUP (stratum)""", "quotes", "d_basket"))
def _(spark, sf):
    return rp.coverage_rollup(R.basket(spark), R.retail_quotes(spark, sf))


@query("J13_basket_coverage", sql("""
  SELECT b.route, stratum, round(weight_wr, 6) AS weight_wr, in_named_list, coalesce(n, 0) AS n_quotes, first_seen, last_seen, n IS NOT NULL AS collected
  FROM d_basket b LEFT JOIN (SELECT route, count(*) AS n, min(collected_date) AS first_seen, max(collected_date) AS last_seen
                             FROM quotes GROUP BY 1) USING (route)""", "quotes", "d_basket"))
def _(spark, sf):
    return rp.basket_coverage(R.basket(spark), R.retail_quotes(spark, sf))


@query("U4_basket_minus_collected", sql("SELECT route FROM d_basket EXCEPT SELECT route FROM quotes", "quotes", "d_basket"))
def _(spark, sf):
    return rp.uncollected_routes(R.basket(spark), R.retail_quotes(spark, sf))


@query("J19_stale_routes", sql("""
  SELECT route FROM d_basket WHERE route NOT IN
    (SELECT route FROM quotes WHERE collected_date = (SELECT max(collected_date) FROM quotes))""", "quotes", "d_basket"))
def _(spark, sf):
    return q.stale_routes(R.retail_quotes(spark, sf), R.basket(spark))


@query("A23_source_outcomes", f"""
  SELECT 'src' || (user_id % 7) AS source, count(*) AS n_records, CAST(sum(CAST(props->>'$.k' AS BIGINT)) AS BIGINT) AS n_quotes,
         count(*) FILTER (o = 'OK') AS n_ok, count(*) FILTER (o = 'ROBOTS_BLOCKED') AS n_robots_blocked,
         count(*) FILTER (o IN ('HARD_BLOCK', 'CIRCUIT_OPEN')) AS n_blocked
  FROM (SELECT *, {OUTCOME_SQL} AS o FROM events) GROUP BY 1""")
def _(spark, sf):
    return rp.source_outcomes(fetch_log(spark, sf))


@query("A27_store_status", sql("""
  SELECT count(*) AS n_quotes, min(collected_date) AS first_date, max(collected_date) AS last_date, count(DISTINCT route) AS n_routes,
         round(100.0 * count(DISTINCT route) / (SELECT count(*) FROM d_basket), 2) AS basket_pct FROM quotes""", "quotes", "d_basket"))
def _(spark, sf):
    return rp.store_status(R.retail_quotes(spark, sf), R.basket(spark))


def traffic(spark, sf):
    return R.retail_quotes(spark, sf).select(
        "route", F.when(F.col("carrier") != "N", F.col("carrier")).alias("carrier"), F.col("quantity").cast("long").alias("passengers"))


@query("A29_traffic_weights", sql("""
  SELECT r.route, carrier, round(phi, 6) AS phi, round(w, 6) AS w FROM
    (SELECT route, carrier, pax / sum(pax) OVER (PARTITION BY route) AS phi FROM
      (SELECT route, CASE WHEN carrier = 'N' THEN 'UN' ELSE carrier END AS carrier, sum(quantity) AS pax FROM quotes GROUP BY 1, 2)) r
  JOIN (SELECT route, sum(quantity) / (SELECT sum(quantity) FROM quotes) AS w FROM quotes GROUP BY 1) USING (route)""", "quotes"))
def _(spark, sf):
    routes, carriers = rp.traffic_weights(traffic(spark, sf))
    return carriers.join(routes.select("route", "w"), "route").select("route", "carrier", "phi", "w")


@query("A30_derived_weights", sql("""
  SELECT r.route, c.carrier, round(mass / sum(mass) OVER (PARTITION BY r.route), 6) AS phi,
         round(passengers / (SELECT sum(quantity) FROM quotes), 6) AS w
  FROM (SELECT route, sum(quantity) AS passengers FROM quotes GROUP BY 1) r
  JOIN (SELECT route, carrier, count(*) * avg(quantity) * (1 - avg(discount)) AS mass FROM quotes GROUP BY ALL) c USING (route)""", "quotes"))
def _(spark, sf):
    quotes = R.retail_quotes(spark, sf)
    routes = quotes.groupBy("route").agg(F.sum("quantity").alias("passengers"))
    carriers = quotes.groupBy("route", "carrier").agg(
        F.count(F.lit(1)).cast("double").alias("share"), F.avg("quantity").alias("seats"), (1 - F.avg("discount")).alias("load_factor"))
    return rp.derived_weights(routes, carriers)


@query("A32_heatmap", sql("""
  SELECT period, route, max(adjusted) FILTER (apw_days = 1) AS "1", max(adjusted) FILTER (apw_days = 7) AS "7", max(adjusted) FILTER (apw_days = 15) AS "15",
         max(adjusted) FILTER (apw_days = 30) AS "30", max(adjusted) FILTER (apw_days = 45) AS "45" FROM
    (SELECT period, route, apw_days, round(adjusted, 6) AS adjusted FROM smooth_book
     QUALIFY row_number() OVER (PARTITION BY period, route, apw_days ORDER BY suppressed, n_matched DESC, carrier) = 1)
  GROUP BY ALL""", "smooth_book"))
def _(spark, sf):
    return rp.heatmap(frames(spark, sf).cells, APW_WINDOWS)


@query("A37_headline_kpis", sql("""
  SELECT max(period) AS latest_period, round(arg_max(value, period), 6) AS latest_value,
         round(100 * (arg_max(value, period) / arg_min(value, period) - 1), 6) AS change_pct, count(*) AS n_periods,
         round(arg_max(coverage_pct, period), 6) AS coverage_pct, arg_max(n_cells, period) AS latest_cells
  FROM head_book LEFT JOIN (SELECT period, count(*) FILTER (NOT suppressed) AS n_cells FROM cells_book GROUP BY 1) USING (period)
  WHERE omega_preset = 'uniform'""", "head_book", "cells_book"))
def _(spark, sf):
    f = frames(spark, sf)
    return rp.headline_kpis(f.headline.drop("n_cells"), f.cells)


def fact_index(spark, sf):
    """The published long table: headline of every preset plus route and window detail."""
    f = frames(spark, sf, TRAVEL)
    presets = agg.lead_stage(f.by_apw, R.omega_weights(spark))
    rows = presets.select(F.lit("IDX-T").alias("index_code"), "period", "omega_preset", "value")
    detail = f.by_route.select(
        F.concat(F.lit("IDX-T:route="), "route", F.lit(":apw="), F.col("apw_days").cast("string")).alias("index_code"),
        "period", F.lit("uniform").alias("omega_preset"), "value")
    return rows.unionByName(detail).withColumns({
        "frequency": F.lit("daily"), "basis": F.lit("travel"), "method_version": F.lit("1.0.0"), "weights_version": F.lit("v1")})


@query("P21_series_selection", sql("""
  SELECT period, round(value, 6) AS value FROM head_travel
  WHERE omega_preset = 'leisure_tilted' AND period BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' ORDER BY period""", "head_travel"))
def _(spark, sf):
    return rp.series(fact_index(spark, sf), "IDX-T", "daily", "travel", "leisure_tilted", "1996-01-01", "1999-12-31").select("period", "value")


@query("P22_route_subseries", sql("""
  SELECT period, route, apw_days, round(value, 6) AS value FROM route_travel WHERE route = 'ASIA'""", "route_travel"))
def _(spark, sf):
    return rp.subseries(fact_index(spark, sf), "IDX-T", "ASIA").select("period", "route", "apw_days", "value")


@query("S3_index_upsert", sql("""
  SELECT sha256(concat_ws('|', 'IDX-T', CAST(period AS VARCHAR), 'daily', 'travel', omega_preset, '1.0.0', 'v1')) AS index_id, period, omega_preset,
         round(CASE WHEN omega_preset = 'uniform' THEN value * 2 ELSE value END, 6) AS value, CASE WHEN omega_preset = 'uniform' THEN 2 ELSE 1 END AS written_by
  FROM head_travel""", "head_travel"))
def _(spark, sf):
    from ..sources import index_store, snapshots
    path = work_dir(spark, "index")
    old = materialise(fact_index(spark, sf).where(F.col("index_code") == "IDX-T").withColumn("computed_at", F.lit(1)), "index")
    index_store.write_index_values(old, path)
    new = old.where(F.col("omega_preset") == "uniform").withColumns({"value": F.col("value") * 2, "computed_at": F.lit(2)})
    index_store.write_index_values(new, path)
    snapshots.retire(spark, path)
    by = index_store.series_commits(spark, path)
    return index_store.with_family(index_store.read_index_values(spark, path)).join(by, index_store.SERIES).select("index_id", "period", "omega_preset", "value", F.col("commit").alias("written_by"))


@query("S4_cell_detail", sql(f"""
  SELECT period, {CELL_SQL}, round(adjusted_raw, 6) AS adjusted, round(adjusted, 6) AS adjusted_smoothed, round(matched, 6) AS matched,
         round(laf, 6) AS laf, round(availability, 6) AS availability, n_matched, n_quotes, suppressed, 'IDX-T' AS index_code, 'book' AS basis
  FROM smooth_book""", "smooth_book"))
def _(spark, sf):
    from ..sources.index_store import cell_rows
    return cell_rows(frames(spark, sf).cells, "IDX-T", "book", "run-1").drop("run_id")


@query("S2_idempotent_append", sql("""
  SELECT source, count(*) AS n, min(price) AS low, max(price) AS high FROM
    (SELECT route, carrier, apw_days, flight_number, fare_family, cabin, stops, collected_date, source, arg_min(price, (price, order_id)) AS price
     FROM quotes GROUP BY ALL) WHERE year(collected_date) >= 1998 GROUP BY 1""", "quotes"))
def _(spark, sf):
    from ..sources.quotes import QUOTE_KEY, new_quotes
    quotes = materialise(R.retail_quotes(spark, sf).select(*QUOTE_KEY, "price", "order_id"), "quotes")  # read as the batch and as the store
    stored = quotes.where(F.year("collected_date") < 1998)
    fresh = new_quotes(quotes, stored)
    return fresh.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("price").alias("low"), F.max("price").alias("high"))


@query("S1_publishable_scan", sql("""
  SELECT disposition, route, count(*) AS n FROM cleaned WHERE disposition IN ('ACCEPTED', 'WINSORISED') GROUP BY ALL""", "cleaned"))
def _(spark, sf):
    from ..session import work_dir
    from ..sources.quotes import scan_quotes
    path = work_dir(spark, "quotes")
    stored_quotes(spark, sf).select("route", "disposition", "price_T", "collected_date").write.partitionBy("collected_date").parquet(path)
    return scan_quotes(spark, path, publishable_only=True).groupBy("disposition", "route").agg(F.count(F.lit(1)).alias("n"))


@query("A35_latest_run", """
  SELECT CAST(year(o) AS VARCHAR) AS run_id, o AS completed_at, 'completed' AS status, n FROM
    (SELECT CAST(max(o_orderdate) AS DATE) AS o, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY year(o_orderdate))
  ORDER BY completed_at DESC LIMIT 1""")
def _(spark, sf):
    runs = (R.table(spark, sf, "orders").where(F.col("o_orderstatus") != "P").groupBy(F.year("o_orderdate").cast("string").alias("run_id"))
            .agg(F.max("o_orderdate").cast("date").alias("completed_at"), F.count(F.lit(1)).alias("n")).withColumn("status", F.lit("completed")))
    return rp.latest_run(runs)


@query("K5_recent_runs", """
  SELECT CAST(year(o_orderdate) AS VARCHAR) AS run_id, CAST(max(o_orderdate) AS DATE) AS completed_at, count(*) AS n
  FROM orders GROUP BY year(o_orderdate) ORDER BY 2 DESC LIMIT 3""")
def _(spark, sf):
    runs = (R.table(spark, sf, "orders").groupBy(F.year("o_orderdate").cast("string").alias("run_id"))
            .agg(F.max("o_orderdate").cast("date").alias("completed_at"), F.count(F.lit(1)).alias("n")))
    return runs.orderBy(F.desc("completed_at")).limit(3)


@query("S12_sdmx_series", sql("""
  SELECT omega_preset, count(*) AS n, CAST(min(period) AS VARCHAR) AS base_period,
         string_agg(CAST(period AS VARCHAR), ',' ORDER BY period) AS periods FROM head_travel GROUP BY 1""", "head_travel"))
def _(spark, sf):
    from ..sources.export import sdmx_documents
    docs = sdmx_documents(fact_index(spark, sf).where(F.col("index_code") == "IDX-T"))
    body = F.from_json("document", "data struct<structure:struct<dimensions:struct<observation:array<struct<values:array<struct<id:string>>>>>>>")
    ids = body["data"]["structure"]["dimensions"]["observation"][0]["values"]["id"]
    return docs.select("omega_preset", F.size(ids).cast("long").alias("n"), ids[0].alias("base_period"), F.array_join(ids, ",").alias("periods"))


@query("S13_dimension_scan", sql("""
  SELECT b.route, stratum, km, count(q.route) AS n FROM d_basket b LEFT JOIN d_km USING (route) LEFT JOIN quotes q USING (route) GROUP BY ALL""",
                             "d_basket", "d_km", "quotes"))
def _(spark, sf):
    seen = R.retail_quotes(spark, sf).groupBy("route").agg(F.count(F.lit(1)).alias("n"))
    return (R.basket(spark).join(R.distances(spark), "route", "left").join(seen, "route", "left")
            .select("route", "stratum", "km", F.coalesce("n", F.lit(0).cast("long")).alias("n")))


@query("A34_run_hash", sql("SELECT root AS output_hash, n FROM " + merkle_sql(
    "SELECT concat_ws('|', omega_preset, CAST(period AS VARCHAR), CAST(n_apw AS VARCHAR), CAST(n_matched AS VARCHAR)) AS line FROM head_travel"), "head_travel"))
def _(spark, sf):
    from ..sources.index_store import output_hash
    heads = agg.lead_stage(frames(spark, sf, TRAVEL).by_apw, R.omega_weights(spark))
    return output_hash(heads, ["omega_preset", "period", "n_apw", "n_matched"])


@query("A34_order_free_input_hash", sql("""
  SELECT CAST(sum(('0x' || substr(md5(concat_ws('|', apw_days, carrier, cents, route)), 1, 8))::BIGINT) AS VARCHAR) AS input_hash, count(*) AS n
  FROM (SELECT *, CAST(round(price * 100) AS BIGINT) AS cents FROM quotes)""", "quotes"))
def _(spark, sf):
    from ..sources.index_store import input_hash
    quotes = R.retail_quotes(spark, sf)
    return input_hash(quotes.withColumn("cents", F.round(F.col("price") * 100).cast("long")), [*CELL, "cents"])
