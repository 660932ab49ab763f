"""Registered queries: preparation, elementary indices, stages, roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import geo_mean
from ..operators import aggregate as agg
from ..operators import elementary as el
from ..operators import prepare
from ..params import Method
from ..plans.index import Weights, compute, fan_out, relatives, sensitivity
from ..schemas import CELL
from ..sources import retail as R
from .registry import query
from .sqltext import CELL as CELL_SQL
from .sqltext import FLIGHT, PRODUCT, sql

BOOK = Method(bootstrap_draws=0)
TRAVEL = Method(basis="travel", bootstrap_draws=0)


def weights(spark) -> Weights:
    return Weights(R.route_weights(spark), R.carrier_weights(spark), R.omega_weights(spark))


def prepared(spark, sf, basis="book"):
    return prepare.collapse_sources(prepare.with_period(prepare.publishable(R.retail_quotes(spark, sf)), basis))


def rel(spark, sf, method=BOOK):
    return relatives(R.retail_quotes(spark, sf), method)


def frames(spark, sf, method=BOOK):
    return compute(R.retail_quotes(spark, sf), weights(spark), method)


@query("P1_publishable_filter", sql("""
  SELECT route, carrier, count(*) AS n, round(sum(price), 2) AS total FROM quotes
  WHERE disposition IN ('ACCEPTED', 'WINSORISED') AND price > 0 GROUP BY ALL""", "quotes"))
def _(spark, sf):
    return (prepare.publishable(R.retail_quotes(spark, sf)).groupBy("route", "carrier")
            .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("price"), 2).alias("total")))


@query("P3_dual_basis", sql("""
  SELECT 'book' AS basis, collected_date AS period, count(*) AS n FROM quotes GROUP BY ALL
  UNION ALL SELECT 'travel', departure_date, count(*) FROM quotes GROUP BY ALL""", "quotes"))
def _(spark, sf):
    return prepare.both_bases(R.retail_quotes(spark, sf)).groupBy("basis", "period").agg(F.count(F.lit(1)).alias("n"))


@query("A1_source_collapse", sql(f"SELECT {PRODUCT}, period, round(price, 6) AS price, n_sources FROM prep_book", "prep_book"))
def _(spark, sf):
    return prepared(spark, sf).drop("lp")


@query("A2_base_period", sql("""
  SELECT 'book' AS basis, base_period FROM base_book UNION ALL SELECT 'travel', base_period FROM base_travel""",
                             "base_book", "base_travel"))
def _(spark, sf):
    stacked = prepare.both_bases(prepare.publishable(R.retail_quotes(spark, sf)))
    return prepare.base_periods(prepare.collapse_sources(stacked, ["basis"]), ["basis"])


@query("K3_earliest_best_covered_period", sql("""
  SELECT period, count(DISTINCT apw_days) AS n_apw FROM prep_travel GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1""", "prep_travel"))
def _(spark, sf):
    return prepare.window_coverage(prepared(spark, sf, "travel")).orderBy(F.desc("n_apw"), "period").limit(1)


@query("A3_jevons", sql(f"""
  SELECT period, {CELL_SQL}, round(100 * exp(avg(lr)), 6) AS matched, count(lr) AS n_matched
  FROM rel_book WHERE lr IS NOT NULL GROUP BY ALL""", "rel_book"))
def _(spark, sf):
    return el.jevons(rel(spark, sf))


@query("A4_A5_A6_dutot_carli_se", sql(f"""
  SELECT period, {CELL_SQL}, round(100 * exp(avg(lr)), 6) AS jevons, round(100 * avg(price) / avg(exp(lp0)), 6) AS dutot,
         round(100 * avg(exp(lr)), 6) AS carli,
         round(CASE WHEN count(lr) >= 2 THEN 100 * exp(avg(lr)) * stddev_samp(lr) / sqrt(count(lr)) END, 6) AS jevons_se,
         count(lr) AS n_matched
  FROM rel_book WHERE lr IS NOT NULL GROUP BY ALL""", "rel_book"))
def _(spark, sf):
    return el.elementary_family(rel(spark, sf))


@query("J4_product_base_join", sql(f"""
  SELECT period, {PRODUCT}, round(lp0, 6) AS lp0, round(lr, 6) AS lr FROM rel_book WHERE lp0 IS NOT NULL""", "rel_book"))
def _(spark, sf):
    p = prepared(spark, sf)
    joined = el.attach_base_by_join(p, prepare.base_periods(p).scalar())
    return joined.select("period", *[c.strip() for c in PRODUCT.split(",")], "lp0", "lr")


@query("J5_flight_base_join", sql(f"""
  SELECT period, {FLIGHT}, round(lr_sum, 6) AS lr_sum, lr_n, round(laf_lr, 6) AS laf_lr, n_quotes
  FROM blocks_book""", "blocks_book"))
def _(spark, sf):
    return el.flight_blocks(rel(spark, sf))


@query("A7_lowest_fare_index", sql(f"""
  SELECT period, {CELL_SQL}, round(100 * exp(avg(laf_lr)), 6) AS laf FROM blocks_book
  WHERE laf_lr IS NOT NULL GROUP BY ALL""", "blocks_book"))
def _(spark, sf):
    return el.lowest_fare_index(el.flight_blocks(rel(spark, sf)))


@query("A8_W6_availability", sql(f"""
  SELECT period, {CELL_SQL}, n_families, n_families_ref, round(availability, 6) AS availability FROM fam_book""", "fam_book"))
def _(spark, sf):
    return el.family_counts(prepared(spark, sf))


@query("A9_J6_P16_cells", sql(f"""
  SELECT period, {CELL_SQL}, round(matched, 6) AS matched, n_matched, round(laf, 6) AS laf, n_quotes, n_families,
         n_families_ref, round(availability, 6) AS availability, round(adjusted, 6) AS adjusted, suppressed
  FROM cells_book""", "cells_book"))
def _(spark, sf):
    return el.cells(rel(spark, sf))


@query("W1_centred_geometric_ma", sql(f"""
  SELECT period, {CELL_SQL}, round(adjusted, 6) AS adjusted, round(adjusted_raw, 6) AS adjusted_raw
  FROM smooth_book""", "smooth_book"))
def _(spark, sf):
    return frames(spark, sf).cells.select("period", *CELL, "adjusted", "adjusted_raw")


ROUTE_SQL = """SELECT period, route, apw_days, round(value, 6) AS value, n_carriers, n_matched,
  round(carrier_weight_sum, 6) AS carrier_weight_sum FROM route_{b}"""
APW_SQL = """SELECT period, apw_days, round(value, 6) AS value, n_routes, n_matched,
  round(coverage_pct, 6) AS coverage_pct FROM apw_{b}"""
HEAD_SQL = """SELECT omega_preset, period, round(value, 6) AS value, n_apw, n_matched,
  round(coverage_pct, 6) AS coverage_pct, round(omega_covered, 6) AS omega_covered FROM head_{b}"""


@query("A10_J7_carrier_stage", sql(ROUTE_SQL.format(b="book"), "route_book"))
def _(spark, sf):
    return frames(spark, sf).by_route


@query("A11_route_stage", sql(APW_SQL.format(b="travel"), "apw_travel"))
def _(spark, sf):
    return frames(spark, sf, TRAVEL).by_apw


@query("A12_lead_time_stage", sql(HEAD_SQL.format(b="travel"), "head_travel"))
def _(spark, sf):
    return agg.lead_stage(frames(spark, sf, TRAVEL).by_apw, R.omega_weights(spark))


@query("A14_monthly_weekly_rollup", sql("""
  SELECT frequency, CAST(date_trunc(unit, period) AS DATE) AS period,
         round(exp(avg(CASE WHEN value > 0 THEN ln(value) END)), 6) AS value, CAST(sum(n_matched) AS BIGINT) AS n_matched,
         count(*) AS n_days, round(avg(coverage_pct), 6) AS coverage_pct
  FROM head_book CROSS JOIN (VALUES ('weekly', 'week'), ('monthly', 'month'), ('yearly', 'year')) f(frequency, unit)
  WHERE omega_preset = 'uniform' GROUP BY ALL""", "head_book"))
def _(spark, sf):
    head = frames(spark, sf).headline
    parts = [agg.to_frequency(head, f).withColumn("frequency", F.lit(f)) for f in ("weekly", "monthly", "yearly")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("A14b_run_rollup", sql("""
  SELECT CAST(date_trunc('year', period) AS DATE) AS period, round(exp(avg(ln(value))), 6) AS value,
         CAST(NULL AS DOUBLE) AS se, CAST(sum(n_matched) AS BIGINT) AS n_matched, CAST(sum(n_quotes) AS BIGINT) AS n_quotes,
         CAST(sum(n_cells) AS BIGINT) AS n_cells, max(n_apw) AS n_apw, round(max(omega_covered), 6) AS omega_covered,
         round(avg(coverage_pct), 6) AS coverage_pct, CAST(NULL AS DOUBLE) AS ci_low, CAST(NULL AS DOUBLE) AS ci_high
  FROM head_book JOIN (SELECT period, sum(n_quotes) AS n_quotes, count(*) FILTER (NOT suppressed) AS n_cells
                       FROM cells_book GROUP BY 1) USING (period)
  WHERE omega_preset = 'uniform' GROUP BY 1""", "head_book", "cells_book"))
def _(spark, sf):
    return agg.to_frequency_run(frames(spark, sf).headline, "yearly")


@query("A15_geometric_mean", sql("""
  SELECT fare_family, round(exp(avg(ln(price))), 6) AS geo_mean FROM quotes WHERE price > 0 GROUP BY 1""", "quotes"))
def _(spark, sf):
    return R.retail_quotes(spark, sf).groupBy("fare_family").agg(geo_mean(F.col("price")).alias("geo_mean"))


@query("A16_headline_counts", sql("""
  SELECT period, count(*) FILTER (NOT suppressed) AS n_cells, CAST(sum(n_quotes) AS BIGINT) AS n_quotes
  FROM cells_travel GROUP BY 1""", "cells_travel"))
def _(spark, sf):
    return agg.headline_counts(frames(spark, sf, TRAVEL).cells)


@query("A17_run_diagnostics", sql("""
  SELECT count(DISTINCT period) AS n_periods, count(*) AS n_cells, count(*) FILTER (suppressed) AS n_suppressed,
         round(100.0 * count(*) FILTER (suppressed) / count(*), 2) AS suppression_pct,
         round(avg(availability), 4) AS mean_availability FROM cells_travel""", "cells_travel"))
def _(spark, sf):
    return agg.diagnostics(frames(spark, sf, TRAVEL).cells)


@query("P19_chain_link", sql("""
  SELECT period, round(value * 105.63 / 100, 6) AS value, round(value, 6) AS value_native
  FROM head_book WHERE omega_preset = 'uniform'""", "head_book"))
def _(spark, sf):
    linked = frames(spark, sf, Method(bootstrap_draws=0, link_factor=105.63))
    return linked.headline.select("period", "value", "value_native")


@query("P20_thin_period_withholding", sql("""
  SELECT omega_preset, count(*) FILTER (omega_covered < 0.6) AS n_withheld, count(*) FILTER (omega_covered >= 0.6) AS n_published
  FROM head_travel GROUP BY 1""", "head_travel"))
def _(spark, sf):
    heads = agg.lead_stage(frames(spark, sf, TRAVEL).by_apw, R.omega_weights(spark))
    return agg.withheld_count(heads, by=["omega_preset"])


@query("M1_headline_index", sql("""
  SELECT period, round(value, 6) AS value, n_apw, n_matched, round(coverage_pct, 6) AS coverage_pct,
         round(omega_covered, 6) AS omega_covered, n_cells, n_quotes
  FROM head_book JOIN (SELECT period, count(*) FILTER (NOT suppressed) AS n_cells, CAST(sum(n_quotes) AS BIGINT) AS n_quotes
                       FROM cells_book GROUP BY 1) USING (period)
  WHERE omega_preset = 'uniform'""", "head_book", "cells_book"))
def _(spark, sf):
    head = frames(spark, sf).headline
    return head.drop("omega_preset", "se", "ci_low", "ci_high", "value_unsmoothed", "value_native")


@query("M2_effective_weights", sql(f"""
  SELECT period, {CELL_SQL}, round(100 *
      (CASE WHEN sc > 0 THEN phi / sc ELSE 1.0 / nc END) * (CASE WHEN sw > 0 THEN w / sw ELSE 1.0 / nr END)
      * (CASE WHEN so > 0 THEN omega / so ELSE 1.0 / na END), 6) AS weight_pct
  FROM (SELECT *, sum(phi) OVER (PARTITION BY period, apw_days, route) AS sc, count(*) OVER (PARTITION BY period, apw_days, route) AS nc
        FROM (SELECT s.*, coalesce(phi, 0) AS phi FROM smooth_travel s LEFT JOIN w_carriers USING (route, carrier)
              WHERE NOT suppressed AND adjusted IS NOT NULL))
  JOIN (SELECT period, apw_days, route, w, sum(w) OVER (PARTITION BY period, apw_days) AS sw, count(*) OVER (PARTITION BY period, apw_days) AS nr
        FROM (SELECT r.period, r.apw_days, r.route, coalesce(w, 0) AS w FROM route_travel r LEFT JOIN w_routes USING (route)))
    USING (period, apw_days, route)
  JOIN (SELECT period, apw_days, omega, sum(omega) OVER (PARTITION BY period) AS so, count(*) OVER (PARTITION BY period) AS na
        FROM apw_travel JOIN w_omega USING (apw_days) WHERE omega_preset = 'uniform') USING (period, apw_days)""",
                                "smooth_travel", "route_travel", "apw_travel", "w_omega", "w_carriers", "w_routes"))
def _(spark, sf):
    w = weights(spark)
    f = frames(spark, sf, TRAVEL)
    omega = w.omega.where(F.col("omega_preset") == "uniform")
    out = agg.effective_weights(f.cells, w.carriers, w.routes, omega)
    return out.select("period", *CELL, (100 * F.col("weight")).alias("weight_pct"))


@query("K1_canonical_order", sql(f"""
  SELECT period, {CELL_SQL}, round(adjusted, 6) AS adjusted FROM smooth_book ORDER BY {CELL_SQL}, period""", "smooth_book"))
def _(spark, sf):
    return frames(spark, sf).cells.select("period", *CELL, "adjusted").orderBy(*CELL, "period")


@query("W15_adjacent_window_elasticity", sql("""
  SELECT * FROM (
    SELECT period, apw_days, lead(apw_days) OVER w AS next_apw,
           round((lead(ln(value)) OVER w - ln(value)) / (lead(ln(apw_days)) OVER w - ln(apw_days)), 6) AS eta,
           round((arg_max(ln(value), apw_days) OVER (PARTITION BY period) - max(CASE WHEN apw_days = 1 THEN ln(value) END) OVER (PARTITION BY period))
             / nullif(ln(max(apw_days) OVER (PARTITION BY period)) - ln(1), 0), 6) AS eta_near_far
    FROM apw_book WHERE value > 0 WINDOW w AS (PARTITION BY period ORDER BY apw_days)) WHERE next_apw IS NOT NULL""", "apw_book"))
def _(spark, sf):
    return agg.adjacent_elasticity(frames(spark, sf).by_apw)
