"""Registered queries: bootstrap, elasticity, mixtures, back-tests, nowcasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregate as agg
from ..operators import backtest as bt
from ..operators import bootstrap as boot
from ..operators import elasticity as els
from ..operators import ladder
from ..operators import elementary as el
from ..operators import nowcast as nc
from ..operators import reproduce as rp
from ..params import Method
from ..plans import publish
from ..session import work_dir
from ..sources import index_store
from ..sources import retail as R
from .index_family import frames, rel, weights
from .registry import query
from .sqltext import CELL, cte, sql

DRAWS = 200

def bootstrap_twins(b: str) -> None:
    cte(f"eff_{b}", f"""
      SELECT period, route, carrier, apw_days, availability,
          (CASE WHEN sc > 0 THEN phi / sc ELSE 1.0 / nc END) * (CASE WHEN sw > 0 THEN w / sw ELSE 1.0 / nr END)
          * (CASE WHEN so > 0 THEN omega / so ELSE 1.0 / na END) AS weight
      FROM (SELECT *, sum(phi) OVER (PARTITION BY period, apw_days, route) AS sc, count(*) OVER (PARTITION BY period, apw_days, route) AS nc
            FROM (SELECT s.*, coalesce(phi, 0) AS phi FROM smooth_{b} s LEFT JOIN w_carriers USING (route, carrier)
                  WHERE NOT suppressed AND adjusted IS NOT NULL))
      JOIN (SELECT period, apw_days, route, w, sum(w) OVER (PARTITION BY period, apw_days) AS sw, count(*) OVER (PARTITION BY period, apw_days) AS nr
            FROM (SELECT r.period, r.apw_days, r.route, coalesce(w, 0) AS w FROM route_{b} r LEFT JOIN w_routes USING (route)))
        USING (period, apw_days, route)
      JOIN (SELECT period, apw_days, omega, sum(omega) OVER (PARTITION BY period) AS so, count(*) OVER (PARTITION BY period) AS na
            FROM apw_{b} JOIN w_omega USING (apw_days) WHERE omega_preset = 'uniform') USING (period, apw_days)""",
        f"smooth_{b}", f"route_{b}", f"apw_{b}", "w_omega", "w_carriers", "w_routes")
    cte(f"numbered_{b}", f"""
      SELECT *, row_number() OVER (PARTITION BY period, {CELL} ORDER BY flight_number) - 1 AS i, count(*) OVER (PARTITION BY period, {CELL}) AS n
      FROM blocks_{b} SEMI JOIN eff_{b} USING (period, {CELL}) WHERE lr_n > 0 OR laf_lr IS NOT NULL""", f"blocks_{b}", f"eff_{b}")
    cte(f"drawn_{b}", f"""
      SELECT period, {CELL}, draw, sum(coalesce(b.lr_sum, 0)) AS s, sum(b.lr_n) AS c, sum(coalesce(b.laf_lr, 0)) AS l, count(b.laf_lr) AS h
      FROM (SELECT period, {CELL}, draw, CAST('0x' || substr(md5(concat_ws('|', '7', period, {CELL}, draw, i)), 1, 8) AS BIGINT) % n AS pick
            FROM numbered_{b}, range({DRAWS}) d(draw)) p
      JOIN numbered_{b} b USING (period, {CELL}) WHERE b.i = p.pick GROUP BY ALL""", f"numbered_{b}")
    cte(f"head_ci_{b}", f"""
      SELECT period, stddev_samp(stat) AS se, quantile_cont(stat, 0.05) AS lo, quantile_cont(stat, 0.95) AS hi FROM (
        SELECT period, draw, sum(weight * v) / sum(weight) AS stat FROM (
          SELECT d.period, draw, weight, CASE WHEN c > 0 AND h > 0 THEN exp(availability * ln(100 * exp(s / c)) + (1 - availability) * ln(100 * exp(l / h)))
                 WHEN c > 0 THEN 100 * exp(s / c) WHEN h > 0 THEN 100 * exp(l / h) END AS v
          FROM drawn_{b} d JOIN eff_{b} USING (period, route, carrier, apw_days)) WHERE v IS NOT NULL GROUP BY ALL) GROUP BY 1""", f"drawn_{b}", f"eff_{b}")


for _basis in ("book", "travel"):
    bootstrap_twins(_basis)


@query("M3_flight_block_bootstrap", sql("""
  SELECT h.period, round(h.value, 6) AS value, round(r.value, 6) AS value_unsmoothed, round(se * h.value / r.value, 6) AS se,
         round(lo * h.value / r.value, 6) AS ci_low, round(hi * h.value / r.value, 6) AS ci_high
  FROM head_book h JOIN head_raw_book r USING (omega_preset, period) LEFT JOIN head_ci_book USING (period) WHERE omega_preset = 'uniform'""",
                                        "head_book", "head_raw_book", "head_ci_book"))
def _(spark, sf):
    return frames(spark, sf, Method(bootstrap_draws=DRAWS)).headline.select("period", "value", "value_unsmoothed", "se", "ci_low", "ci_high")


def published_sql() -> str:
    """Every row of the published table, for quotes whose three variant prices are equal."""
    pick = "index_code, period, frequency, basis, omega_preset, round(value, 6) AS value, round(se, 6) AS se, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, n_quotes, n_cells, n_matched, " \
           "round(coverage_pct, 6) AS coverage_pct, round(omega_covered, 6) AS omega_covered"
    parts = []
    for b in ("book", "travel"):
        head = f"(SELECT * FROM head_{b} WHERE omega_covered >= 0.6)"
        parts.append(f"""SELECT 'IDX-' || v AS index_code, h.period, 'daily' AS frequency, '{b}' AS basis, h.omega_preset, h.value, CASE WHEN own THEN se * h.value / r.value END AS se,
  CASE WHEN own THEN lo * h.value / r.value END AS ci_low, CASE WHEN own THEN hi * h.value / r.value END AS ci_high, n_quotes, n_cells, h.n_matched, h.coverage_pct, h.omega_covered
  FROM (SELECT *, v = 'T' AND omega_preset = 'uniform' AS own FROM {head}, (VALUES ('B'), ('T'), ('A')) x(v)) h JOIN head_raw_{b} r ON r.omega_preset = 'uniform' AND r.period = h.period
  LEFT JOIN head_ci_{b} i ON i.period = h.period
  JOIN (SELECT period, count(*) FILTER (NOT suppressed) AS n_cells, sum(n_quotes)::BIGINT AS n_quotes FROM cells_{b} GROUP BY 1) c ON c.period = h.period""")
        none = "NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::BIGINT, NULL::BIGINT"
        parts.append(f"""SELECT 'IDX-' || v, date_trunc(unit, period)::DATE, frequency, '{b}', omega_preset, exp(avg(CASE WHEN value > 0 THEN ln(value) END)), {none}, sum(n_matched)::BIGINT, avg(coverage_pct), NULL
  FROM {head}, (VALUES ('B'), ('T'), ('A')) x(v), (VALUES ('weekly', 'week'), ('monthly', 'month')) f(frequency, unit) GROUP BY ALL""")
        parts.append(f"SELECT 'IDX-T:apw=' || apw_days, period, 'daily', '{b}', 'uniform', value, {none}, n_matched, coverage_pct, NULL FROM apw_{b}")
        parts.append(f"SELECT 'IDX-T:route=' || route || ':apw=' || apw_days, period, 'daily', '{b}', 'uniform', value, {none}, n_matched, NULL, NULL FROM route_{b}")
    names = [f"{n}_{b}" for b in ("book", "travel") for n in ("head", "head_raw", "head_ci", "cells", "apw", "route")]
    return sql(f"SELECT {pick} FROM ({' UNION ALL '.join(parts)})", *names)


@query("M1_published_table", published_sql())
def _(spark, sf):
    root = work_dir(spark, "published")
    priced = R.retail_quotes(spark, sf).withColumns({c: F.col("price") for c in ("price_B", "price_T", "price_A")})
    publish.publish_priced(priced, weights(spark), Method(bootstrap_draws=DRAWS), f"{root}/index", f"{root}/cells", "run-1", 1)
    return index_store.read_index_values(spark, f"{root}/index").select(
        "index_code", "period", "frequency", "basis", "omega_preset", "value", "se", "ci_low", "ci_high", "n_quotes", "n_cells", "n_matched", "coverage_pct", "omega_covered")


@query("M4_pooled_bootstrap", sql(f"""
  SELECT period, round(value, 6) AS value, n_blocks, round(CASE WHEN n_blocks >= 2 THEN se END, 6) AS se,
         round(CASE WHEN n_blocks >= 2 THEN least(lo, value) END, 6) AS ci_low, round(CASE WHEN n_blocks >= 2 THEN greatest(hi, value) END, 6) AS ci_high
  FROM (SELECT period, 100 * exp(sum(lr_sum) / sum(lr_n)) AS value, count(*) AS n_blocks FROM blocks_book WHERE lr_n > 0 GROUP BY 1)
  JOIN (SELECT period, stddev_samp(stat) AS se, quantile_cont(stat, 0.05) AS lo, quantile_cont(stat, 0.95) AS hi FROM
    (SELECT p.period, draw, 100 * exp(sum(lr_sum) / sum(lr_n)) AS stat FROM
      (SELECT period, draw, CAST('0x' || substr(md5(concat_ws('|', '7', period, draw, i)), 1, 8) AS BIGINT) % n AS pick FROM nb, range({DRAWS}) d(draw)) p
      JOIN nb ON nb.period = p.period AND nb.i = p.pick GROUP BY ALL) GROUP BY 1) USING (period)""", "blocks_book").replace(
    "\n\n  SELECT period, round(value, 6) AS value, n_blocks", f""",
nb AS (SELECT period, lr_sum, lr_n, row_number() OVER (PARTITION BY period ORDER BY {CELL}, flight_number) - 1 AS i, count(*) OVER (PARTITION BY period) AS n
       FROM blocks_book WHERE lr_n > 0)
  SELECT period, round(value, 6) AS value, n_blocks"""))
def _(spark, sf):
    return boot.pooled_interval(el.flight_blocks(rel(spark, sf)), DRAWS)


ESTIMATES = 40


def estimator_sql(statistic: str) -> str:
    """Pooled flight-block bootstrap of a statistic of the rows (period, draw, lr, pos, total)."""
    return sql(f"""
  SELECT v.period, round(value, 6) AS value, n_blocks, round(CASE WHEN n_blocks >= 2 THEN se END, 6) AS se,
         round(CASE WHEN n_blocks >= 2 THEN least(lo, value) END, 6) AS ci_low, round(CASE WHEN n_blocks >= 2 THEN greatest(hi, value) END, 6) AS ci_high
  FROM (SELECT period, stat AS value FROM stats WHERE draw = -1) v
  JOIN (SELECT period, stddev_samp(stat) AS se, quantile_cont(stat, 0.05) AS lo, quantile_cont(stat, 0.95) AS hi FROM stats WHERE draw >= 0 GROUP BY 1) i ON i.period = v.period
  JOIN (SELECT period, max(n) AS n_blocks FROM nb GROUP BY 1) c ON c.period = v.period""", "rel_book").replace(f"\n\n  SELECT v.period", f""",
nb AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY {CELL}, flight_number) - 1 AS i, count(*) OVER (PARTITION BY period) AS n
       FROM (SELECT DISTINCT period, {CELL}, flight_number FROM rel_book WHERE lr IS NOT NULL)),
picks AS (SELECT period, draw, CAST('0x' || substr(md5(concat_ws('|', '7', period, draw, i)), 1, 8) AS BIGINT) % n AS pick FROM nb, range({ESTIMATES}) d(draw)
          UNION ALL SELECT period, -1, i FROM nb),
pooled AS (SELECT p.period, p.draw, r.lr, row_number() OVER w AS pos, count(*) OVER (PARTITION BY p.period, p.draw) AS total
  FROM picks p JOIN nb ON nb.period = p.period AND nb.i = p.pick JOIN rel_book r ON r.lr IS NOT NULL AND r.period = nb.period AND r.route = nb.route
    AND r.carrier = nb.carrier AND r.apw_days = nb.apw_days AND r.flight_number = nb.flight_number WINDOW w AS (PARTITION BY p.period, p.draw ORDER BY r.lr)),
stats AS (SELECT period, draw, 100 * exp({statistic}) AS stat FROM pooled GROUP BY ALL)
  SELECT v.period""")


@query("M4_median_bootstrap", estimator_sql("median(lr)"))
def _(spark, sf):
    return boot.estimated_interval(rel(spark, sf), boot.median, ESTIMATES)


@query("M4_trimmed_mean_bootstrap", estimator_sql("avg(lr) FILTER (pos > floor(0.1 * total) AND pos <= total - floor(0.1 * total))"))
def _(spark, sf):
    return boot.estimated_interval(rel(spark, sf), boot.trimmed_mean, ESTIMATES)


def elasticity_rows(spark, sf):
    return els.observations(R.retail_quotes(spark, sf))


def slope_sql(by: str) -> str:
    key = f"{by}," if by else ""
    part = f"PARTITION BY {by}" if by else ""
    using = f"USING ({by})" if by else "ON TRUE"
    return f"""
WITH o AS (SELECT route, carrier, CAST(flight_number AS VARCHAR) AS flight_number, ln(price) AS y, ln(apw_days) AS x1, ln(apw_days) * ln(apw_days) AS x2 FROM q WHERE price > 0),
m AS (SELECT {key} count(*) AS n, avg(x1) AS a1, avg(x2) AS a2, avg(y) AS ay, var_pop(x1) AS a, covar_pop(x1, x2) AS b, var_pop(x2) AS c,
             covar_pop(x1, y) AS d, covar_pop(x2, y) AS e, var_pop(y) AS v FROM o {"GROUP BY " + by if by else ""}),
f AS (SELECT *, (d * c - e * b) / (a * c - b * b) AS b1, (e * a - d * b) / (a * c - b * b) AS b2 FROM m),
z AS (SELECT {"o." + by + "," if by else ""} sum((x1 - a1) * u) AS z1, sum((x2 - a2) * u) AS z2 FROM
       (SELECT o.*, a1, a2, y - ay - b1 * (x1 - a1) - b2 * (x2 - a2) AS u FROM o JOIN f {using}) o GROUP BY route, carrier, flight_number),
s AS (SELECT {key} count(*) AS g, sum(z1 * z1) AS m11, sum(z1 * z2) AS m12, sum(z2 * z2) AS m22 FROM z {"GROUP BY " + by if by else ""}),
i AS (SELECT *, c / (n * (a * c - b * b)) AS i11, -b / (n * (a * c - b * b)) AS i12, a / (n * (a * c - b * b)) AS i22,
        1.0 * g / (g - 1) * (n - 1) / (n - 3) AS k FROM f JOIN s {using}),
r AS (SELECT *, k * (i11 * i11 * m11 + 2 * i11 * i12 * m12 + i12 * i12 * m22) AS c11,
        k * (i11 * i12 * m11 + (i11 * i22 + i12 * i12) * m12 + i12 * i22 * m22) AS c12,
        k * (i12 * i12 * m11 + 2 * i12 * i22 * m12 + i22 * i22 * m22) AS c22, (b1 * d + b2 * e) / v AS r2 FROM i)
""".replace("FROM q WHERE", "FROM (SELECT r_name AS route, l_returnflag AS carrier, l_suppkey % 3 AS flight_number, l_extendedprice AS price, "
            "[1, 7, 15, 30, 45][l_partkey % 5 + 1] AS apw_days FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey "
            "JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey) WHERE")


FIT_COLUMNS = """round(b1, 6) AS beta1, round(b2, 6) AS beta2, round(sqrt(c11), 6) AS se_beta1, round(sqrt(c22), 6) AS se_beta2, round(r2, 6) AS r_squared, n AS n_obs, g AS n_clusters"""
FIT = ["beta1", "beta2", "se_beta1", "se_beta2", "r_squared", "n_obs", "n_clusters"]


@query("M5_lead_time_elasticity", slope_sql("") + f"SELECT {FIT_COLUMNS} FROM r")
def _(spark, sf):
    return els.fit(elasticity_rows(spark, sf), effects=()).select(*FIT)


@query("M7_route_elasticity", slope_sql("route") + f"SELECT route, {FIT_COLUMNS} FROM r")
def _(spark, sf):
    return els.fit(elasticity_rows(spark, sf), by=["route"], effects=()).select("route", *FIT)


@query("M6_elasticity_surface", slope_sql("route") + """
SELECT route, apw_days, round(b1 + 2 * b2 * ln(apw_days), 6) AS eta, round(sqrt(c11 + 4 * ln(apw_days) * c12 + 4 * ln(apw_days) * ln(apw_days) * c22), 6) AS eta_se,
  round(CASE WHEN b2 > 1e-9 AND exp(-b1 / (2 * b2)) BETWEEN 1 AND 365 THEN exp(-b1 / (2 * b2)) END, 4) AS tau_star,
  CASE WHEN NOT b2 > 1e-9 THEN 'no interior minimum' WHEN NOT exp(-b1 / (2 * b2)) BETWEEN 1 AND 365 THEN 'minimum outside 1..365 days' END AS note
FROM r, (SELECT unnest([1, 7, 15, 30, 45])::INTEGER AS apw_days)""")
def _(spark, sf):
    fits = els.fit(elasticity_rows(spark, sf), by=["route"], effects=())
    return els.surface(fits, [1, 7, 15, 30, 45]).select("route", "apw_days", "eta", "eta_se", F.round("tau_star", 4).alias("tau_star"), "note")


@query("M5_elasticity_fixed_effects")
def _(spark, sf):
    out = els.fit(elasticity_rows(spark, sf))
    return out.select(*FIT, "n_params", "adj_r_squared", F.to_json("coefficients").alias("coefficients"), F.to_json("std_errors").alias("std_errors"))


@query("M7_route_elasticity_fixed_effects")
def _(spark, sf):
    return els.fit(elasticity_rows(spark, sf), by=["route"], effects=("carrier", "dow", "month")).select("route", *FIT, "n_params", "tau_star", "note")


@query("M8_fare_ladder")
def _(spark, sf):
    return ladder.fare_ladder(R.retail_quotes(spark, sf))


# The moments of a fitted mixture are those of its sample, however many buckets it has.
@query("M8_ladder_moments", sql("""
  SELECT route, carrier, count(*) AS n_obs, round(avg(ln(price)), 6) AS mean_log, round(stddev_pop(ln(price)), 6) AS sd_log, round(1.0, 6)::DOUBLE AS weight, TRUE AS ordered
  FROM quotes WHERE price > 0 GROUP BY ALL HAVING count(*) >= 50""", "quotes"))
def _(spark, sf):
    rungs = ladder.fare_ladder(R.retail_quotes(spark, sf)).where("rank IS NOT NULL")
    w, y = F.col("weight"), F.ln("fare")
    mean, square = F.sum(w * y), F.sum(w * (F.col("sd_log") ** 2 + y * y))
    climbing = F.array_sort(F.collect_list(F.struct("rank", "fare")))
    return rungs.groupBy("route", "carrier").agg(
        F.max("n_obs").alias("n_obs"), mean.alias("mean_log"), F.sqrt(square - mean * mean).alias("sd_log"), F.sum(w).alias("weight"),
        (climbing["fare"] == F.array_sort(climbing["fare"])).alias("ordered"))


# --- reference comparisons ---------------------------------------------------------------------

cte("qm", """
  SELECT r_name AS route, CAST(date_trunc('month', o_orderdate) AS DATE) AS period, l_extendedprice AS price, l_quantity AS quantity, l_tax AS tax, l_linestatus AS source
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey""")
cte("panel", """
  SELECT route AS series, comparator, period, x, y FROM (SELECT route, period, avg(price) AS x FROM qm GROUP BY ALL)
  JOIN (SELECT period, unnest(['quantity', 'tax']) AS comparator, unnest([avg(quantity), avg(tax) + 1]) AS y FROM qm GROUP BY period) USING (period)""", "qm")


def monthly_series(spark, sf):
    q = R.retail_quotes(spark, sf, "month")
    return q.groupBy(F.col("route").alias("series"), F.col("collected_date").alias("period")).agg(F.avg("price").alias("value"))


def monthly_comparators(spark, sf):
    q = R.retail_quotes(spark, sf, "month").groupBy(F.col("collected_date").alias("period")).agg(
        F.avg("quantity").alias("quantity"), (F.avg("tax") + 1).alias("tax"))
    return q.unpivot("period", ["quantity", "tax"], "comparator", "idx")


def pairs(spark, sf):
    routes = R.table(spark, sf, "region").select(F.col("r_name").alias("series"))
    return routes.withColumn("comparator", F.explode(F.array(F.lit("quantity"), F.lit("tax"))))


def aligned(spark, sf):
    return bt.align(monthly_series(spark, sf), monthly_comparators(spark, sf), pairs(spark, sf))


cte("chg", """
  SELECT *, ln(x) - lag(ln(x)) OVER w AS dlx, ln(y) - lag(ln(y)) OVER w AS dly, x - lag(x) OVER w AS mx, y - lag(y) OVER w AS my,
    100 * x / first_value(x) OVER w AS rx, 100 * y / first_value(y) OVER w AS ry,
    rank() OVER (PARTITION BY series, comparator ORDER BY x) + (count(*) OVER (PARTITION BY series, comparator, x) - 1) / 2.0 AS rank_x,
    rank() OVER (PARTITION BY series, comparator ORDER BY y) + (count(*) OVER (PARTITION BY series, comparator, y) - 1) / 2.0 AS rank_y
  FROM panel WINDOW w AS (PARTITION BY series, comparator ORDER BY period)""", "panel")


@query("J8_W9_W11_W12_aligned_changes", sql("""
  SELECT series, comparator, period, round(dlx, 6) AS dlx, round(dly, 6) AS dly, round(rx, 6) AS rx, round(ry, 6) AS ry,
         round(rank_x::DOUBLE, 6) AS rank_x, round(rank_y::DOUBLE, 6) AS rank_y FROM chg""", "chg"))
def _(spark, sf):
    return bt.changes(aligned(spark, sf)).select("series", "comparator", "period", "dlx", "dly", "rx", "ry", "rank_x", "rank_y")


@query("M9_M10_M11_M12_backtest", sql("""
  SELECT series, comparator, count(*) AS n_overlapping_months, count(mx) AS n_moves, round(corr(x, y), 6) AS pearson_r_level,
    round(corr(rank_x, rank_y), 6) AS spearman_rho_level, round(corr(dlx, dly), 6) AS pearson_r_mom_change,
    round(avg(rx - ry), 6) AS bias, round(stddev_samp(rx - ry), 6) AS sd_diff, round(avg(rx - ry) - 1.96 * stddev_samp(rx - ry), 6) AS loa_low,
    round(avg(rx - ry) + 1.96 * stddev_samp(rx - ry), 6) AS loa_high, round(avg(abs(rx - ry)), 6) AS mean_abs_diff,
    round(100.0 * avg(CASE WHEN mx IS NOT NULL THEN CAST(sign(mx) = sign(my) AS INTEGER) END), 6) AS directional_agreement_pct,
    round(sqrt(regr_syy(y, x) / count(*) * (1 - regr_r2(y, x))), 6) AS rmse_model, round(sqrt(avg(my * my)), 6) AS rmse_random_walk,
    round(100 * (1 - sqrt(regr_syy(y, x) / count(*) * (1 - regr_r2(y, x))) / sqrt(avg(my * my))), 6) AS skill_vs_rw_pct, count(*) >= 6 AS reportable
  FROM chg GROUP BY ALL""", "chg"))
def _(spark, sf):
    return bt.statistics(aligned(spark, sf)).drop("caveats", "spearman_rho_mom_change")


@query("M9_spearman_of_changes", sql("""
  SELECT series, comparator, round(corr(a, b), 6) AS spearman_rho_mom_change FROM (
    SELECT series, comparator, rank() OVER (PARTITION BY series, comparator ORDER BY dlx) + (count(*) OVER (PARTITION BY series, comparator, dlx) - 1) / 2.0 AS a,
      rank() OVER (PARTITION BY series, comparator ORDER BY dly) + (count(*) OVER (PARTITION BY series, comparator, dly) - 1) / 2.0 AS b
    FROM chg WHERE dlx IS NOT NULL) GROUP BY ALL""", "chg"))
def _(spark, sf):
    return bt.statistics(aligned(spark, sf)).select("series", "comparator", "spearman_rho_mom_change")


cte("lags", """
  SELECT a.series, a.comparator, lag AS b_leads_a_by, corr(a.x, b.y) AS corr, count(*) AS n FROM
    (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY series, comparator) AS m FROM panel WINDOW w AS (PARTITION BY series, comparator ORDER BY period)) a
    JOIN (SELECT unnest(generate_series(-6, 6)) AS lag) ON abs(lag) <= least(6, greatest(1, m // 3))
    JOIN (SELECT *, row_number() OVER (PARTITION BY series, comparator ORDER BY period) AS rn FROM panel) b
      ON a.series = b.series AND a.comparator = b.comparator AND b.rn = a.rn - lag
  GROUP BY ALL HAVING count(*) >= 3""", "panel")


@query("M13_J9_lead_lag", sql("SELECT series, comparator, CAST(b_leads_a_by AS INTEGER) AS b_leads_a_by, round(corr, 6) AS corr, n FROM lags", "lags"))
def _(spark, sf):
    return bt.lead_lag(aligned(spark, sf))


@query("K4_best_lag", sql("""
  SELECT series, comparator, CAST(b_leads_a_by AS INTEGER) AS b_leads_a_by, round(corr, 6) AS corr, n FROM lags
  QUALIFY row_number() OVER (PARTITION BY series, comparator ORDER BY abs(corr) DESC, b_leads_a_by) = 1""", "lags"))
def _(spark, sf):
    return bt.best_lag(bt.lead_lag(aligned(spark, sf)))


@query("M14_run_backtest", sql("""
  SELECT series, count(official) AS overlap_months, round(corr(value, official), 6) AS correlation,
         round(100 * avg(abs(value - official) / abs(official)), 6) AS mape, 'reportable' AS status
  FROM (SELECT route AS series, period, avg(price) AS value FROM qm GROUP BY ALL)
  LEFT JOIN (SELECT period, avg(price) AS official FROM qm WHERE source = 'O' GROUP BY 1) USING (period) GROUP BY 1""", "qm"))
def _(spark, sf):
    q = R.retail_quotes(spark, sf, "month")
    reference = q.select(F.lit("dgca").alias("dataset"), F.col("collected_date").alias("period"),
                         F.when(F.col("source") == "O", "average_fare").otherwise("load_factor").alias("metric"), F.col("price").alias("value"))
    return bt.compare_run(monthly_series(spark, sf), reference, "dgca")


cte("bridge", """
  SELECT r_name AS series, comparator, period, x, y FROM region
  CROSS JOIN (SELECT period, unnest(['quantity', 'tax']) AS comparator, unnest([avg(quantity), avg(tax) + 1]) AS y FROM qm GROUP BY period)
  LEFT JOIN (SELECT route AS r_name, period, avg(price) AS x FROM qm GROUP BY ALL) USING (r_name, period)""", "qm")
cte("design", """
  SELECT *, lag(growth) OVER w AS growth_l1, lag(cpi_infl) OVER w AS cpi_infl_l1 FROM (
    SELECT *, 100 * (ln(y) - ln(lag(y, 12) OVER w)) AS cpi_infl, 100 * (ln(x) - ln(lag(x) OVER w)) AS growth
    FROM bridge WINDOW w AS (PARTITION BY series, comparator ORDER BY period))
  WINDOW w AS (PARTITION BY series, comparator ORDER BY period)""", "bridge")


def design(spark, sf):
    return nc.build_design(monthly_series(spark, sf), monthly_comparators(spark, sf), pairs(spark, sf))


@query("J10_W10_bridge_design", sql("""
  SELECT series, comparator, period, round(cpi_infl, 6) AS cpi_infl, round(growth, 6) AS growth, round(growth, 6) AS growth_l0,
         round(growth_l1, 6) AS growth_l1, round(cpi_infl_l1, 6) AS cpi_infl_l1 FROM design""", "design"))
def _(spark, sf):
    return design(spark, sf).select("series", "comparator", "period", "cpi_infl", "growth", "growth_l0", "growth_l1", "cpi_infl_l1")


@query("M15_nowcast_bridge", sql("""
  SELECT series, comparator, count(*) AS n, round(regr_intercept(cpi_infl, growth), 6) AS const, round(regr_slope(cpi_infl, growth), 6) AS slope,
         round(sqrt(regr_syy(cpi_infl, growth) * (1 - regr_r2(cpi_infl, growth)) / (count(*) - 2) / regr_sxx(cpi_infl, growth)), 6) AS slope_se,
         round(regr_r2(cpi_infl, growth), 6) AS r2, round(1 - (1 - regr_r2(cpi_infl, growth)) * (count(*) - 1) / (count(*) - 2), 6) AS adj_r2,
         count(*) >= 24 AS interpretable FROM design WHERE cpi_infl IS NOT NULL AND growth IS NOT NULL GROUP BY ALL""", "design"))
def _(spark, sf):
    out = nc.fit(design(spark, sf), ["growth_l0"])
    return out.select("series", "comparator", "n", F.col("beta")[0].alias("const"), F.col("beta")[1].alias("slope"), F.col("se")[1].alias("slope_se"),
                      "r2", "adj_r2", "interpretable")


@query("M15_nowcast_bridge_full")
def _(spark, sf):
    return nc.fit(design(spark, sf)).drop("reasons")


@query("M16_W13_expanding_window", sql("""
  SELECT series, comparator, count(*) AS n_oos, round(sqrt(avg(pow(a - p, 2))), 6) AS rmse_model, round(sqrt(avg(pow(a - naive, 2))), 6) AS rmse_no_change,
         round(100 * (1 - sqrt(avg(pow(a - p, 2))) / sqrt(avg(pow(a - naive, 2)))), 6) AS skill_vs_benchmark_pct,
         sqrt(avg(pow(a - p, 2))) < sqrt(avg(pow(a - naive, 2))) AS beats_benchmark
  FROM (SELECT series, comparator, cpi_infl AS a, lag(cpi_infl) OVER w AS naive, row_number() OVER w - 1 AS t,
          regr_intercept(cpi_infl, growth) OVER past + regr_slope(cpi_infl, growth) OVER past * growth AS p
        FROM design WHERE cpi_infl IS NOT NULL AND growth IS NOT NULL
        WINDOW w AS (PARTITION BY series, comparator ORDER BY period),
               past AS (PARTITION BY series, comparator ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  WHERE t >= 12 GROUP BY ALL""", "design"))
def _(spark, sf):
    return nc.out_of_sample(design(spark, sf), ["growth_l0"])


GRANGER_SQL = sql("""
  SELECT series, comparator, n, n >= 12 AS testable, 1 AS df1, n - 3 AS df2,
         round(CASE WHEN n >= 12 THEN (rss_r - rss_u) / (rss_u / (n - 3)) END, 6) AS f_stat FROM (
    SELECT *, n * (v - d * d / a) AS rss_r, n * (v - (d * (d * c - e * b) + e * (e * a - d * b)) / (a * c - b * b)) AS rss_u FROM (
      SELECT series, comparator, count(*) AS n, var_pop(y1) AS a, covar_pop(y1, x1) AS b, var_pop(x1) AS c, covar_pop(y1, y) AS d, covar_pop(x1, y) AS e, var_pop(y) AS v
      FROM (SELECT series, comparator, cpi_infl AS y, lag(cpi_infl) OVER w AS y1, lag(growth_l1) OVER w AS x1 FROM design
            WHERE cpi_infl IS NOT NULL AND growth_l1 IS NOT NULL WINDOW w AS (PARTITION BY series, comparator ORDER BY period)) WHERE y1 IS NOT NULL GROUP BY ALL))""", "design")


@query("M17_granger_f_statistic", GRANGER_SQL)
def _(spark, sf):
    return nc.granger(design(spark, sf), lags=1).drop("p_value")


@query("M17_granger_test")
def _(spark, sf):
    return nc.granger(design(spark, sf), lags=2)


@query("M18_J14_reproduce", sql("""
  SELECT count(*) AS n_keys, count(*) FILTER (a IS NULL) AS n_missing, count(*) FILTER (b IS NULL) AS n_new, count(*) FILTER (abs(a - b) > 1e-9) AS n_differing,
         round(max(abs(a - b)), 6) AS max_abs_diff
  FROM (SELECT period, omega_preset, value AS a FROM head_travel WHERE year(period) <> 1996)
  FULL JOIN (SELECT period, omega_preset, CASE WHEN year(period) = 1999 THEN value + 0.5 ELSE value END AS b FROM head_travel WHERE year(period) <> 1997) USING (period, omega_preset)""", "head_travel"))
def _(spark, sf):
    from .reporting import fact_index
    fact = fact_index(spark, sf).where(F.col("index_code") == "IDX-T")
    again = fact.where(F.year("period") != 1997).withColumn("value", F.when(F.year("period") == 1999, F.col("value") + 0.5).otherwise(F.col("value")))
    return rp.report(rp.diff(fact.where(F.year("period") != 1996), again))
