"""Common table expressions from which the SQL twins are assembled."""

from __future__ import annotations

from ..params import OMEGA_PRESETS
from ..sources import retail as R

PRODUCT = "route, carrier, apw_days, flight_number, fare_family, cabin, stops"
CELL = "route, carrier, apw_days"
FLIGHT = "route, carrier, apw_days, flight_number"


def _values(name: str, cols: str, rows) -> str:
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        if isinstance(v, (int, float)):
            return f"CAST({v!r} AS DOUBLE)" if isinstance(v, float) else repr(v)
        text = str(v)
        return f"DATE '{text}'" if len(text) == 10 and text[4] == "-" else "'" + text + "'"
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"{name}({cols}) AS (VALUES {body})"


CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, body: str, *deps: str) -> None:
    CTES[name] = (deps, f"{name} AS ({body})")


def sql(final: str, *names: str) -> str:
    """WITH the named expressions, and what they need, in order."""
    seen: list[str] = []

    def visit(n: str) -> None:
        if n in seen:
            return
        for d in CTES[n][0]:
            visit(d)
        seen.append(n)

    for n in names:
        visit(n)
    return "WITH " + ",\n".join(CTES[n][1] for n in seen) + "\n" + final


CTES["w_routes"] = ((), _values("w_routes", "route, w", sorted(R.ROUTE_WEIGHTS.items())))
CTES["w_carriers"] = ((), _values("w_carriers", "route, carrier, phi",
                                  [(r, c, v) for r, t in sorted(R.CARRIER_WEIGHTS.items()) for c, v in sorted(t.items())]))
CTES["w_omega"] = ((), _values("w_omega", "omega_preset, apw_days, omega",
                               [(p, a, v) for p, t in OMEGA_PRESETS.items() for a, v in t.items()]))
CTES["d_km"] = ((), _values("d_km", "route, km", sorted(R.DISTANCES.items())))
CTES["d_basket"] = ((), _values("d_basket", "route, stratum, weight_wr, in_named_list",
                                [(r, s, R.ROUTE_WEIGHTS.get(r, 0.05), r in ("ASIA", "EUROPE")) for r, s in sorted(R.STRATA.items())]))
CTES["d_charges"] = ((), _values("d_charges", "airport, udf, asf, f, t", [
    row for a, (x, y, z) in sorted(R.UDF_ASF.items()) for row in ((a, x, z, R.START, R.SPLIT), (a, y, z, R.SPLIT, None))]))
CTES["d_taxes"] = ((), _values("d_taxes", "cabin, g, f, t", [
    row for c, (x, y) in sorted(R.GST.items()) for row in ((c, x, R.START, R.SPLIT), (c, y, R.SPLIT, None))]))

cte("quotes", """
  SELECT CAST(date_trunc('quarter', o_orderdate) AS DATE) AS collected_date,
         CAST(date_trunc('quarter', o_orderdate) + to_months(CAST(3 * (l_partkey % 5) AS INTEGER)) AS DATE) AS departure_date,
         r_name AS route, l_returnflag AS carrier,
         CAST([1, 7, 15, 30, 45][l_partkey % 5 + 1] AS INTEGER) AS apw_days,
         CAST(l_suppkey % 3 AS VARCHAR) AS flight_number, p_type AS fare_family,
         'economy' AS cabin, 0 AS stops, l_extendedprice AS price, l_linestatus AS source,
         'ACCEPTED' AS disposition, l_orderkey AS order_id, l_quantity AS quantity, l_discount AS discount, l_tax AS tax
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
       JOIN part ON l_partkey = p_partkey""")
cte("raw_quotes", """
  SELECT * EXCLUDE (price, cabin, disposition), price AS total_fare, route AS origin_iata,
         CASE WHEN discount = 0.10 THEN 'bad' ELSE 'economy' END AS cabin,
         CASE WHEN tax = 0.08 THEN 'USD' ELSE 'INR' END AS currency, quantity >= 50 AS is_sold_out
  FROM quotes""", "quotes")

for basis, day in (("book", "collected_date"), ("travel", "departure_date")):
    b = basis
    cte(f"prep_{b}", f"""
      SELECT {PRODUCT}, {day} AS period, avg(ln(price)) AS lp, exp(avg(ln(price))) AS price, count(*) AS n_sources
      FROM quotes WHERE price > 0 AND disposition IN ('ACCEPTED', 'WINSORISED') GROUP BY ALL""", "quotes")
    cte(f"base_{b}", f"""
      SELECT period AS base_period FROM (SELECT period, count(DISTINCT apw_days) AS n FROM prep_{b} GROUP BY 1)
      ORDER BY n DESC, period LIMIT 1""", f"prep_{b}")
    cte(f"rel_{b}", f"""
      SELECT p.*, z.lp AS lp0, p.lp - z.lp AS lr FROM prep_{b} p
      LEFT JOIN (SELECT {PRODUCT}, lp FROM prep_{b} WHERE period = (SELECT base_period FROM base_{b})) z
      USING ({PRODUCT})""", f"prep_{b}", f"base_{b}")
    cte(f"blocks_{b}", f"""
      SELECT f.*, f.llow - z.llow AS laf_lr FROM
        (SELECT period, {FLIGHT}, sum(lr) AS lr_sum, count(lr) AS lr_n, min(lp) AS llow, count(*) AS n_quotes
         FROM rel_{b} GROUP BY ALL) f
      LEFT JOIN (SELECT {FLIGHT}, min(lp) AS llow FROM prep_{b}
                 WHERE period = (SELECT base_period FROM base_{b}) GROUP BY ALL) z USING ({FLIGHT})""", f"rel_{b}")
    cte(f"fam_{b}", f"""
      SELECT *, greatest(least(n_families / n_families_ref, 1.0), 1e-6) AS availability FROM
        (SELECT *, max(n_families) OVER (PARTITION BY {CELL}) AS n_families_ref FROM
          (SELECT period, {CELL}, count(DISTINCT fare_family) AS n_families FROM prep_{b} GROUP BY ALL))""", f"prep_{b}")
    cte(f"cells_{b}", f"""
      SELECT *, CASE WHEN matched > 0 AND laf > 0 THEN exp(availability * ln(matched) + (1 - availability) * ln(laf))
                     ELSE coalesce(matched, laf) END AS adjusted, n_matched < 5 AS suppressed
      FROM (SELECT period, {CELL}, 100 * exp(avg(lr)) AS matched, count(lr) AS n_matched, count(*) AS n_quotes
            FROM rel_{b} GROUP BY ALL)
      LEFT JOIN (SELECT period, {CELL}, 100 * exp(avg(laf_lr)) AS laf FROM blocks_{b} WHERE laf_lr IS NOT NULL GROUP BY ALL)
        USING (period, {CELL})
      JOIN fam_{b} USING (period, {CELL})""", f"blocks_{b}", f"fam_{b}")
    cte(f"smooth_{b}", f"""
      SELECT * RENAME (adjusted AS adjusted_raw), exp(avg(CASE WHEN adjusted > 0 THEN ln(adjusted) END) OVER
        (PARTITION BY {CELL} ORDER BY period ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)) AS adjusted
      FROM cells_{b}""", f"cells_{b}")
    for tag, col in (("", "adjusted"), ("raw_", "adjusted_raw")):
        cte(f"route_{tag}{b}", f"""
          SELECT period, route, apw_days, CASE WHEN sum(phi) > 0 THEN sum(phi * {col}) / sum(phi) ELSE avg({col}) END AS value,
                 count(*) AS n_carriers, CAST(sum(n_matched) AS BIGINT) AS n_matched, sum(phi) AS carrier_weight_sum
          FROM (SELECT s.*, coalesce(c.phi, 0) AS phi FROM smooth_{b} s LEFT JOIN w_carriers c USING (route, carrier)
                WHERE NOT suppressed AND {col} IS NOT NULL) GROUP BY ALL""", f"smooth_{b}", "w_carriers")
        cte(f"apw_{tag}{b}", f"""
          SELECT period, apw_days, CASE WHEN sum(w) > 0 THEN sum(w * value) / sum(w) ELSE avg(value) END AS value,
                 count(*) AS n_routes, CAST(sum(n_matched) AS BIGINT) AS n_matched,
                 100 * sum(w) / (SELECT sum(w) FROM w_routes) AS coverage_pct
          FROM (SELECT r.*, coalesce(w.w, 0) AS w FROM route_{tag}{b} r LEFT JOIN w_routes w USING (route)) GROUP BY ALL""",
            f"route_{tag}{b}", "w_routes")
        cte(f"head_{tag}{b}", f"""
          SELECT omega_preset, period, CASE WHEN sum(omega) > 0 THEN sum(omega * value) / sum(omega) ELSE avg(value) END AS value,
                 count(*) AS n_apw, CAST(sum(n_matched) AS BIGINT) AS n_matched, avg(coverage_pct) AS coverage_pct,
                 CASE WHEN sum(omega) > 0 THEN sum(omega) ELSE 1.0 END AS omega_covered
          FROM apw_{tag}{b} JOIN w_omega USING (apw_days) GROUP BY ALL""", f"apw_{tag}{b}", "w_omega")

cte("decomp", f"""
  SELECT *, base_fare * g AS gst, base_fare AS price_B, total_fare - convenience_fee AS price_T, total_fare AS price_A,
         abs(total_fare - (base_fare + yq_yr + udf + asf + rcs_levy + base_fare * g + convenience_fee)) AS decomp_residual
  FROM (SELECT *, (total_fare - udf - asf - rcs_levy - convenience_fee) / (1 + g) AS base_fare, 0.0::DOUBLE AS yq_yr FROM
    (SELECT q.*, coalesce(c.udf, 0) AS udf, coalesce(c.asf, 0) AS asf, coalesce(x.g, 0) AS g,
            CASE WHEN route IN ({", ".join(repr(r) for r in R.RCS_ROUTES)}) THEN {R.RCS_LEVY!r}::DOUBLE ELSE 0.0::DOUBLE END AS rcs_levy,
            {R.CONVENIENCE_FEE!r}::DOUBLE AS convenience_fee
     FROM raw_quotes q
     LEFT JOIN d_charges c ON c.airport = q.origin_iata AND c.f <= q.collected_date AND (c.t IS NULL OR c.t > q.collected_date)
     LEFT JOIN d_taxes x ON x.cabin = q.cabin AND x.f <= q.collected_date AND (x.t IS NULL OR x.t > q.collected_date)))""",
    "raw_quotes", "d_charges", "d_taxes")
cte("gated", """
  SELECT *, reason <> '' AS gate_failed FROM (SELECT d.*, CASE
    WHEN total_fare IS NULL OR total_fare <= 0 THEN 'NONPOSITIVE_FARE'
    WHEN total_fare < udf + asf + rcs_levy THEN 'BELOW_STATUTORY_FLOOR'
    WHEN currency IS NULL OR currency <> 'INR' THEN 'NON_INR_CURRENCY'
    WHEN apw_days NOT IN (1, 7, 15, 30, 45) THEN 'APW_NOT_IN_WINDOW_SET'
    WHEN cabin NOT IN ('economy', 'other_than_economy') THEN 'BAD_CABIN'
    WHEN total_fare < 0.35 * (900 + 1.6 * coalesce(km, 1000)) OR total_fare > 90000 THEN 'IMPLAUSIBLE_FOR_DISTANCE'
    ELSE '' END AS reason FROM decomp d LEFT JOIN d_km USING (route))""", "decomp", "d_km")
cte("day_y", "SELECT *, CASE WHEN price_T > 0 THEN ln(price_T) END AS y FROM gated", "gated")
cte("day_stats", """
  SELECT s.*, m.mad FROM
    (SELECT route, carrier, apw_days, collected_date, count(y) AS n_values, quantile_cont(y, 0.25) AS q1,
            quantile_cont(y, 0.75) AS q3, median(y) AS med FROM day_y GROUP BY ALL) s
  JOIN (SELECT route, carrier, apw_days, collected_date, median(abs(y - med)) AS mad FROM
          (SELECT *, median(y) OVER (PARTITION BY route, carrier, apw_days, collected_date) AS med FROM day_y)
        GROUP BY ALL) m USING (route, carrier, apw_days, collected_date)""", "day_y")
cte("outliers", """
  SELECT *, CASE WHEN (tukey_hit OR hampel_hit) AND reason = '' THEN 'OUTLIER_CELL' ELSE reason END AS flag FROM (
    SELECT *, coalesce(y < fence_low OR y > fence_high, FALSE) AS tukey_hit,
           coalesce(n_values >= 4 AND mad > 0 AND abs(0.6745 * (y - med) / nullif(mad, 0)) > 3.5, FALSE) AS hampel_hit FROM (
      SELECT y.*, n_values, med, mad, CASE WHEN n_values >= 4 THEN q1 - 3 * (q3 - q1) END AS fence_low,
             CASE WHEN n_values >= 4 THEN q3 + 3 * (q3 - q1) END AS fence_high
      FROM day_y y LEFT JOIN day_stats USING (route, carrier, apw_days, collected_date)))""", "day_y", "day_stats")
cte("moves", """
  SELECT *, abs(ly - lag(ly) OVER (PARTITION BY route, carrier, apw_days, flight_number, fare_family ORDER BY collected_date)) AS jump
  FROM (SELECT route, carrier, apw_days, flight_number, fare_family, collected_date, avg(y) AS ly FROM day_y GROUP BY ALL)""", "day_y")
cte("jumps", """
  SELECT m.*, jump_sigma, coalesce(jump > 3 * jump_sigma, FALSE) AS is_jump FROM moves m
  JOIN (SELECT route, carrier, apw_days, CASE WHEN count(jump) > 2 THEN stddev_samp(jump) END AS jump_sigma
        FROM moves GROUP BY ALL) USING (route, carrier, apw_days)""", "moves")
cte("cleaned", """
  SELECT * REPLACE (CASE WHEN disposition = 'WINSORISED' THEN exp(least(greatest(y, fence_low), fence_high)) ELSE price_T END AS price_T),
         CASE WHEN disposition = 'WINSORISED' THEN exp(least(greatest(y, fence_low), fence_high)) + convenience_fee END AS total_fare_capped
  FROM (SELECT *, CASE WHEN is_sold_out THEN 'QUARANTINED' WHEN gate_failed THEN 'EXCLUDED' WHEN flag2 = 'OUTLIER_CELL' THEN 'WINSORISED'
                       WHEN flag2 = 'LONGITUDINAL_JUMP' THEN 'QUARANTINED' ELSE 'ACCEPTED' END AS disposition,
               CASE WHEN is_sold_out THEN 'SOLD_OUT' ELSE nullif(flag2, '') END AS quality_flag
        FROM (SELECT o.*, CASE WHEN is_jump AND flag = '' THEN 'LONGITUDINAL_JUMP' ELSE flag END AS flag2
              FROM outliers o LEFT JOIN jumps USING (route, carrier, apw_days, flight_number, fare_family, collected_date)))""",
    "outliers", "jumps")
cte("rebuilt", """
  SELECT * REPLACE (base_eff + yq_yr AS price_B, eff - convenience_fee AS price_T, eff AS price_A) FROM (
    SELECT *, coalesce(total_fare_capped, total_fare) AS eff,
           CASE WHEN total_fare_capped IS NULL THEN base_fare ELSE
             (total_fare_capped - udf - asf - rcs_levy - convenience_fee) / (1 + CASE WHEN base_fare > 0 THEN gst / base_fare ELSE 0 END) END AS base_eff
    FROM cleaned)""", "cleaned")

cte("obs", """
  SELECT order_id, line_number, upper(substr(route, 1, 3)) AS origin_airport,
    CASE carrier WHEN 'A' THEN 'DEL' WHEN 'N' THEN 'BOM' ELSE 'XXX' END AS destination_airport,
    CASE carrier WHEN 'A' THEN '6E' WHEN 'N' THEN 'AI' ELSE 'ZZ' END AS carrier, 'F' || flight_number AS flight_number, source,
    CASE line_number % 4 WHEN 0 THEN 'public_api' WHEN 1 THEN 'static_html' WHEN 2 THEN 'document' ELSE 'unlisted' END AS collector,
    ordered_at + to_hours(CAST(line_number AS INTEGER)) AS collected_at, CAST(ordered_at AS DATE) AS booking_date,
    CAST(CAST(ordered_at AS DATE) + apw_days AS DATE) AS travel_date, apw_days AS lead_time_days,
    CASE WHEN fare_family <> 'PROMO' THEN fare_family END AS fare_brand, 'economy' AS cabin_class,
    CASE WHEN quantity >= 50 THEN 'sold_out' ELSE 'available' END AS availability,
    base AS base_fare, CASE WHEN discount <> 0.03 THEN 100.00::DECIMAL(12,2) END AS taxes, total AS total_fare,
    CASE WHEN discount = 0.05 THEN total - base - 400 + 1 ELSE total - base - 400 END AS other_fee,
    total < base AS total_lt_base, discount <> 0.03 AND discount = 0.05 AS mismatch, discount = 0.03 AS incomplete
  FROM (SELECT q.*, CAST(price AS DECIMAL(12,2)) AS total, CAST(price * 0.5 AS DECIMAL(12,2)) AS base FROM quotes_at q)""", "quotes_at")
cte("quotes_at", """
  SELECT r_name AS route, l_returnflag AS carrier, CAST([1, 7, 15, 30, 45][l_partkey % 5 + 1] AS INTEGER) AS apw_days,
         CAST(l_suppkey % 3 AS VARCHAR) AS flight_number, p_type AS fare_family, l_extendedprice AS price, l_linestatus AS source,
         l_orderkey AS order_id, l_quantity AS quantity, l_discount AS discount, l_linenumber AS line_number, o_orderdate AS ordered_at
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey""")
cte("flagged", """
  SELECT *, list_filter([CASE WHEN origin_airport = 'MID' OR destination_airport = 'XXX' THEN 'UNKNOWN_AIRPORT' END,
      CASE WHEN carrier = 'ZZ' THEN 'UNKNOWN_CARRIER' END, CASE WHEN total_lt_base THEN 'TOTAL_LT_BASE' END,
      CASE WHEN mismatch THEN 'COMPONENT_MISMATCH' END, CASE WHEN incomplete THEN 'COMPONENTS_INCOMPLETE' END,
      CASE WHEN total_fare = 0 THEN 'ZERO_FARE' END, CASE WHEN total_fare > 500000 THEN 'UNREALISTIC_FARE' END], lambda x: x IS NOT NULL) AS flags
  FROM obs""", "obs")
