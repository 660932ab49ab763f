"""Registered queries: observation flags, duplicates, lineage, operational logs, extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import extraction as ex
from ..operators import observations as ob
from ..operators import operations as op
from ..session import literal_table, materialise
from ..sources import retail as R
from .registry import query
from .sqltext import sql

# Reference lists and event-to-status maps of the demonstration data.
AIRPORTS = ("AFR", "AME", "ASI", "EUR", "DEL", "BOM")
CARRIERS = ("6E", "AI")
STATUSES = {"view": "success", "click": "success", "error": "network_error", "signup": "no_results", "purchase": "blocked"}
STATUS_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATUSES.items()) + " END"
NOW = "2001-06-01 00:00:00"


def codes_table(spark, values):
    return literal_table(spark, [(v,) for v in values], "code string")


def flagged(spark, sf):
    return ob.validate(R.retail_observations(spark, sf), codes_table(spark, AIRPORTS), codes_table(spark, CARRIERS))


@query("P9_component_flags", sql("""
  SELECT origin_airport, array_to_string(list_filter(flags, lambda x: x IN ('TOTAL_LT_BASE', 'COMPONENT_MISMATCH', 'COMPONENTS_INCOMPLETE')), ',') AS flags,
         count(*) AS n FROM flagged GROUP BY ALL""", "flagged"))
def _(spark, sf):
    return (R.retail_observations(spark, sf).withColumn("flags", F.concat_ws(",", ob.component_codes()))
            .groupBy("origin_airport", "flags").agg(F.count(F.lit(1)).alias("n")))


@query("P10_P11_validation_flags", sql("""
  SELECT origin_airport, carrier, array_to_string(flags, ',') AS flags, count(*) AS n FROM flagged GROUP BY ALL""", "flagged"))
def _(spark, sf):
    return (flagged(spark, sf).groupBy("origin_airport", "carrier", F.concat_ws(",", "flags").alias("flags"))
            .agg(F.count(F.lit(1)).alias("n")))


@query("P12_validation_disposition", sql("""
  SELECT source, CASE WHEN line_number = 1 OR len(flags) > 0 THEN 'flagged' ELSE 'valid' END AS disposition, count(*) AS n FROM flagged GROUP BY ALL""", "flagged"))
def _(spark, sf):
    # The first line of every order is free: a zero fare is flagged, not excluded.
    free = F.when(F.col("line_number") == 1, F.array_append("flags", F.lit("ZERO_FARE"))).otherwise(F.col("flags"))
    return (flagged(spark, sf).withColumn("flags", free).groupBy("source", ob.validation_disposition().alias("disposition")).agg(F.count(F.lit(1)).alias("n")))


PUB_SQL = f"""CASE WHEN list_has_any(flags, ['UNKNOWN_AIRPORT', 'UNKNOWN_CARRIER']) THEN 'EXCLUDED'
    WHEN availability = 'sold_out' THEN 'QUARANTINED' WHEN collected_at < TIMESTAMP '{NOW}' - INTERVAL 36 HOUR THEN 'QUARANTINED'
    WHEN list_contains(flags, 'ZERO_FARE') THEN 'EXCLUDED' WHEN list_contains(flags, 'UNREALISTIC_FARE') THEN 'WINSORISED' ELSE 'ACCEPTED' END"""


@query("P13_publication_disposition", sql(f"""
  SELECT carrier, origin_airport, {PUB_SQL} AS disposition, count(*) AS n FROM flagged GROUP BY ALL""", "flagged"))
def _(spark, sf):
    return (flagged(spark, sf).groupBy("carrier", "origin_airport", ob.publication_disposition(ob.is_stale(NOW)).alias("disposition"))
            .agg(F.count(F.lit(1)).alias("n")))


@query("P14_quality_score", sql("""
  SELECT collector, round(greatest(round(CASE collector WHEN 'public_api' THEN 0.99 WHEN 'static_html' THEN 0.94 WHEN 'document' THEN 0.92 ELSE 0.80 END
         - 0.02 * len(flags), 2), 0.10)::DOUBLE, 2) AS score, count(*) AS n FROM flagged GROUP BY ALL""", "flagged"))
def _(spark, sf):
    return flagged(spark, sf).groupBy("collector", ob.quality_score().alias("score")).agg(F.count(F.lit(1)).alias("n"))


@query("P15_freshness", sql(f"""
  SELECT source, collected_at < TIMESTAMP '{NOW}' - INTERVAL 36 HOUR AS is_stale, count(*) AS n FROM obs GROUP BY ALL""", "obs"))
def _(spark, sf):
    return (R.retail_observations(spark, sf).groupBy("source", ob.is_stale(NOW).alias("is_stale")).agg(F.count(F.lit(1)).alias("n")))


@query("P17_observation_to_quote", sql(f"""
  SELECT origin_airport || '-' || destination_airport AS route, coalesce(fare_brand, 'UNKNOWN') AS fare_family, 0 AS stops, is_sold_out, disposition,
         count(*) AS n, round(sum(total_fare)::DOUBLE, 2) AS total FROM
    (SELECT *, availability = 'sold_out' AS is_sold_out, {PUB_SQL} AS disposition FROM flagged) GROUP BY ALL""", "flagged"))
def _(spark, sf):
    quotes = ob.to_quote(flagged(spark, sf).withColumn("disposition", ob.publication_disposition(ob.is_stale(NOW))))
    return (quotes.groupBy("route", "fare_family", "stops", "is_sold_out", "disposition")
            .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("price"), 2).alias("total")))


def fare_queries(spark, sf):
    o = R.retail_observations(spark, sf)
    return o.select(
        F.col("origin_airport").alias("origin"),
        F.when(F.col("line_number") == 1, F.col("origin_airport")).otherwise(F.col("destination_airport")).alias("destination"),
        F.when(F.col("line_number") == 2, "inr").otherwise("INR").alias("currency"),
        F.when(F.col("line_number") == 3, F.lit(3)).otherwise(F.col("lead_time_days")).alias("lead_time_days"),
        F.col("booking_date").alias("observation_date"), "travel_date")


@query("P18_query_validation", sql("""
  SELECT origin, array_to_string(list_filter([CASE WHEN currency = 'inr' THEN 'BAD_CURRENCY' END, CASE WHEN origin = destination THEN 'SAME_AIRPORT' END,
      CASE WHEN lead = 3 THEN 'LEAD_NOT_ALLOWED' END, CASE WHEN travel_date - booking_date <> lead THEN 'DATES_DISAGREE' END], lambda x: x IS NOT NULL), ',') AS reasons,
      count(*) AS n
  FROM (SELECT *, origin_airport AS origin, CASE WHEN line_number = 1 THEN origin_airport ELSE destination_airport END AS destination,
               CASE WHEN line_number = 2 THEN 'inr' ELSE 'INR' END AS currency, CASE WHEN line_number = 3 THEN 3 ELSE lead_time_days END AS lead FROM obs)
  GROUP BY ALL""", "obs"))
def _(spark, sf):
    return (fare_queries(spark, sf).groupBy("origin", F.concat_ws(",", ob.reject_reasons()).alias("reasons")).agg(F.count(F.lit(1)).alias("n")))


IDENTITY = ["carrier", "destination_airport", "flight_number", "origin_airport", "source"]


def numbered(spark, sf):
    """Observations with a row id made of their content, repeated rows folded; written once, as their readers scan them several times."""
    o = R.retail_observations(spark, sf).select(*IDENTITY, "collected_at", "total_fare", "lead_time_days", "order_id", "line_number").distinct()
    o = materialise(o, "observed")
    ident = F.concat_ws("|", *[F.col(c).cast("string") for c in ("order_id", "line_number", "total_fare", "lead_time_days", *IDENTITY)])
    return o.withColumn("observation_id", ident)


NUMBERED_SQL = """(SELECT DISTINCT carrier, destination_airport, flight_number, origin_airport, source, collected_at, total_fare, lead_time_days, order_id, line_number,
    concat_ws('|', order_id, line_number, total_fare, lead_time_days, carrier, destination_airport, flight_number, origin_airport, source) AS observation_id FROM obs)"""


@query("W8_duplicate_pointers", sql(f"""
  SELECT observation_id, lag(observation_id) OVER w AS supersedes_id,
         nullif(first_value(observation_id) OVER w, observation_id) AS duplicate_of_id
  FROM {NUMBERED_SQL} WINDOW w AS (PARTITION BY carrier, destination_airport, flight_number, origin_airport, source ORDER BY collected_at, observation_id)""", "obs"))
def _(spark, sf):
    o = numbered(spark, sf).withColumn("duplicate_key", F.concat_ws("|", *IDENTITY))
    return ob.duplicate_pointers(o).select("observation_id", "supersedes_id", "duplicate_of_id")


@query("J11_latest_fares", sql(f"""
  SELECT carrier, destination_airport, flight_number, origin_airport, source, observation_id, total_fare::DOUBLE AS total_fare FROM {NUMBERED_SQL}
  QUALIFY rank() OVER (PARTITION BY carrier, destination_airport, flight_number, origin_airport, source ORDER BY collected_at DESC) = 1""", "obs"))
def _(spark, sf):
    return ob.latest_fares(numbered(spark, sf), IDENTITY).select(*IDENTITY, "observation_id", F.col("total_fare").cast("double").alias("total_fare"))


@query("K2_newest_fares", sql(f"""
  SELECT observation_id FROM {NUMBERED_SQL} ORDER BY collected_at DESC, observation_id LIMIT 50""", "obs"))
def _(spark, sf):
    return ob.newest(numbered(spark, sf), 50, tie=["observation_id"]).select("observation_id")


@query("J15_collection_plan", sql("""
  SELECT route, carrier, lead_time_days, DATE '2001-08-01' AS observation_date, CAST(DATE '2001-08-01' + lead_time_days AS DATE) AS travel_date
  FROM (SELECT DISTINCT route, carrier FROM quotes), (SELECT unnest([1, 7, 15, 30, 45])::INTEGER AS lead_time_days)""", "quotes"))
def _(spark, sf):
    pairs = R.retail_quotes(spark, sf).select("route", "carrier").distinct()
    return ob.collection_plan(pairs, F.lit("2001-08-01").cast("date"))


@query("J17_job_observations", """
  SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY 1""")
def _(spark, sf):
    raw = R.table(spark, sf, "orders").select(F.col("o_orderkey").alias("raw_id"), F.col("o_orderpriority").alias("job_id"))
    lines = R.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("raw_id"), "l_returnflag")
    return ob.of_job(lines, raw, "1-URGENT").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


def edges(spark, sf):
    def pairs(df, ck, c, pk, p):
        return df.select(F.lit(ck).alias("child_kind"), F.col(c).cast("string").alias("child_id"),
                         F.lit(pk).alias("parent_kind"), F.col(p).cast("string").alias("parent_id"))
    t = lambda n: R.table(spark, sf, n)
    return (pairs(t("orders"), "raw", "o_orderkey", "payload", "o_custkey")
            .union(pairs(t("customer"), "payload", "c_custkey", "attempt", "c_nationkey"))
            .union(pairs(t("nation"), "attempt", "n_nationkey", "source", "n_regionkey")))


@query("J18_lineage_walk", """
  WITH r AS (SELECT o_orderkey, o_custkey, c_nationkey, n_regionkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
  SELECT d.depth, kind, root_id, id FROM r, LATERAL (VALUES (0, 'raw', CAST(o_orderkey AS VARCHAR)), (1, 'payload', CAST(o_custkey AS VARCHAR)),
    (2, 'attempt', CAST(c_nationkey AS VARCHAR)), (3, 'source', CAST(n_regionkey AS VARCHAR))) d(depth, kind, id),
    LATERAL (SELECT CAST(o_orderkey AS VARCHAR) AS root_id)""")
def _(spark, sf):
    starts = R.table(spark, sf, "orders").select(F.lit("raw").alias("kind"), F.col("o_orderkey").cast("string").alias("id"))
    return ob.lineage(starts, edges(spark, sf)).select("depth", "kind", "root_id", "id")


@query("U5_both_directions", """
  SELECT DISTINCT origin, destination FROM (SELECT n.n_name AS origin, r_name AS destination FROM nation n JOIN region ON n_regionkey = r_regionkey
    JOIN customer ON c_nationkey = n_nationkey UNION ALL SELECT r_name, n.n_name FROM nation n JOIN region ON n_regionkey = r_regionkey
    JOIN customer ON c_nationkey = n_nationkey)""")
def _(spark, sf):
    pairs = (R.table(spark, sf, "customer").join(R.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
             .join(R.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name").distinct())
    return ob.both_directions(pairs, "n_name", "r_name")


def attempts(spark, sf):
    status = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in STATUSES.items()])
    k = F.get_json_object("props", "$.k").cast("int")
    return R.table(spark, sf, "events").select(
        "event_id", F.concat(F.lit("src"), (F.col("user_id") % 7).cast("string")).alias("source"),
        F.concat(F.lit("ad"), (F.col("user_id") % 3).cast("string")).alias("adapter"), status.alias("status"),
        (status == "success").alias("success"), F.round(F.col("value") * 10).cast("long").alias("latency_ms"), F.col("ts").alias("at"),
        F.when(k % 5 == 0, 200).when(k % 5 == 1, 429).when(k % 5 == 2, 503).when(k % 5 == 3, 403).alias("http_status"),
        F.when(k % 3 == 0, "dead_proxy").otherwise("none").alias("network"))


ATT = f"""(SELECT event_id, 'src' || (user_id % 7) AS source, 'ad' || (user_id % 3) AS adapter, {STATUS_SQL} AS status, {STATUS_SQL} = 'success' AS success,
    CAST(round(value * 10) AS BIGINT) AS latency_ms, ts AS at_ts, CASE k % 5 WHEN 0 THEN 200 WHEN 1 THEN 429 WHEN 2 THEN 503 WHEN 3 THEN 403 END AS http_status,
    CASE WHEN k % 3 = 0 THEN 'dead_proxy' ELSE 'none' END AS network FROM (SELECT *, CAST(props->>'$.k' AS INTEGER) AS k FROM events))"""


@query("P23_failure_classification", f"""
  SELECT status, CASE WHEN http_status IS NULL THEN 'none' WHEN http_status = 200 THEN 'http_2xx' WHEN http_status = 429 THEN 'http_429'
      WHEN http_status = 403 THEN 'http_403' ELSE 'http_5xx' END AS http_class,
    CASE WHEN status = 'blocked' OR http_status IN (403, 429) THEN 'source_restriction' WHEN network = 'dead_proxy' THEN network
         WHEN status = 'network_error' THEN 'connection_timeout' ELSE 'none' END AS category, count(*) AS n FROM {ATT} GROUP BY ALL""")
def _(spark, sf):
    a = attempts(spark, sf)
    return (a.groupBy("status", op.http_class(F.col("http_status")).alias("http_class"),
                      op.failure_class(F.col("status"), F.col("http_status"), F.col("network")).alias("category"))
            .agg(F.count(F.lit(1)).alias("n")))


@query("A33_adapter_stats", f"""
  SELECT source, adapter, count(*) FILTER (success) AS success_count, count(*) FILTER (NOT success AND status <> 'no_results') AS failure_count,
    round(avg(latency_ms) FILTER (success OR status <> 'no_results'), 6) AS average_latency_ms, epoch_us(max(at_ts) FILTER (success)) AS last_success_us,
    epoch_us(max(at_ts) FILTER (NOT success AND status <> 'no_results')) AS last_failure_us, arg_max(status, at_ts) FILTER (NOT success) AS last_failure_kind
  FROM {ATT} GROUP BY ALL""")
def _(spark, sf):
    s = op.adapter_stats(attempts(spark, sf))
    return s.select("source", "adapter", "success_count", "failure_count", "average_latency_ms", F.unix_micros(F.col("last_success_at").cast("timestamp")).alias("last_success_us"),
                    F.unix_micros(F.col("last_failure_at").cast("timestamp")).alias("last_failure_us"), "last_failure_kind")


@query("A36_platform_status", """
  SELECT (SELECT count(*) FROM supplier WHERE s_acctbal > 0) AS enabled_sources, (SELECT count(*) FROM supplier WHERE s_nationkey % 5 = 0) AS blocked_sources,
    (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS pending_jobs,
    (SELECT count(*) FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 10) WHERE o_orderstatus = 'F') AS denied_recent,
    CASE WHEN (SELECT count(*) FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 10) WHERE o_orderstatus = 'F') > 0
         THEN 'collection denied recently' END AS banner""")
def _(spark, sf):
    sources = R.table(spark, sf, "supplier").select((F.col("s_acctbal") > 0).alias("enabled"), (F.col("s_nationkey") % 5 == 0).alias("temporarily_blocked"))
    jobs = R.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("job_id"), F.col("o_orderdate").alias("created_at"),
        F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_orderstatus") == "F", "denied").otherwise("done").alias("status"))
    return op.platform_status(sources, jobs)


@query("A36_node_health", """
  SELECT count(*) FILTER (s_acctbal > 0) AS enabled, count(*) FILTER (s_acctbal > 0 AND s_nationkey % 5 > 0) AS healthy,
         count(*) FILTER (s_acctbal > 0 AND s_nationkey % 5 = 0) AS unhealthy, CAST(sum(s_nationkey) AS BIGINT) AS sessions FROM supplier""")
def _(spark, sf):
    return op.node_health(R.table(spark, sf, "supplier").select(
        (F.col("s_acctbal") > 0).alias("enabled"), (F.col("s_nationkey") % 5 > 0).alias("healthy"), F.col("s_nationkey").cast("long").alias("sessions")))


@query("T4s_daily_quota", f"""
  SELECT source, CAST(at_ts AS DATE) AS day, count(*) AS n, count(*) >= 50 AS exhausted FROM {ATT} GROUP BY ALL""")
def _(spark, sf):
    return op.daily_requests(attempts(spark, sf), F.lit(50))


@query("T6s_running_stats", f"""
  SELECT source, adapter, day, CAST(sum(n) OVER w AS BIGINT) AS n_so_far, round(sum(ok) OVER w / sum(n) OVER w, 6) AS success_share,
         round(sum(latency) OVER w / sum(n) OVER w, 6) AS mean_latency
  FROM (SELECT source, adapter, CAST(at_ts AS DATE) AS day, count(*) FILTER (success) AS ok, count(*) AS n, sum(latency_ms) AS latency FROM {ATT} GROUP BY ALL)
  WINDOW w AS (PARTITION BY source, adapter ORDER BY day ROWS UNBOUNDED PRECEDING)""")
def _(spark, sf):
    return op.running_stats(attempts(spark, sf))


BLOCKED_RULES = ["", "*", "/en", "HTTP://m.thththth", "http://m.", "search", "/fr/8"]


@query("P24_url_path_policy", """
  SELECT path, denied_by, denied_by IS NULL AS permitted, count(*) AS n FROM (SELECT path, CASE WHEN starts_with(path, '/en') THEN '/en'
      WHEN starts_with(lower(url), 'http://m.') THEN 'http://m.' WHEN starts_with(path, '/search') THEN 'search' WHEN starts_with(path, '/fr/8') THEN '/fr/8'
      WHEN NOT (starts_with(path, '/fr') OR starts_with(path, '/de')) THEN 'not-in-allowed-paths' END AS denied_by
    FROM (SELECT url, coalesce(nullif(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), ''), '/') AS path FROM pages)) GROUP BY ALL""")
def _(spark, sf):
    rules = [r for r in BLOCKED_RULES if not r.startswith("HTTP")]
    return (op.path_policy(R.table(spark, sf, "pages").select("url"), rules, ["/fr", "/de"])
            .groupBy("path", "denied_by", "permitted").agg(F.count(F.lit(1)).alias("n")))


def policies(spark, sf):
    k = F.col("s_suppkey")
    return R.table(spark, sf, "supplier").select(
        k.alias("source_id"), (k % 7 != 0).alias("enabled"), (k % 11 != 0).alias("automation_allowed"), (k % 13 == 0).alias("temporarily_blocked"),
        F.when(k % 5 == 0, "unknown").when(k % 17 == 0, "denied").otherwise("approved").alias("terms_review_status"),
        F.when(k % 3 != 0, F.lit("2001-01-01").cast("timestamp")).otherwise(F.lit("1999-01-01").cast("timestamp")).alias("terms_checked_at"),
        F.when(k % 19 == 0, "disallowed").when(k % 4 == 0, "unreadable").otherwise("allowed").alias("robots_status"),
        F.lit("2001-05-20").cast("timestamp").alias("robots_checked_at"), F.when(k % 23 != 0, 5).alias("minimum_interval_seconds"),
        F.lit(100).alias("daily_request_limit"),
        F.when(k % 2 == 0, F.array(F.lit("*"))).otherwise(F.array(F.lit("AFR-DEL"), F.lit("ASI-BOM"))).alias("allowed_routes"),
        F.lit("airline").alias("source_type"))


@query("J16_eligibility_audit", sql("""
  SELECT decision, reasons, count(*) AS n FROM (SELECT *, CASE WHEN len(r) = 0 THEN 'ALLOW'
      WHEN len(list_filter(r, lambda x: NOT (x LIKE '%REVIEW_REQUIRED' OR x LIKE '%STALE' OR x = 'ROBOTS_UNKNOWN'))) = 0 THEN 'REVIEW_REQUIRED' ELSE 'DENY' END AS decision,
      array_to_string(r, ',') AS reasons FROM (SELECT list_filter([
        CASE WHEN k % 7 = 0 THEN 'SOURCE_DISABLED' END, CASE WHEN k % 11 = 0 THEN 'AUTOMATION_NOT_ALLOWED' END, CASE WHEN k % 13 = 0 THEN 'SOURCE_TEMPORARILY_BLOCKED' END,
        CASE WHEN k % 5 <> 0 AND k % 17 = 0 THEN 'TERMS_DENIED' END, CASE WHEN k % 5 = 0 THEN 'TERMS_REVIEW_REQUIRED' END,
        CASE WHEN k % 5 <> 0 AND k % 17 <> 0 AND k % 3 = 0 THEN 'TERMS_REVIEW_STALE' END,
        CASE WHEN k % 19 <> 0 AND k % 4 = 0 THEN 'ROBOTS_UNKNOWN' END, CASE WHEN k % 19 = 0 THEN 'ROBOTS_DISALLOWED' END,
        CASE WHEN k % 23 = 0 THEN 'RATE_POLICY_MISSING' END,
        CASE WHEN k % 2 = 1 AND route NOT IN ('AFR-DEL', 'ASI-BOM') THEN 'ROUTE_NOT_PERMITTED' END], lambda x: x IS NOT NULL) AS r
      FROM (SELECT l_suppkey AS k, upper(substr(r_name, 1, 3)) || '-' || CASE l_returnflag WHEN 'A' THEN 'DEL' WHEN 'N' THEN 'BOM' ELSE 'XXX' END AS route
            FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
            JOIN region ON n_regionkey = r_regionkey JOIN supplier ON s_suppkey = l_suppkey))) GROUP BY ALL""", "w_routes"))
def _(spark, sf):
    line = R.table(spark, sf, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("source_id"), "l_returnflag")
    where = (R.table(spark, sf, "orders").join(R.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
             .join(R.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
             .join(R.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("o_orderkey", "r_name"))
    queries = line.join(where, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "source_id", F.upper(F.substring("r_name", 1, 3)).alias("origin"),
        F.when(F.col("l_returnflag") == "A", "DEL").when(F.col("l_returnflag") == "N", "BOM").otherwise("XXX").alias("destination"))
    return (op.eligibility(queries, policies(spark, sf), NOW).groupBy("decision", F.concat_ws(",", "reasons").alias("reasons"))
            .agg(F.count(F.lit(1)).alias("n")))


def payloads(spark, sf):
    """One search payload per line item: route and date outside, four spellings of the fare inside.

    Two of them also hold what looks like a field but isn't valid: a clock time under a date's key, and an
    empty amount in front of the total.
    """
    # The given table is one row group, so one task; files of real payloads split by themselves.
    line = R.table(spark, sf, "lineitem").where(F.col("l_extendedprice") > 0).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_returnflag").repartition("l_orderkey")
    ident = F.concat_ws("|", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    number = (F.col("l_partkey") % 900 + 100).cast("string")
    offer = F.struct(F.struct(F.lit("6e").alias("code")).alias("airline"), number.alias("flightNo"),
                     F.struct(F.concat(F.lit("INR "), price.cast("string")).alias("amount")).alias("fare"), F.col("l_returnflag").alias("fareBrand"))
    again = F.struct(F.lit("6E").alias("airlineCode"), F.concat(F.lit("6E "), number).alias("flight_number"), F.concat(F.lit("Rs. "), price.cast("string")).alias("Total_Fare"))
    timed = F.struct(F.lit("6E").alias("carrier"), F.concat(F.lit("6E"), number).alias("flightNumber"), F.lit("06:30").alias("departure"), F.lit("06:30").alias("std"),
                     (price + 1).cast("string").alias("price"))
    partial = F.struct(F.lit("6E").alias("carrier"), number.alias("flightNo"), F.struct(F.lit(0).alias("amount"), (price + 2).cast("string").alias("total")).alias("fare"))
    body = F.to_json(F.struct(F.struct(
        F.lit("del").alias("from"), F.struct(F.lit("BOM").alias("iata")).alias("to"), F.concat(day, F.lit("T06:30")).alias("departureDate"),
        F.array(offer).alias("results"), F.struct(again.alias("best")).alias("summary"), F.struct(timed.alias("early"), partial.alias("late")).alias("more")).alias("search")))
    asked = F.when(F.col("l_linenumber") == 7, F.date_add(F.to_date("l_shipdate"), 1)).otherwise(F.to_date("l_shipdate"))
    return line.select(ident.alias("payload_id"), body.alias("payload"), F.lit("DEL").alias("query_origin"), F.lit("BOM").alias("query_destination"),
                       asked.alias("query_travel_date"))


@query("X1_fare_extraction", """
  SELECT concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS payload_id, '6E' AS carrier, 'DEL' AS origin, 'BOM' AS destination,
         '6E' || (l_partkey % 900 + 100) AS flight_number, CAST(l_shipdate AS DATE) AS travel_date, (CAST(l_extendedprice AS DECIMAL(12,2)) + more)::DOUBLE AS total_fare
  FROM lineitem, (VALUES (0), (1), (2)) m(more) WHERE l_extendedprice > 0 AND l_linenumber <> 7 GROUP BY ALL""")
def _(spark, sf):
    return ex.extract_fares(payloads(spark, sf)).select(
        "payload_id", "carrier", "origin", "destination", "flight_number", "travel_date", F.col("total_fare").cast("double").alias("total_fare"))


@query("X2_fixed_schema_fares", """
  SELECT CASE WHEN o % 50 = 1 THEN 'PARSER_ERROR' WHEN o % 50 = 2 THEN 'SOURCE_CHANGED' WHEN l = 3 OR l = 5 OR l = 6 THEN 'INVALID_DATA' END AS reject_reason,
         count(*) AS n, round(sum(CASE WHEN NOT (o % 50 IN (1, 2)) AND l NOT IN (5, 6) THEN CASE WHEN l = 3 THEN -p ELSE p END END), 2) AS total
  FROM (SELECT l_orderkey AS o, l_linenumber AS l, CAST(l_extendedprice AS DECIMAL(12,2))::DOUBLE AS p FROM lineitem) GROUP BY 1""")
def _(spark, sf):
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    fare = (F.when(F.col("l_linenumber") == 3, (-price).cast("string")).when(F.col("l_linenumber") == 5, F.lit("n/a"))
            .when(F.col("l_linenumber") == 6, F.lit(None)).otherwise(price.cast("string")))
    record = F.to_json(F.array(F.struct(F.lit("DEL").alias("origin"), F.col("l_returnflag").alias("carrier"), fare.alias("total_fare"))))
    body = (F.when(F.col("l_orderkey") % 50 == 1, F.lit("{not json")).when(F.col("l_orderkey") % 50 == 2, F.lit('{"offers": []}')).otherwise(record))
    rows = ex.fixed_records(R.table(spark, sf, "lineitem").select(body.alias("payload"), F.col("l_orderkey").alias("payload_id")))
    return rows.groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("total_fare").cast("double")), 2).alias("total"))


@query("X3_embedded_json", """
  SELECT page_id, CAST(to_json({'page': page_id, 'url': url}) AS VARCHAR) AS document FROM pages UNION ALL
  SELECT page_id, CAST(to_json({'len': length(html)}) AS VARCHAR) FROM pages""")
def _(spark, sf):
    p = R.table(spark, sf, "pages")
    first = F.to_json(F.struct(F.col("page_id").alias("page"), "url"))
    second = F.to_json(F.struct(F.length("html").alias("len")))
    html = F.concat("html", F.lit('<script id="__NEXT_DATA__" type="application/json">'), first, F.lit("</script><SCRIPT type='application/ld+json'>"),
                    second, F.lit("</SCRIPT><script type=\"application/json\">{broken</script>"))
    return ex.embedded_json(p.select("page_id", html.alias("html")))


@query("X4_challenge_pages", """
  SELECT page_id, page_id % 5 = 0 AS is_challenge, page_id % 3 = 0 AS is_block FROM pages""")
def _(spark, sf):
    p = R.table(spark, sf, "pages")
    html = F.concat("html", F.when(F.col("page_id") % 5 == 0, "Checking your BROWSER").otherwise(""), F.when(F.col("page_id") % 3 == 0, " HTTP 403 ").otherwise(""))
    return ex.page_flags(p.select("page_id", html.alias("html"))).select("page_id", "is_challenge", "is_block")


@query("F1_charge_split", sql("""
  SELECT route, round(sum(price * 0.6), 4) AS base_fare, round(sum(price * 0.1 + 5), 4) AS taxes, round(sum(77.0), 4) AS udf,
         round(sum(CASE WHEN quantity > 10 THEN 12.0 END), 4) AS other_fee FROM quotes GROUP BY 1""", "quotes"))
def _(spark, sf):
    def line(kind, code, amount):
        return F.struct(F.lit(kind).alias("type"), F.lit(code).alias("code"), amount.cast("double").alias("amount"))
    quotes = R.retail_quotes(spark, sf).select("route", F.lit(1.0).alias("published_fare"), F.array(
        line("FarePrice", "", F.col("price") * 0.6), line("Tax", "YQ", F.col("price") * 0.1), line("Other", "cgst", F.lit(5)),
        line("Other", "UDF", F.lit(77)), line("TravelFee", "CF", F.when(F.col("quantity") > 10, F.lit(12))), line("Seat", "X", F.lit(9))).alias("charges"))
    parts = ["base_fare", "taxes", "udf", "other_fee"]
    return ex.charge_split(quotes).groupBy("route").agg(*[F.round(F.sum(c), 4).alias(c) for c in parts])


@query("F2_scalar_parsers", """
  SELECT l_linenumber, CAST(l_extendedprice AS DECIMAL(12,2))::DOUBLE AS money, CAST(l_shipdate AS DATE) AS day, CAST(l_shipdate AS DATE) AS day2,
         printf('%02d:30', l_linenumber) AS clock, 'DEL' AS airport, '6E' AS carrier, '6E' || (l_partkey % 900 + 100) AS flight,
         CAST(month(l_shipdate) AS INTEGER) AS month_no, CAST((dayofweek(l_shipdate) + 6) % 7 AS INTEGER) AS dow, count(*) AS n FROM lineitem GROUP BY ALL""")
def _(spark, sf):
    t = R.table(spark, sf, "lineitem")
    return t.select(
        "l_linenumber", sc.parse_money(F.concat(F.lit("₹ "), F.format_number(F.col("l_extendedprice").cast("decimal(12,2)"), 2))).cast("double").alias("money"),
        sc.parse_date(F.date_format("l_shipdate", "dd/MM/yyyy")).alias("day"), sc.parse_date(F.date_format("l_shipdate", "yyyyMMdd")).alias("day2"),
        sc.parse_time(F.concat(F.lit("dep "), F.col("l_linenumber").cast("string"), F.lit(":30"))).alias("clock"),
        sc.parse_airport(F.lit(" del ")).alias("airport"), sc.parse_carrier(F.lit("6 e")).alias("carrier"),
        sc.parse_flight_number((F.col("l_partkey") % 900 + 100).cast("string"), F.lit("6E")).alias("flight"),
        sc.parse_month(F.date_format("l_shipdate", "MMMM")).alias("month_no"), sc.monday_zero(F.to_date("l_shipdate")).alias("dow"),
    ).groupBy("l_linenumber", "money", "day", "day2", "clock", "airport", "carrier", "flight", "month_no", "dow").agg(F.count(F.lit(1)).alias("n"))


@query("F3_great_circle", """
  SELECT s_suppkey, round(2 * 6371.0088 * asin(sqrt(pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))), 1) AS km
  FROM (SELECT s_suppkey, s_nationkey * 3.0 - 40 AS lat1, s_nationkey * 7.0 AS lon1, 28.5 AS lat2, s_suppkey % 90 + 0.25 AS lon2 FROM supplier)""")
def _(spark, sf):
    s = R.table(spark, sf, "supplier")
    return s.select("s_suppkey", sc.great_circle_km(F.col("s_nationkey") * 3.0 - 40, F.col("s_nationkey") * 7.0, F.lit(28.5), F.col("s_suppkey") % 90 + 0.25).alias("km"))


@query("F4_calendar", """
  SELECT day, CAST((dayofweek(day) + 6) % 7 AS INTEGER) AS dow, dayofweek(day) IN (0, 6) AS is_weekend, month(day) = 12 AND dayofmonth(day) = 25 AS is_holiday
  FROM (SELECT CAST(unnest(generate_series(CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE), INTERVAL 1 DAY)) AS DATE) AS day FROM orders)""")
def _(spark, sf):
    from ..sources.reference import calendar
    span = R.table(spark, sf, "orders").agg(F.to_date(F.min("o_orderdate")).alias("first_day"), F.to_date(F.max("o_orderdate")).alias("last_day"))
    return calendar(span, (F.month("day") == 12) & (F.dayofmonth("day") == 25))


@query("F5_identity_hash", sql("""
  SELECT sha256(CAST(to_json({'carrier': carrier, 'origin_airport': origin_airport, 'source': source}) AS VARCHAR)) AS identity_hash, count(*) AS n FROM obs GROUP BY 1""", "obs"))
def _(spark, sf):
    return (ob.identity_hash(R.retail_observations(spark, sf), ["source", "origin_airport", "carrier"]).groupBy("identity_hash").agg(F.count(F.lit(1)).alias("n")))
