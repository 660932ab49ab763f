"""Registered queries: streams drained over the given tables, with batch SQL twins."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions.digests import merkle_sql
from ..functions.scalars import canonical_json
from ..operators import ledger as lg
from ..operators import observations as ob
from ..operators import operations as op
from ..params import Method
from ..session import materialise, work_dir
from ..sources import retail as R
from ..sources.quotes import QUOTE_KEY
from ..streaming import chain, ingest, runs, stateful
from .index_family import weights
from .observing import ATT, NOW as POLICY_NOW, attempts, policies
from .registry import query
from .sqltext import sql

NOW = "2024-01-20 00:00:00"


def event_stream(spark, sf):
    schema = R.table(spark, sf, "events").schema
    return runs.file_stream(spark, f"{sf}/events*.parquet", schema)


# Files that a trigger reads.
TRIGGER_FILES = 8


def triggered(spark, rows, part, count):
    """``rows`` as a stream of ``count`` triggers; ``part`` numbers the trigger of a row from 0."""
    root = work_dir(spark, "triggers")
    numbered = rows.withColumn("_part", part)
    for i in range(count):  # files are read in the order of their writing
        part = numbered.where(F.col("_part") == i).drop("_part").repartition(TRIGGER_FILES)
        if not part.isEmpty():  # an empty table would be one file and shift the triggers
            part.write.mode("append").parquet(root)
    return runs.file_stream(spark, root, rows.schema, files_per_trigger=TRIGGER_FILES)


def late_stream(spark, sf):
    """The events in three triggers, the newest days first: most rows arrive days late. Events without a time come last."""
    events = R.table(spark, sf, "events")
    day = F.unix_date(F.to_date("ts"))
    span = events.agg(F.min(day).alias("first"), F.max(day).alias("last"))
    first, last = span.select("first").scalar(), span.select("last").scalar()
    return triggered(spark, events, F.coalesce(F.floor(3 * (last - day) / (last - first + 1)), F.lit(2)), 3)


LATENESS_DAYS = 40


def shuffled_stream(spark, sf):
    """The events in five triggers without any order, and a closing tick that lets the watermark pass all of them."""
    events = R.table(spark, sf, "events")
    tick = events.agg(F.max("ts").alias("ts")).select(*[
        (F.col("ts") + F.expr(f"INTERVAL {LATENESS_DAYS + 1} DAY") if c == "ts" else F.lit(-1) if c in ("event_id", "user_id") else F.lit(None)).cast(t).alias(c)
        for c, t in events.dtypes])
    part = F.when(F.col("event_id") < 0, 5).otherwise(F.pmod(F.xxhash64("event_id"), F.lit(5)))
    return triggered(spark, events.unionByName(tick), part, 6)


def attempt_stream(spark, sf, events=event_stream):
    """The attempt projection of the batch queries, over the stream."""
    from . import observing as o
    status = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in o.STATUSES.items()])
    return events(spark, sf).select(
        "event_id", F.concat(F.lit("src"), (F.col("user_id") % 7).cast("string")).alias("source"),
        F.concat(F.lit("ad"), (F.col("user_id") % 3).cast("string")).alias("adapter"), status.alias("status"),
        (status == "success").alias("success"), F.round(F.col("value") * 10).cast("long").alias("latency_ms"), F.col("ts").cast("timestamp").alias("at"))


def observation_stream(spark, sf):
    """Each event twice, as if two collectors had reported it within the same minute."""
    copies = F.explode(F.array(F.lit(0), F.lit(1)))
    return late_stream(spark, sf).select("event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("collected_at"), copies.alias("copy"))


def with_key(df):
    """Duplicate key over the 60-second bucket and the event's identity."""
    seconds = F.unix_seconds("collected_at")
    keyed = df.withColumn("bucket", seconds - F.pmod(seconds, F.lit(ob.BUCKET_SECONDS)))
    return keyed.withColumn("duplicate_key", F.sha2(canonical_json("bucket", "event_id", "event_type", "user_id"), 256))


@query("T1s_stream_duplicate_suppression", """
  SELECT sha256(CAST(to_json({'bucket': epoch(s)::BIGINT - epoch(s)::BIGINT % 60, 'event_id': event_id, 'event_type': event_type, 'user_id': user_id}) AS VARCHAR)) AS duplicate_key,
    event_id, event_type, s IS NULL AS no_time, 'first' AS attempt
  FROM (SELECT *, date_trunc('second', ts) AS s FROM events)""")
def _(spark, sf):
    root = work_dir(spark, "dedup")
    for attempt in ("first", "replay"):  # the second run offers the same rows again, in other epochs
        stream = ingest.suppressed(with_key(observation_stream(spark, sf)).withColumn("attempt", F.lit(attempt)), NOW, delay="15 days")
        runs.drain(stream, f"{root}/{attempt}", ingest.suppress_sink(f"{root}/out", attempt))
    return spark.read.parquet(f"{root}/out").select("duplicate_key", "event_id", "event_type", F.col("collected_at").isNull().alias("no_time"), "attempt")


@query("T2s_late_quote_quarantine", f"""
  SELECT CASE WHEN ts < TIMESTAMP '{NOW}' - INTERVAL 36 HOUR THEN 'QUARANTINED' ELSE 'ACCEPTED' END AS disposition, event_type, count(*) AS n
  FROM events GROUP BY ALL""")
def _(spark, sf):
    root = work_dir(spark, "late")
    stream = event_stream(spark, sf).withColumn("collected_at", F.col("ts").cast("timestamp"))
    runs.drain(stream, f"{root}/checkpoint", ingest.quarantine_sink(f"{root}/out", NOW))
    return spark.read.parquet(f"{root}/out").groupBy("disposition", "event_type").agg(F.count(F.lit(1)).alias("n"))


def line_stream(spark, sf, **options):
    return runs.file_stream(spark, f"{sf}/lineitem*.parquet", R.table(spark, sf, "lineitem").schema, **options)


def quote_stream(spark, sf):
    """Line items arriving as a stream, put in quote form by stream-static joins."""
    quotes = R.quote_view(line_stream(spark, sf), spark, sf)
    return quotes.select(*QUOTE_KEY, "departure_date", "price", "disposition")


@query("T3s_idempotent_append", sql("""
  SELECT source, count(DISTINCT (route, carrier, apw_days, flight_number, fare_family, cabin, stops, collected_date)) AS n FROM quotes GROUP BY 1""", "quotes"))
def _(spark, sf):
    root = work_dir(spark, "append")
    for attempt in ("first", "replay"):  # the second run offers the same rows again
        runs.drain(quote_stream(spark, sf), f"{root}/{attempt}", ingest.append_sink(f"{root}/store"))
    return spark.read.parquet(f"{root}/store").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("T4s_stream_daily_counts", f"SELECT source, CAST(at_ts AS DATE) AS day, count(*) AS n FROM {ATT} GROUP BY ALL")
def _(spark, sf):
    updates = runs.run_to_table(stateful.daily_counts(attempt_stream(spark, sf, late_stream)), "quota", "update")
    return runs.latest_updates(updates, ["source", "day"])


def circuit_sql(threshold: int, cooldown: int) -> str:
    """WITH RECURSIVE att, run: the circuit after each attempt."""
    return f"""
  WITH RECURSIVE att AS (SELECT source, adapter, event_id, at_ts, success, status, row_number() OVER (PARTITION BY source, adapter ORDER BY at_ts, event_id) AS rn,
      NOT success AND status IN ('unsupported', 'no_results') AS neutral, NOT success AND status IN ('blocked', 'captcha_blocked', 'policy_denied', 'source_changed') AS policy
    FROM {ATT}),
  run AS (SELECT source, adapter, 0::BIGINT AS rn, NULL::BIGINT AS event_id, NULL::TIMESTAMP AS at_ts, 'closed' AS state, 0::BIGINT AS consecutive, NULL::TIMESTAMP AS cooldown_until
    FROM (SELECT DISTINCT source, adapter FROM att)
    UNION ALL SELECT source, adapter, rn, event_id, at_ts,
      CASE WHEN success THEN 'closed' WHEN neutral THEN found WHEN trips THEN 'open' WHEN found = 'half_open' THEN 'half_open' ELSE 'closed' END,
      CASE WHEN success THEN 0 WHEN neutral THEN consecutive ELSE consecutive + 1 END,
      CASE WHEN success THEN NULL WHEN NOT neutral AND trips THEN at_ts + INTERVAL {cooldown} SECOND ELSE cooldown_until END
    FROM (SELECT a.*, r.consecutive, r.cooldown_until, a.policy OR r.consecutive >= {threshold - 1} AS trips,
            CASE WHEN r.state = 'open' AND r.cooldown_until <= a.at_ts THEN 'half_open' ELSE r.state END AS found
          FROM run r JOIN att a ON a.source = r.source AND a.adapter = r.adapter AND a.rn = r.rn + 1))"""


def circuits(spark, sf, **options):
    """The circuit after each event, by the stream over five shuffled triggers."""
    stream = attempt_stream(spark, sf, shuffled_stream)
    return runs.run_to_table(stateful.circuit_states(stream, f"{LATENESS_DAYS} days", **options), "circuit", **runs.ROCKS).drop("epoch")


@query("T5s_circuit_states", circuit_sql(5, 60) + """
  SELECT source, adapter, event_id, at_ts AS "at", state, consecutive, cooldown_until FROM run WHERE rn > 0""")
def _(spark, sf):
    return circuits(spark, sf)


# Limits under which every reason of the audit occurs in the events.
AUDIT_THRESHOLD, AUDIT_COOLDOWN, AUDIT_QUOTA, AUDIT_INTERVAL = 2, 21600, 30, 600


@query("J16_eligibility_history", circuit_sql(AUDIT_THRESHOLD, AUDIT_COOLDOWN) + f""",
  state AS (SELECT run.*, max(CASE WHEN NOT success THEN {{'rn': att.rn, 'status': status}} END) OVER (PARTITION BY run.source, run.adapter ORDER BY run.rn) AS f
    FROM run JOIN att ON att.source = run.source AND att.adapter = run.adapter AND att.rn = run.rn),
  asked AS (SELECT att.source, att.adapter, att.event_id, att.at_ts, k, rank() OVER d - 1 AS n_before, max(att.at_ts) OVER (d GROUPS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_at
    FROM att JOIN (SELECT s_suppkey AS k FROM supplier WHERE s_suppkey <= 7) ON att.source = 'src' || (k - 1) WINDOW d AS (PARTITION BY att.source, att.at_ts::DATE ORDER BY att.at_ts)),
  known AS (SELECT q.*, s.state, s.cooldown_until, s.f.status AS failure FROM asked q ASOF LEFT JOIN state s ON s.source = q.source AND s.adapter = q.adapter AND q.at_ts > s.at_ts),
  judged AS (SELECT *, list_filter([CASE WHEN k = 7 THEN 'SOURCE_DISABLED' END, CASE WHEN k = 5 THEN 'TERMS_REVIEW_REQUIRED' END, CASE WHEN k <> 5 AND k % 3 = 0 THEN 'TERMS_REVIEW_STALE' END,
      CASE WHEN k = 4 THEN 'ROBOTS_UNKNOWN' END, CASE WHEN adapter = 'ad2' THEN 'MOCK_COLLECTOR_IN_LIVE_MODE' END,
      CASE WHEN state = 'open' AND failure IN ('captcha_blocked', 'blocked', 'policy_denied') THEN 'CIRCUIT_OPEN_RESTRICTION'
           WHEN state = 'open' AND cooldown_until > at_ts THEN 'CIRCUIT_OPEN' END], lambda x: x IS NOT NULL) AS reasons,
      list_filter([CASE WHEN n_before >= {AUDIT_QUOTA} THEN 'DAILY_QUOTA_EXHAUSTED' END, CASE WHEN at_ts - last_at < INTERVAL {AUDIT_INTERVAL} SECOND THEN 'MINIMUM_INTERVAL' END], lambda x: x IS NOT NULL) AS rates
    FROM known)
  SELECT source, CASE WHEN len(reasons) = 0 AND len(rates) > 0 THEN 'DENY' WHEN len(reasons) = 0 THEN 'ALLOW'
      WHEN len(list_filter(reasons, lambda x: NOT (x LIKE '%REVIEW_REQUIRED' OR x LIKE '%STALE' OR x = 'ROBOTS_UNKNOWN'))) = 0 THEN 'REVIEW_REQUIRED' ELSE 'DENY' END AS decision,
    array_to_string(CASE WHEN len(reasons) = 0 THEN rates ELSE reasons END, ',') AS reasons, count(*) AS n FROM judged GROUP BY ALL""")
def _(spark, sf):
    made = attempts(spark, sf).withColumn("at", F.col("at").cast("timestamp"))
    policy = policies(spark, sf).where("source_id <= 7").withColumns({
        "source_id": F.concat(F.lit("src"), (F.col("source_id") - 1).cast("string")), "daily_request_limit": F.lit(AUDIT_QUOTA), "minimum_interval_seconds": F.lit(AUDIT_INTERVAL)})
    asked = made.select("event_id", F.col("source").alias("source_id"), "adapter", "at", F.lit("AFR").alias("origin"), F.lit("DEL").alias("destination"))
    after = circuits(spark, sf, threshold=AUDIT_THRESHOLD, cooldown=AUDIT_COOLDOWN).join(made.select("event_id", F.when(~F.col("success"), F.col("status")).alias("failure")), "event_id")
    found = op.eligibility_at(asked, policy, after.withColumnRenamed("source", "source_id"), made.select(F.col("source").alias("source_id"), "at"), POLICY_NOW, mock_adapters=["ad2"])
    return found.groupBy(F.col("source_id").alias("source"), "decision", F.concat_ws(",", "reasons").alias("reasons")).agg(F.count(F.lit(1)).alias("n"))


@query("T6s_stream_adapter_totals", f"""
  SELECT source, adapter, count(*) FILTER (success) AS success_count, count(*) FILTER (NOT success AND status <> 'no_results') AS failure_count,
         round(avg(latency_ms) FILTER (success OR status <> 'no_results'), 6) AS average_latency_ms FROM {ATT} GROUP BY ALL""")
def _(spark, sf):
    updates = runs.run_to_table(stateful.adapter_totals(attempt_stream(spark, sf)), "totals", "update")
    return runs.latest_updates(updates, ["source", "adapter"])


LANED = """WITH RECURSIVE days AS (SELECT date_diff('day', DATE '1970-01-01', min(ts)::DATE) AS first, date_diff('day', DATE '1970-01-01', max(ts)::DATE) AS last FROM events),
  ev AS (SELECT *, row_number() OVER (PARTITION BY source, lane ORDER BY part, event_id) AS rn FROM (
    SELECT 'src' || (user_id % 7) AS source, ('0x' || substr(md5(event_id::VARCHAR), 1, 8))::BIGINT % 16 AS lane, event_id, CAST(to_json({'event_id': event_id, 'event_type': event_type}) AS VARCHAR) AS body,
      coalesce(floor(3 * (last - date_diff('day', DATE '1970-01-01', ts::DATE)) / (last - first + 1)), 2) AS part FROM events, days)),
  chain AS (SELECT source, lane, rn, sha256(repeat('0', 64) || body) AS h FROM ev WHERE rn = 1
    UNION ALL SELECT e.source, e.lane, e.rn, sha256(c.h || e.body) FROM chain c JOIN ev e ON e.source = c.source AND e.lane = c.lane AND e.rn = c.rn + 1)"""


def chained(spark, sf):
    """The events chained in three triggers; the ledger's folder."""
    records = late_stream(spark, sf).select(
        F.concat(F.lit("src"), (F.col("user_id") % 7).cast("string")).alias("source"), "event_id", canonical_json("event_id", "event_type").alias("body"))
    root = work_dir(spark, "chain")
    runs.drain(records, f"{root}/checkpoint", chain.chain_sink(f"{root}/ledger", lanes=16))
    return f"{root}/ledger"


@query("T7s_stream_hash_chain", LANED + """
  SELECT source, lane, count(*) AS n_records, 0::BIGINT AS n_broken, CAST(NULL AS BIGINT) AS first_broken_seq, arg_max(h, rn) AS tip_hash FROM chain GROUP BY ALL""")
def _(spark, sf):
    return lg.chain_summary(chain.records(spark, chained(spark, sf)), F.col("body"), ["source", "lane"], per_bucket=500)


@query("T7s_ledger_root", LANED + """
  SELECT 2::BIGINT AS epoch, root, n AS n_lanes, (SELECT count(*) FROM events) AS n_records FROM """ + merkle_sql(
    "SELECT concat_ws('|', source, lane, count(*), arg_max(h, rn)) AS line FROM chain GROUP BY source, lane"))
def _(spark, sf):
    path = chained(spark, sf)
    wrong = chain.verify(spark, path)
    return chain.anchors(spark, path).where("epoch = 2").join(wrong.select("epoch").distinct(), "epoch", "left_anti").select("epoch", "root", "n_lanes", "n_records")


@query("T8s_incremental_republish", sql("""
  SELECT period, round(value, 6) AS value FROM head_book WHERE omega_preset = 'uniform'""", "head_book").replace(
    "avg(ln(price)) AS lp, exp(avg(ln(price))) AS price, count(*) AS n_sources\n      FROM quotes WHERE",
    "avg(ln(price)) AS lp, exp(avg(ln(price))) AS price, count(*) AS n_sources\n      FROM (SELECT route, carrier, apw_days, flight_number, fare_family, "
    "cabin, stops, collected_date, source, min(price) AS price, 'ACCEPTED' AS disposition FROM quotes GROUP BY ALL) WHERE"))
def _(spark, sf):
    from ..sources.index_store import read_index_values
    root = work_dir(spark, "republish")
    w = weights(spark)
    quotes = R.retail_quotes(spark, sf).withColumn("departure_date", F.col("collected_date")).select(*QUOTE_KEY, "departure_date", "price", "disposition")
    quotes = materialise(quotes, "quotes")  # read for the first date and for each trigger
    first = quotes.agg(F.min("collected_date").cast("string")).first()[0]
    method = Method(bootstrap_draws=0, base_period=first)
    part = F.floor((F.year("collected_date") - int(first[:4])) / 2)  # two years a trigger
    stream = triggered(spark, quotes, F.least(F.greatest(part, F.lit(0)), F.lit(3)), 4)
    for attempt in ("first", "replay"):  # the second run offers the same rows again
        runs.drain(stream, f"{root}/{attempt}", ingest.republish_sink(f"{root}/view", w, method, attempt))
    return read_index_values(spark, f"{root}/view/index").select("period", "value")
