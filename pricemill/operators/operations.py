"""Operational logs: adapter statistics, status tallies, failure classes, path rules, eligibility."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.ordered import as_of
from .observations import codes

# Status domains of a collection attempt.
NEUTRAL = ("unsupported", "no_results")
RESTRICTED = ("rate_limited", "blocked", "captcha_blocked", "policy_denied")
POLICY_OPEN = ("blocked", "captcha_blocked", "policy_denied", "source_changed")
FAILOVER = ("egress_unhealthy", "dead_proxy", "connection_timeout", "tls_failure", "proxy_infrastructure")


def http_class(status: Column) -> Column:
    return (
        F.when(status.isNull(), "none").when(status.between(200, 299), "http_2xx").when(status == 429, "http_429")
        .when(status == 403, "http_403").when(status.between(400, 499), "http_4xx").when(status >= 500, "http_5xx").otherwise("none")
    )


def failure_class(status: Column, http_status: Column, network: Column) -> Column:
    """Tell a source's restriction from a failure of the network."""
    return (
        F.when(status.isin(*RESTRICTED) | F.coalesce(http_status.isin(401, 403, 429), F.lit(False)), "source_restriction")
        .when(network.isin(*FAILOVER), network)
        .when(status == "network_error", F.when(network != "none", network).otherwise("connection_timeout"))
        .otherwise("none")
    )


def adapter_stats(attempts: DataFrame) -> DataFrame:
    """Counts, mean latency of counted attempts and last outcomes per (source, adapter)."""
    ok = F.col("success")
    failed = ~ok & ~F.col("status").isin(*NEUTRAL)
    counted = ok | failed
    return attempts.groupBy("source", "adapter").agg(
        F.count_if(ok).alias("success_count"),
        F.count_if(failed).alias("failure_count"),
        F.avg(F.when(counted, F.col("latency_ms"))).alias("average_latency_ms"),
        F.max(F.when(ok, F.col("at"))).alias("last_success_at"),
        F.max(F.when(failed, F.col("at"))).alias("last_failure_at"),
        F.max_by(F.when(~ok, F.col("status")), F.when(~ok, F.col("at"))).alias("last_failure_kind"),
    )


def platform_status(sources: DataFrame, jobs: DataFrame, recent: int = 10) -> DataFrame:
    """Source and job tallies with a banner when one of the latest jobs was denied."""
    src = sources.agg(F.count_if("enabled").alias("enabled_sources"), F.count_if("temporarily_blocked").alias("blocked_sources"))
    pending = jobs.agg(F.count_if(F.col("status") == "pending").alias("pending_jobs"))
    last = jobs.orderBy(F.desc("created_at"), F.desc("job_id")).limit(recent)
    denied = last.agg(F.count_if(F.col("status") == "denied").alias("denied_recent"))
    return src.select(
        "*", pending.scalar().alias("pending_jobs"), denied.scalar().alias("denied_recent")
    ).withColumn("banner", F.when(F.col("denied_recent") > 0, "collection denied recently"))


def node_health(nodes: DataFrame) -> DataFrame:
    return nodes.agg(
        F.count_if("enabled").alias("enabled"), F.count_if(F.col("enabled") & F.col("healthy")).alias("healthy"),
        F.count_if(F.col("enabled") & ~F.col("healthy")).alias("unhealthy"), F.sum("sessions").alias("sessions"))


def path_policy(urls: DataFrame, blocked: Sequence[str], allowed: Sequence[str] = ("*",), url: str = "url") -> DataFrame:
    """First blocking rule of each URL, else whether an allow rule admits it.

    The rules of a source are a short list; they become one expression, so the URL table is scanned
    once and never joined.
    """
    u = F.col(url)
    path = F.coalesce(F.nullif(F.try_parse_url(u, F.lit("PATH")), F.lit("")), F.lit("/"))
    hits = []
    for rule in blocked:
        token = rule.strip()
        if not token or token == "*":
            continue
        if token.startswith(("http://", "https://")):
            hits.append(F.when(F.lower(u).startswith(token.lower()), F.lit(token)))
        else:
            hits.append(F.when(path.startswith(token if token.startswith("/") else f"/{token}"), F.lit(rule)))
    rule = F.coalesce(*hits) if hits else F.lit(None).cast("string")
    admitted = F.lit("*" in allowed)
    for a in allowed:
        admitted = admitted | path.startswith(a)
    reason = F.when(rule.isNotNull(), rule).when(~admitted, "not-in-allowed-paths")
    return urls.withColumn("path", path).withColumn("denied_by", reason).withColumn("permitted", F.col("denied_by").isNull())


def eligibility(queries: DataFrame, policies: DataFrame, now: str, terms_days: int = 365, robots_days: int = 30,
                live: bool = True) -> DataFrame:
    """ALLOW, DENY or REVIEW_REQUIRED per query against the policy of its source, with reasons."""
    moment = F.lit(now).cast("timestamp")
    terms, robots = F.col("terms_review_status"), F.col("robots_status")
    age_terms = F.floor((F.unix_seconds(moment) - F.unix_seconds("terms_checked_at")) / 86400)
    age_robots = F.floor((F.unix_seconds(moment) - F.unix_seconds("robots_checked_at")) / 86400)
    unclear = terms.isin("unknown", "stale", "review_required")
    reviewed = ~unclear & (terms != "denied")
    readable = ~robots.isin("unknown", "unreadable", "disallowed")
    route = F.concat_ws("-", "origin", "destination")
    reasons = codes(
        (~F.col("enabled"), "SOURCE_DISABLED"),
        (~F.col("automation_allowed"), "AUTOMATION_NOT_ALLOWED"),
        (F.col("temporarily_blocked"), "SOURCE_TEMPORARILY_BLOCKED"),
        (terms == "denied", "TERMS_DENIED"),
        (unclear | (reviewed & F.col("terms_checked_at").isNull()), "TERMS_REVIEW_REQUIRED"),
        (reviewed & (age_terms > terms_days), "TERMS_REVIEW_STALE"),
        (robots.isin("unknown", "unreadable") | (readable & F.col("robots_checked_at").isNull()), "ROBOTS_UNKNOWN"),
        (robots == "disallowed", "ROBOTS_DISALLOWED"),
        (readable & (age_robots > robots_days), "ROBOTS_REVIEW_STALE"),
        (F.col("minimum_interval_seconds").isNull() | (F.col("daily_request_limit") < 1), "RATE_POLICY_MISSING"),
        (~F.array_contains("allowed_routes", "*") & ~F.array_contains("allowed_routes", route), "ROUTE_NOT_PERMITTED"),
        ((F.col("source_type") == "mock") & F.lit(live), "MOCK_SOURCE_IN_LIVE_MODE"),
    )
    return queries.join(policies, "source_id").withColumn("reasons", reasons).withColumn("decision", _decision())


def _decision() -> Column:
    soft = lambda c: c.endswith("REVIEW_REQUIRED") | c.endswith("STALE") | (c == "ROBOTS_UNKNOWN")
    return F.when(F.size("reasons") == 0, "ALLOW").when(F.forall("reasons", soft), "REVIEW_REQUIRED").otherwise("DENY")


# Failures that keep a circuit shut out whatever its cooldown.
RESTRICTIONS = ("captcha_blocked", "blocked", "policy_denied")
HISTORY_BUCKET_SECONDS = 3600


def eligibility_at(queries: DataFrame, policies: DataFrame, circuits: DataFrame, requests: DataFrame, now: str,
                   mock_adapters: Sequence[str] = ("mock",), **policy) -> DataFrame:
    """``eligibility`` of queries that were asked at a time of a source's adapter, with the state of circuit and quota at that time.

    ``queries`` holds source_id, adapter and ``at``; ``circuits`` (source_id, adapter, at, state, cooldown_until, failure) the state that follows
    each attempt, ``failure`` being the kind of a failed one; ``requests`` (source_id, at) what was sent. Rate reasons are looked at only where
    no other stands against a query. How many requests were in flight isn't in the log.
    """
    hour = F.floor(F.unix_seconds("at") / HISTORY_BUCKET_SECONDS)
    asked = eligibility(queries, policies, now, **policy).withColumn("day", F.to_date("at"))
    stated = as_of(asked, circuits, ["source_id", "adapter"], "at", ["state", "cooldown_until", "failure"], hour)
    sent = requests.select("source_id", "at", F.to_date("at").alias("day"), F.col("at").alias("last_at"))
    rated = as_of(stated, sent, ["source_id", "day"], "at", ["last_at"], hour, count="n_before")
    shut = F.col("state") == "open"
    restricted = F.col("failure").isin(*RESTRICTIONS)
    more = codes(
        (F.col("adapter").isin(*mock_adapters) & F.lit(policy.get("live", True)), "MOCK_COLLECTOR_IN_LIVE_MODE"),
        (shut & restricted, "CIRCUIT_OPEN_RESTRICTION"),
        (shut & ~F.coalesce(restricted, F.lit(False)) & (F.col("cooldown_until") > F.col("at")), "CIRCUIT_OPEN"))
    rates = codes(
        (F.col("n_before") >= F.col("daily_request_limit"), "DAILY_QUOTA_EXHAUSTED"),
        (F.unix_micros("at") - F.unix_micros("last_at") < 1_000_000 * F.col("minimum_interval_seconds"), "MINIMUM_INTERVAL"))
    held = rated.withColumn("reasons", F.concat("reasons", more)).withColumn("_rates", rates)
    limited = (F.size("reasons") == 0) & (F.size("_rates") > 0)
    return held.withColumn("decision", F.when(limited, "DENY").otherwise(_decision())).withColumn(
        "reasons", F.when(limited, F.col("_rates")).otherwise(F.col("reasons"))).drop("_rates")


def daily_requests(attempts: DataFrame, limit: Column | None = None) -> DataFrame:
    """Requests per source and day, with whether the quota is used up."""
    per = attempts.groupBy("source", F.to_date("at").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return per if limit is None else per.withColumn("exhausted", F.col("n") >= limit)


def running_stats(attempts: DataFrame) -> DataFrame:
    """Success share and mean latency so far, at the end of each day; days are folded first."""
    day = attempts.groupBy("source", "adapter", F.to_date("at").alias("day")).agg(
        F.count_if("success").alias("ok"), F.count(F.lit(1)).alias("n"), F.sum("latency_ms").alias("latency"))
    so_far = W.partitionBy("source", "adapter").orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    return day.select(
        "source", "adapter", "day", F.sum("n").over(so_far).alias("n_so_far"),
        (F.sum("ok").over(so_far) / F.sum("n").over(so_far)).alias("success_share"),
        (F.sum("latency").over(so_far) / F.sum("n").over(so_far)).alias("mean_latency"))
