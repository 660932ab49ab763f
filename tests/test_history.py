"""Look-ups by time against loops over all rows."""
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pricemill.functions.ordered import as_of
from pricemill.operators import operations as op

BASE = datetime(2026, 1, 1)
NOW = "2026-03-01 00:00:00"


@pytest.mark.parametrize("bucket_seconds", [1, 50, 10 ** 9])
def test_as_of_equals_a_loop(spark, bucket_seconds):
    rnd = random.Random(bucket_seconds)
    moment = lambda: None if rnd.random() < 0.03 else BASE + timedelta(seconds=rnd.randrange(400))
    key = lambda: rnd.choice(["a", "a", "b", "c", None])
    left = [(i, key(), moment(), "x") for i in range(150)]
    right = [(key(), moment(), rnd.choice([None, rnd.randrange(10 ** 6)]), f"s{i}") for i in range(200)]
    right = list({(r[0], r[1]): r for r in right}.values())  # one row per key and time, so that the last one is unique
    got = as_of(spark.createDataFrame(left, "id int, k string, at timestamp, v string"), spark.createDataFrame(right, "k string, at timestamp, v int, s string").withColumnRenamed("v", "w"),
                ["k"], "at", ["w", "s"], F.floor(F.unix_seconds("at") / bucket_seconds), count="n")
    assert got.columns == ["id", "k", "at", "v", "w", "s", "n"]
    rows = {r["id"]: (r["w"], r["s"], r["n"]) for r in got.collect()}
    for ident, k, at, _ in left:
        past = sorted((r for r in right if k is not None and at is not None and r[0] == k and r[1] is not None and r[1] < at), key=lambda r: r[1])
        known = [r[2] for r in past if r[2] is not None]
        if k is not None and at is not None:
            assert rows[ident] == (known[-1] if known else None, past[-1][3] if past else None, len(past))
    assert len(rows) == len(left)


def audit(spark, asked, circuits=(), requests=(), live=True, **policy):
    base = dict(source_id="s", enabled=True, automation_allowed=True, temporarily_blocked=False, terms_review_status="approved", terms_checked_at=datetime(2026, 2, 1),
                robots_status="allowed", robots_checked_at=datetime(2026, 2, 20), minimum_interval_seconds=5, daily_request_limit=3, allowed_routes=["*"], source_type="airline")
    row = {**base, **policy}
    policies = spark.createDataFrame([tuple(row.values())], "source_id string, enabled boolean, automation_allowed boolean, temporarily_blocked boolean, terms_review_status string, "
                                     "terms_checked_at timestamp, robots_status string, robots_checked_at timestamp, minimum_interval_seconds int, daily_request_limit int, "
                                     "allowed_routes array<string>, source_type string")
    queries = spark.createDataFrame([("s", a, BASE + timedelta(seconds=t), "DEL", "BOM") for a, t in asked], "source_id string, adapter string, at timestamp, origin string, destination string")
    states = spark.createDataFrame([("s", a, BASE + timedelta(seconds=t), state, None if until is None else BASE + timedelta(seconds=until), failure) for a, t, state, until, failure in circuits],
                                   "source_id string, adapter string, at timestamp, state string, cooldown_until timestamp, failure string")
    sent = spark.createDataFrame([("s", BASE + timedelta(seconds=t)) for t in requests], "source_id string, at timestamp")
    got = op.eligibility_at(queries, policies, states, sent, NOW, live=live).orderBy("at").collect()
    return [(r["decision"], r["reasons"]) for r in got]


def test_open_circuits(spark):
    opened = [("api", 10, "open", 70, "network_error"), ("html", 10, "open", 70, "blocked")]
    assert audit(spark, [("api", 5), ("api", 20), ("api", 70)], opened) == [("ALLOW", []), ("DENY", ["CIRCUIT_OPEN"]), ("ALLOW", [])]
    assert audit(spark, [("html", 20), ("html", 500)], opened) == [("DENY", ["CIRCUIT_OPEN_RESTRICTION"])] * 2
    closed = [*opened, ("api", 30, "closed", None, None)]
    assert audit(spark, [("api", 31)], closed) == [("ALLOW", [])]


def test_rates_stand_only_where_nothing_else_does(spark):
    sent = [0, 10, 20, 30]
    assert audit(spark, [("api", 11), ("api", 19), ("api", 29), ("api", 86400 + 1)], requests=sent) == [
        ("DENY", ["MINIMUM_INTERVAL"]), ("ALLOW", []), ("DENY", ["DAILY_QUOTA_EXHAUSTED"]), ("ALLOW", [])]
    assert audit(spark, [("api", 31)], requests=sent) == [("DENY", ["DAILY_QUOTA_EXHAUSTED", "MINIMUM_INTERVAL"])]
    assert audit(spark, [("api", 31)], requests=sent, enabled=False) == [("DENY", ["SOURCE_DISABLED"])]
    assert audit(spark, [("api", 31)], requests=sent, robots_status="unknown") == [("REVIEW_REQUIRED", ["ROBOTS_UNKNOWN"])]


def test_mock_collectors(spark):
    assert audit(spark, [("mock", 1)]) == [("DENY", ["MOCK_COLLECTOR_IN_LIVE_MODE"])]
    assert audit(spark, [("mock", 1)], live=False) == [("ALLOW", [])]
