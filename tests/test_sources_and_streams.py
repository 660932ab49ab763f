import random
from datetime import date, datetime, timedelta
from types import SimpleNamespace

import pandas as pd
import pytest
from panels import frame, quote
from pyspark.sql import functions as F

from pricemill.functions import digests
from pricemill.operators import extraction as ex
from pricemill.operators import ledger as lg
from pricemill.operators import observations as ob
from pricemill.schemas import LEDGER_FIELDS
from pricemill.session import materialise, work_dir
from pricemill.sources import index_store as store
from pricemill.sources import reference as ref
from pricemill.sources.quotes import append_quotes
from pricemill.streaming import chain, ingest, runs, stateful


def test_append_is_idempotent(spark):
    path = work_dir(spark, "store")
    day1 = frame(spark, [quote(0, flight=f) for f in range(3)]).withColumn("source", F.lit("s"))
    day2 = frame(spark, [quote(1, flight=f) for f in range(3)]).withColumn("source", F.lit("s"))
    append_quotes(day1.unionByName(day1), path)
    append_quotes(day1.unionByName(day2), path)
    assert spark.read.parquet(path).count() == 6


def test_index_store_keeps_the_latest(spark):
    path = work_dir(spark, "index")
    def row(value, at):
        return spark.createDataFrame([("I", date(2026, 1, 1), "daily", "book", "uniform", "1", "v1", value, at)],
                                     "index_code string, period date, frequency string, basis string, omega_preset string, method_version string, "
                                     "weights_version string, value double, computed_at long")
    store.write_index_values(row(1.0, 1), path)
    first = store.read_index_values(spark, path).first()
    store.write_index_values(row(2.0, 2), path)
    again = store.read_index_values(spark, path).collect()
    assert len(again) == 1 and again[0]["value"] == 2.0 and again[0]["index_id"] == first["index_id"]


def ledger(spark, tamper=None):
    rows = [{k: None for k in LEDGER_FIELDS} | {"seq": i, "source": "s", "outcome": "OK", "n_quotes": 10 * i, "ladder_rung": 1} for i in range(1, 6)]
    types = {"seq": "long", "ladder_rung": "int", "http_status": "int", "n_quotes": "int"}
    df = spark.createDataFrame([tuple(r[k] for k in LEDGER_FIELDS) for r in rows], ", ".join(f"{k} {types.get(k, 'string')}" for k in LEDGER_FIELDS))
    chained = lg.chain_records(df, ["run_id"], lg.payload())
    return chained.withColumn("n_quotes", F.when(F.col("seq") == tamper, 0).otherwise(F.col("n_quotes"))) if tamper else chained


def test_chain_verifies_and_reports_the_first_break(spark):
    whole = lg.chain_summary(ledger(spark), per_bucket=2).first()
    assert (whole["n_records"], whole["n_broken"], whole["first_broken_seq"]) == (5, 0, None)
    assert lg.chain_summary(ledger(spark, 3), per_bucket=2).first()["first_broken_seq"] == 3


def test_duplicate_key_buckets(spark):
    t = datetime(2026, 1, 1, 10, 0, 5)
    rows = [(t, "100"), (t + timedelta(seconds=50), "100"), (t + timedelta(seconds=60), "100"), (t, "101")]
    df = spark.createDataFrame(rows, "collected_at timestamp, total_fare string").selectExpr(
        "collected_at", "cast(total_fare as decimal(12,2)) total_fare", "'6E' carrier", "'DEL' origin_airport", "'BOM' destination_airport",
        "'1' flight_number", "'s' source", "date'2026-01-09' travel_date")
    keys = [r["duplicate_key"] for r in ob.duplicate_key(df).collect()]
    assert keys[0] == keys[1] and len(set(keys)) == 3


def test_extraction_inherits_context_and_rejects_other_queries(spark):
    body = ('{"trip": {"from": "DEL", "to": {"code": "bom"}, "departureDate": "2026-05-08", "airline": {"code": "6e"}, "offers": [{"flightNo": "6E 101", "totalFare": "INR 4,500.00"},'
            '{"flight_number": "6E101", "price": {"amount": 4500}}, {"flightNumber": "AI 9", "fare": -5}, {"price": 100}]}}')
    p = spark.createDataFrame([("a", body), ("b", body), ("c", "{broken")], "payload_id string, payload string")
    q = spark.createDataFrame([("a", "DEL", "BOM", date(2026, 5, 8)), ("b", "DEL", "BOM", date(2026, 5, 9))],
                              "payload_id string, query_origin string, query_destination string, query_travel_date date")
    got = ex.extract_fares(p, q).collect()
    assert [(r["payload_id"], r["flight_number"], r["carrier"], float(r["total_fare"])) for r in got] == [("a", "6E101", "6E", 4500.0)]


@pytest.mark.parametrize("offer, fare", [
    ('{"flightNo": "6E 101", "price": "n/a", "fare": 5000}', None),  # the first key that isn't empty decides
    ('{"flightNo": "6E 101", "price": "", "fare": 5000}', 5000.0),
    ('{"flightNo": "6E 101", "pri_ce": 5100}', 5100.0),  # separators and escapes in keys
    ('{"flightNo": "6E 101", "\\u0070rice": 5200}', 5200.0),
    ('{"flightNo": "6E 101", "price": [5300, 1]}', 5300.0),
    ('{"flightNo": "6E 101", "fare": {"amount": 0, "total": "Rs. 5,400"}}', 5400.0),
    ('{"flightNo": "6E 101", "price": 5500, "origin": "?"}', None),  # a key named as what is handed on stands
    ('{"flightNo": "6E 101", "price": 5600, "from": "?"}', 5600.0),
    ('{"flightNo": "6E 101", "price": 5700, "departure": "06:30"}', 5700.0),
    ('{"flightNo": "6E 101", "price": true}', None), ('{"price": 5800}', None), ('{"flightNo": null, "flightNumber": "6E7", "price": 1e3}', 1000.0)])
def test_extraction_of_siblings(spark, offer, fare):
    body = '{"from": "DEL", "to": "BOM", "date": "2026-05-08", "carrier": "6E", "list": [[' + offer + "]]}"
    p = spark.createDataFrame([("a", body, "DEL", "BOM", date(2026, 5, 8), "x")], "payload_id string, payload string, query_origin string, query_destination string, "
                                                                                 "query_travel_date date, price string")
    got = [float(r["total_fare"]) for r in ex.extract_fares(p.drop("price")).collect()]
    assert got == ([] if fare is None else [fare])


@pytest.mark.parametrize("text, month", [("January", 1), ("july", 7), ("Sep", 9), ("12", 12), ("nonsense", None)])
def test_months(spark, text, month):
    from pricemill.functions.scalars import parse_month
    assert spark.range(1).select(parse_month(F.lit(text))).first()[0] == month


def test_cpi_files_without_an_index_are_skipped_with_a_reason(spark):
    root = work_dir(spark, "cpi")
    cols = "Year string, Month string, State string, Sector string, Division string, Item string, Index string"
    good = spark.createDataFrame([("2025", "July", "All India", "Urban", "Transport", "", "101.5"), ("2025", "", "All India", "Urban", "Transport", "x", "1"),
                                  ("2025", "Aug", "All India", "Urban", "Transport", "Air fare", "99")], cols)
    good.write.option("header", True).csv(f"{root}/good")
    good.drop("Index").write.option("header", True).csv(f"{root}/bad")
    tidy, skipped = ref.load_cpi(spark, {f"{root}/good": 2024, f"{root}/bad": 2024, f"{root}/absent": 2024})
    assert sorted((r["level"], r["label"], r["month"], r["idx"]) for r in tidy.collect()) == [("division", "Transport", 7, 101.5), ("item", "Air fare", 8, 99.0)]
    assert len(skipped) == 2 and "index" in skipped[f"{root}/bad"]


def test_many_cpi_files_are_one_scan(spark):
    """A hundred files with headers of their own, in different column orders and spellings, a byte-order mark among them."""
    root = work_dir(spark, "many")
    import pathlib
    folder = pathlib.Path(root)
    folder.mkdir(parents=True)
    paths = {}
    for i in range(100):
        names = ["Year", "Month", "State", "Sector", "Sub Class", "Index", "Code"]
        random.Random(i).shuffle(names)
        line = {"Year": "2025", "Month": "Jul", "State": "All India", "Sector": "Urban", "Sub Class": f'"Air, fare {i}"', "Index": str(100 + i), "Code": ""}
        text = ("\ufeff" if i % 7 == 0 else "") + ",".join(names) + "\n" + ",".join(line[n] for n in names) + "\n"
        (folder / f"f{i}.csv").write_text(text, encoding="utf-8")
        paths[f"{root}/f{i}.csv"] = 2012 + i % 3
    (folder / "none.csv").write_text("1,2,3\n", encoding="utf-8")
    tidy, skipped = ref.load_cpi(spark, {**paths, f"{root}/none.csv": 2024})
    rows = {r["source_file"]: (r["base_year"], r["label"], r["level"], r["idx"], r["code"]) for r in tidy.collect()}
    assert rows == {f"f{i}.csv": (2012 + i % 3, f"Air, fare {i}", "sub_class", 100.0 + i, None) for i in range(100)}
    assert list(skipped) == [f"{root}/none.csv"]
    plan = tidy._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") <= 2 and "Union" not in plan


def attempts(spark, path, files=3):
    base = datetime(2026, 1, 1)
    statuses = ["success", "network_error", "network_error", "no_results", "network_error", "network_error", "network_error", "blocked", "success"]
    rows = [(i, f"s{i % 2}", "a", statuses[(i * 5 + i // 7) % 9], base + timedelta(seconds=20 * i)) for i in range(120)]
    for f in range(files):
        part = rows[f * 40:(f + 1) * 40]
        spark.createDataFrame(part, "event_id long, source string, adapter string, status string, at timestamp").withColumn(
            "success", F.col("status") == "success").coalesce(1).write.mode("append").parquet(path)
    return rows


ATTEMPT = "event_id long, source string, adapter string, status string, at timestamp"


def write_attempts(spark, path, rows):
    spark.createDataFrame(rows, ATTEMPT).withColumn("success", F.col("status") == "success").coalesce(1).write.mode("append").parquet(path)


@pytest.mark.parametrize("triggers", [1, 5])
@pytest.mark.parametrize("slot", [30, 600])
def test_circuit_state_of_shuffled_triggers_equals_a_loop(spark, triggers, slot):
    rows, path = attempts(spark, work_dir(spark, "unused")), work_dir(spark, "attempts")
    mixed = [*rows, (500, "s0", "a", "success", None)]
    random.Random(triggers).shuffle(mixed)
    for i in range(triggers):
        write_attempts(spark, path, mixed[i::triggers])
    write_attempts(spark, path, [(-1, "tick", "", "success", datetime(2026, 1, 3))])  # moves the watermark past all
    stream = runs.file_stream(spark, path, spark.read.parquet(path).schema, files_per_trigger=1)
    found = runs.run_to_table(stateful.circuit_states(stream, "12 hours", slot_seconds=slot), "circuit", **runs.ROCKS).collect()
    got = {r["event_id"]: (r["state"], r["consecutive"], r["cooldown_until"]) for r in found}
    state, want = {}, {}
    for ident, source, _, status, at in rows:
        want[ident] = state[source] = stateful.next_circuit(*state.get(source, ("closed", 0, None)), at, status == "success", status)
    assert got == want and len(found) == len(want)
    assert {s for s, *_ in got.values()} >= {"open", "closed"}


def test_idle_circuits_are_dropped(spark):
    base, path = datetime(2026, 1, 1), work_dir(spark, "idle")
    write_attempts(spark, path, [(i, "s", "a", "network_error", base + timedelta(seconds=i)) for i in range(4)])
    write_attempts(spark, path, [(9, "tick", "", "success", base + timedelta(hours=5))])
    write_attempts(spark, path, [(10, "s", "a", "network_error", base + timedelta(hours=6))])
    write_attempts(spark, path, [(11, "tick", "", "success", base + timedelta(hours=12))])
    stream = runs.file_stream(spark, path, spark.read.parquet(path).schema, files_per_trigger=1)
    for idle, count in ((3600, 1), (36000, 5)):
        rows = runs.run_to_table(stateful.circuit_states(stream, "10 minutes", idle_seconds=idle), "idle", **runs.ROCKS).where("event_id = 10").collect()
        assert [(r["consecutive"], r["state"]) for r in rows] == [(count, "open" if count == 5 else "closed")]


def test_days_and_places_that_come_again_are_judged_once():
    text = '{"from":"DEL","to":"BOM","date":"2026-02-30","results":[{"fare":"10","flightNo":"1","departureDate":"2026-02-03","carrier":"6E"}]}'
    ex._is_date.cache_clear()
    for _ in range(3):
        found = list(ex._candidates(ex.json.loads(text)))
        assert [(c["price"], c["origin"], c["travel_date"], c["carrier"]) for c in found] == [("10", "DEL", "2026-02-03", "6E")]
    assert ex._is_date.cache_info().misses == 2


def plain_candidates(payload):
    """The walk over a payload without anything that is remembered."""
    empty = (None, "", [], {})

    def text_of(value, field):
        if isinstance(value, dict):
            return next((t for key in field.inner if key in value and (t := text_of(value[key], field)) is not None), None)
        if isinstance(value, list):
            return text_of(value[0], field) if value and field.head else None
        return str(value) if value is not None and not isinstance(value, bool) and str(value) and field.valid(str(value)) else None

    stack = [(payload, {})]
    while stack:
        node, context = stack.pop()
        if isinstance(node, list):
            stack.extend((child, context) for child in node)
        if not isinstance(node, dict):
            continue
        first = {}
        for key, value in node.items():
            for name in ex._meanings(key):
                if value not in empty:
                    first.setdefault(name, value)
        known = context | {name: t for name in ex.INHERITED if name in first and (t := text_of(first[name], ex.FIELDS[name])) is not None}
        if "price" in first and "flight" in first and (price := text_of(first["price"], ex.FIELDS["price"])) is not None:
            own = {name: text_of(node[key], ex.FIELDS[name]) for name, key in ex.INHERITED.items() if node.get(key) not in empty}
            yield known | {"price": price} | own | {name: text_of(first[name], ex.FIELDS[name]) for name in ("flight", "brand", "departure_time", "arrival_time") if name in first}
        stack.extend((child, known) for child in node.values())


def test_objects_with_the_same_keys_are_read_alike():
    """Random payloads give what a plain walk gives, and what the keys of objects mean is found out once."""
    rnd = random.Random(5)
    keys = [*ex.BY_KEY, "Total_Fare", "flight_no", "departureDate", "iata", "results", "total", "x"]
    plain = [None, "", [], {}, 0, 0.0, False, True, 12.5, -3, "DEL", "d el", "XX", "6E", "2024-01-02", "2024-13-02", "06:30", "INR 1,200.50", "Rs 7", "abc", "1e3", "100", "99999999999"]

    def tree(depth):
        if not depth or rnd.random() < 0.35:
            return rnd.choice(plain)
        return [tree(depth - 1) for _ in range(rnd.randrange(4))] if rnd.random() < 0.2 else {rnd.choice(keys): tree(depth - 1) for _ in range(rnd.randrange(8))}

    trees = [tree(5) for _ in range(20000)]
    shown = lambda found: sorted(repr([c.get(n) for n in ex.FIELDS]) for c in found)
    assert sum(len(shown(ex._candidates(t))) for t in trees) > 1000
    for t in trees:
        assert shown(ex._candidates(t)) == shown(plain_candidates(t)), t
    ex._layout.cache_clear()
    for price in ("10", "11", "12"):
        assert len(list(ex._candidates({"from": "DEL", "results": [{"fare": price, "flightNo": "1"}, {"fare": "x", "flightNo": "2"}]}))) == 1
    assert ex._layout.cache_info().misses == 2  # every object was read key by key before


class Held:
    """State of one key, without Spark."""

    def __init__(self):
        self.values, self.calls, self.timers = {}, 0, []

    def getValueState(self, name, schema):
        one = self.getMapState(name, "", schema)
        return SimpleNamespace(exists=lambda: one.getValue(()) is not None, get=lambda: one.getValue(()), update=lambda v: one.updateValue((), v), clear=lambda: one.removeKey(()))

    def getMapState(self, name, key, schema):
        held = self.values.setdefault(name, {})

        def called(fn):
            def call(*args):
                self.calls += 1
                return fn(*args)
            return call
        return SimpleNamespace(getValue=called(held.get), updateValue=called(held.__setitem__), removeKey=called(lambda k: held.pop(k, None)), keys=called(lambda: list(held)))

    def registerTimer(self, at):
        self.timers.append(at)


def test_a_circuit_takes_one_timer_and_a_few_state_accesses_for_many_slots():
    base, n = datetime(2026, 1, 1), 2000
    statuses = ["success", "network_error", "no_results", "blocked"]
    rows = pd.DataFrame({"event_id": range(n), "status": [statuses[i * i % 7 % 4] for i in range(n)], "at": [base + timedelta(minutes=10 * i) for i in range(n)]})
    rows["success"] = rows["status"] == "success"
    held, tool = Held(), stateful.CircuitProcessor()
    tool.init(held)
    for part in (rows.sample(frac=1, random_state=1)[i::2] for i in range(2)):
        list(tool.handleInputRows(("s", "a"), iter([part]), None))
    end = held.timers[-1]
    passed = SimpleNamespace(getCurrentWatermarkInMs=lambda: int((base + timedelta(minutes=10 * n - 95) - datetime(1970, 1, 1)).total_seconds() * 1000))
    out = pd.concat(list(tool.handleExpiredTimer(("s", "a"), passed, SimpleNamespace(getExpiryTimeInMs=lambda: end))))
    assert len(held.timers) <= 3 and held.calls < n / 2
    state, want = ("closed", 0, None), []
    for r in rows.head(n - 10).itertuples():
        state = stateful.next_circuit(*state, r.at.to_pydatetime(), r.success, r.status)
        want.append((r.event_id, state[0], state[1], state[2]))
    assert [(r.event_id, r.state, r.consecutive, None if pd.isna(r.cooldown_until) else r.cooldown_until.to_pydatetime()) for r in out.itertuples()] == want
    assert held.timers[-1] > passed.getCurrentWatermarkInMs()


def test_cooled_circuit_is_probed_half_open():
    until = datetime(2026, 1, 1)
    assert stateful.next_circuit("open", 5, until, until, False, "no_results")[0] == "half_open"
    assert stateful.next_circuit("open", 5, until, until - timedelta(seconds=1), False, "no_results")[0] == "open"
    assert stateful.next_circuit("half_open", 5, until, until, False, "network_error") == ("open", 6, until + timedelta(seconds=60))


@pytest.fixture(scope="module")
def chained(spark):
    path, ledger = work_dir(spark, "chain"), work_dir(spark, "ledger")
    attempts(spark, path, 3)
    stream = runs.file_stream(spark, path, spark.read.parquet(path).schema, files_per_trigger=1)
    runs.drain(stream.select("source", "event_id", F.col("status").alias("body")), f"{ledger}-checkpoint", chain.chain_sink(ledger, lanes=4))
    return ledger


def test_hash_chain_over_several_batches_is_intact(spark, chained):
    out = lg.chain_summary(chain.records(spark, chained), F.col("body"), ["source", "lane"], per_bucket=7).collect()
    assert sum(r["n_records"] for r in out) == 120 and all(r["n_broken"] == 0 for r in out) and len(out) == 2 * 4
    assert chain.verify(spark, chained, per_bucket=7).collect() == []
    assert [(r["epoch"], r["n_records"]) for r in chain.anchors(spark, chained).orderBy("epoch").collect()] == [(0, 40), (1, 80), (2, 120)]


def test_a_replayed_trigger_leaves_the_same_ledger(spark, chained):
    before = sorted(chain.anchors(spark, chained).collect())
    last = chain.records(spark, chained).where("epoch = 2").select("source", "event_id", "body")
    chain.chain_sink(chained, lanes=4)(materialise(last, "again"), 2)
    assert sorted(chain.anchors(spark, chained).collect()) == before and chain.verify(spark, chained).collect() == []


def rewritten(spark, ledger, records):
    """A copy of a ledger with other records under the same anchors."""
    target = work_dir(spark, "tampered")
    records.write.partitionBy("epoch").parquet(f"{target}/records")
    chain.anchors(spark, ledger).write.parquet(f"{target}/anchors")
    return target


@pytest.mark.parametrize("how, faults", [
    ("changed", {"broken link"}), ("missing", {"broken link"}), ("reordered", {"broken link"}), ("end cut off", {"root differs"}), ("lane gone", {"root differs"}),
    ("anchor changed", {"root differs", "broken anchor"})])
def test_verification_finds(spark, chained, how, faults):
    held = chain.records(spark, chained)
    lane = (F.col("source") == "s1") & (F.col("lane") == 2)
    last = held.where(lane).agg(F.max("seq")).first()[0]
    at = F.col("seq")
    tampered = {
        "changed": held.withColumn("body", F.when(lane & (at == 3), "success!").otherwise(F.col("body"))),
        "missing": held.where(~(lane & (at == 3))),
        "reordered": held.withColumn("seq", F.when(lane & (at == 3), 4).when(lane & (at == 4), 3).otherwise(at).cast("long")),
        "end cut off": held.where(~(lane & (at == last))), "lane gone": held.where(~lane), "anchor changed": held}[how]
    path = rewritten(spark, chained, tampered)
    if how == "anchor changed":
        new = materialise(chain.anchors(spark, path).withColumn("root", F.when(F.col("epoch") == 1, F.sha2(F.lit("x"), 256)).otherwise(F.col("root"))), "anchors")
        path = work_dir(spark, "forged")
        held.write.partitionBy("epoch").parquet(f"{path}/records")
        new.write.parquet(f"{path}/anchors")
    assert {r["fault"] for r in chain.verify(spark, path, per_bucket=5).collect()} >= faults


def test_merkle_root_depends_on_the_lines_only(spark):
    df = spark.range(5000).select((F.col("id") % 3700).cast("string").alias("x")).union(spark.range(3000).select(F.lit("same")))
    roots = {digests.merkle_root(df.repartition(n), F.col("x")).first() for n in (1, 7, 211)}
    assert len(roots) == 1 and roots.pop()["n"] == 8000
    other = digests.merkle_root(df.where("x <> '17'"), F.col("x")).first()["root"]
    assert other != digests.merkle_root(df, F.col("x")).first()["root"]
    assert digests.merkle_root(df.limit(0), F.col("x")).first()["n"] == 0


def test_suppression_loses_nothing_and_keeps_one(spark):
    """Six triggers, rows ten days late, rows without a time, repeats in every trigger and in a second run."""
    base, path, out = datetime(2026, 1, 20), work_dir(spark, "rows"), work_dir(spark, "kept")
    rows = [(f"k{i}", None if i % 9 == 0 else base - timedelta(hours=7 * i)) for i in range(60)]  # up to 17 days old
    rnd = random.Random(2)
    for trigger in range(6):
        part = [r for r in rows if rnd.random() < 0.5 or trigger == int(r[0][1:]) % 6]
        spark.createDataFrame([(*r, trigger) for r in part + part[:5]], "duplicate_key string, collected_at timestamp, n int").coalesce(1).write.mode("append").parquet(path)
    for run in ("first", "replay"):
        stream = runs.file_stream(spark, path, spark.read.parquet(path).schema, files_per_trigger=1)
        runs.drain(ingest.suppressed(stream, "2026-01-20 00:00:00", delay="4 days"), f"{out}-{run}", ingest.suppress_sink(out, run))
    got = spark.read.parquet(out).collect()
    assert sorted(r["duplicate_key"] for r in got) == sorted(r[0] for r in rows) and {r["run"] for r in got} == {"first"}
    states = [p.name for p in __import__("pathlib").Path(f"{out}-first/state").glob("*")]
    assert states == ["0"]  # one operator holds state, the fresh rows' keys
