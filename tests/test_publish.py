import math
import random
from datetime import date, timedelta

import pytest
from panels import weights
from pyspark.sql import functions as F

from pricemill.operators import reproduce
from pricemill.operators.quality import PublicationBlocked
from pricemill.params import Method
from pricemill.plans.publish import ChargeBook, ingest, publish
from pricemill.schemas import CHARGES, TAXES
from pricemill.session import work_dir
from pricemill.sources.index_store import read_index_values
from test_cleaning import COLS

METHOD = Method(bootstrap_draws=0)


def raw(spark, days=12):
    rng = random.Random(9)  # moves of equal size would all fail the jump test
    rows = []
    for d in range(days):
        day = date(2026, 5, 1) + timedelta(days=d)
        for route in ("DEL-BOM", "DEL-BLR"):
            for a in (1, 7, 15, 30, 45):
                for i in range(18):
                    rows.append((day, day + timedelta(days=a), route, "6E", a, str(i // 3), "ABC"[i % 3], "economy", 0, "INR",
                                 5000.0 * math.exp(rng.gauss(0.02 * d, 0.03)), "DEL", route[-3:], False, "s"))
    return spark.createDataFrame(rows, COLS)


@pytest.fixture(scope="module")
def published(spark):
    root = work_dir(spark, "publish")
    book = ChargeBook(spark.createDataFrame([("DEL", 129.0, 236.0, date(2020, 1, 1), None)], CHARGES),
                      spark.createDataFrame([("economy", 0.05, date(2020, 1, 1), None)], TAXES), spark.createDataFrame([], "route string"), fee=299.0)
    for _ in range(2):
        ingest(raw(spark), book, f"{root}/store")
    w = weights(spark, {"DEL-BOM": 0.6, "DEL-BLR": 0.4})
    store = spark.read.parquet(f"{root}/store")
    checks = publish(store, w, METHOD, f"{root}/index", f"{root}/cells", "run-1", 1)
    return root, w, store, checks


def test_store_holds_each_quote_once(published):
    assert published[2].count() == 12 * 2 * 5 * 18


def test_family_is_complete_and_repeatable(spark, published):
    root, w, store, _ = published
    first = read_index_values(spark, f"{root}/index").cache()
    # Twelve days never fill three lead windows of one departure date, so the travel basis is withheld.
    heads = first.where("index_code NOT LIKE '%:%'")
    assert {tuple(r) for r in heads.select("index_code", "basis").distinct().collect()} == {(f"IDX-{v}", "book") for v in "BTA"}
    # Windows and routes of the headline variant are published beside it, daily and without intervals.
    detail = first.where("index_code LIKE 'IDX-T:%'")
    assert detail.count() + heads.count() == first.count() and {r[0] for r in detail.where("basis = 'book'").select("index_code").distinct().collect()} == {
        f"IDX-T{r}:apw={a}" for r in ("", ":route=DEL-BOM", ":route=DEL-BLR") for a in (1, 7, 15, 30, 45)}
    assert {tuple(r) for r in detail.select("frequency", "omega_preset").distinct().collect()} == {("daily", "uniform")}
    counted = heads.where("frequency = 'daily'").agg(F.min("n_quotes"), F.min("n_cells"), F.count("se")).first()
    assert counted[0] > 0 and counted[1] > 0 and counted[2] == 0  # no draws, no interval
    assert heads.where("frequency <> 'daily' AND (n_quotes IS NOT NULL OR value_native IS NULL)").count() == 0
    assert {r[0] for r in first.select("frequency").distinct().collect()} == {"daily", "weekly", "monthly"}
    publish(store, w, METHOD, f"{root}/index", f"{root}/cells", "run-2", 2)
    r = reproduce.report(reproduce.diff(first, read_index_values(spark, f"{root}/index"))).first()
    assert (r["n_missing"], r["n_new"], r["n_differing"]) == (0, 0, 0) and r["n_keys"] == first.count()
    daily = {r["period"]: r["value"] for r in first.where("index_code='IDX-A' AND basis='book' AND frequency='daily'").collect()}
    assert daily[date(2026, 5, 12)] > daily[date(2026, 5, 1)] > 0
    assert spark.read.parquet(f"{root}/cells").where("run_id = 'run-1' AND basis = 'book'").count() == 12 * 2 * 5


def test_headlines_carry_their_intervals(spark, published):
    root, w, store, _ = published
    target = work_dir(spark, "intervals")
    publish(store, w, Method(bootstrap_draws=40, basis="book", link_factor=110.0, base_period="2026-05-04"), f"{target}/index", f"{target}/cells", "run-6", 6)
    rows = read_index_values(spark, f"{target}/index").where("index_code = 'IDX-T' AND frequency = 'daily' AND basis = 'book' AND omega_preset = 'uniform'").collect()
    assert len(rows) == 12 and all(r["ci_low"] <= r["ci_high"] and r["se"] >= 0 for r in rows)
    assert sum(r["ci_low"] <= r["value"] <= r["ci_high"] for r in rows) >= 10
    assert all(math.isclose(r["value"], 1.1 * r["value_native"], rel_tol=1e-9) for r in rows)
    other = read_index_values(spark, f"{target}/index").where("NOT (index_code = 'IDX-T' AND frequency = 'daily' AND omega_preset = 'uniform')")
    assert other.where("se IS NOT NULL").count() == 0
    assert {r[0] for r in spark.read.parquet(f"{target}/cells").select("basis").distinct().collect()} == {"book", "travel"}


def test_blocked_publication_writes_nothing(spark, published):
    root, w, store, _ = published
    target = work_dir(spark, "blocked")
    with pytest.raises(PublicationBlocked):
        publish(store.withColumn("base_fare", F.col("base_fare") * 1.5), w, METHOD, f"{target}/index", f"{target}/cells", "run-3", 3)
    from pricemill.sources.quotes import path_exists
    assert not path_exists(spark, f"{target}/index")


def test_family_honours_pinned_base_and_link(spark, published):
    root, w, store, _ = published
    pinned = Method(bootstrap_draws=0, base_period="2026-05-04", link_factor=110.0)
    target = work_dir(spark, "linked")
    publish(store, w, pinned, f"{target}/index", f"{target}/cells", "run-4", 4)
    plain = Method(bootstrap_draws=0, base_period="2026-05-04")
    publish(store, w, plain, f"{target}/plain", f"{target}/plain-cells", "run-5", 5)
    daily = "frequency = 'daily' AND basis = 'book' AND omega_preset = 'uniform' AND index_code = 'IDX-A'"
    linked = {r["period"]: r["value"] for r in read_index_values(spark, f"{target}/index").where(daily).collect()}
    native = {r["period"]: r["value"] for r in read_index_values(spark, f"{target}/plain").where(daily).collect()}
    own = {r["period"]: r["value"] for r in read_index_values(spark, f"{root}/index").where(daily).collect()}
    assert linked and set(linked) == set(native)
    assert all(math.isclose(linked[p], native[p] * 1.1, rel_tol=1e-9) for p in linked)
    assert any(not math.isclose(native[p], own[p], rel_tol=1e-6) for p in native)


def test_daily_batches_look_back_into_the_store(spark):
    root = work_dir(spark, "daily")
    book = ChargeBook(spark.createDataFrame([("DEL", 129.0, 236.0, date(2020, 1, 1), None)], CHARGES),
                      spark.createDataFrame([("economy", 0.05, date(2020, 1, 1), None)], TAXES), spark.createDataFrame([], "route string"), fee=299.0)
    whole = raw(spark, 5)
    ingest(whole.where("collected_date < DATE'2026-05-05'"), book, f"{root}/store")
    # One fare line doubles on the fifth day, which comes alone.
    jump = (F.col("flight_number") == "0") & (F.col("fare_family") == "A") & (F.col("apw_days") == 7) & (F.col("route") == "DEL-BOM")
    ingest(whole.where("collected_date = DATE'2026-05-05'").withColumn("total_fare", F.when(jump, F.col("total_fare") * 1.6).otherwise(F.col("total_fare"))), book, f"{root}/store")
    last = spark.read.parquet(f"{root}/store").where("collected_date = DATE'2026-05-05'")
    hit = {r["flight_number"] + r["fare_family"] for r in last.where("quality_flag IN ('LONGITUDINAL_JUMP', 'OUTLIER_CELL') AND apw_days = 7 AND route = 'DEL-BOM'").collect()}
    assert "0A" in hit


def test_flags_by_day_with_a_late_row_are_those_at_once(spark):
    root = work_dir(spark, "late")
    book = ChargeBook(spark.createDataFrame([("DEL", 129.0, 236.0, date(2020, 1, 1), None)], CHARGES),
                      spark.createDataFrame([("economy", 0.05, date(2020, 1, 1), None)], TAXES), spark.createDataFrame([], "route string"), fee=299.0)
    late = (date(2026, 5, 3), date(2026, 5, 10), "DEL-BOM", "6E", 7, "99", "A", "economy", 0, "INR", 5200.0, "DEL", "BOM", False, "s")
    whole = raw(spark, 8).union(spark.createDataFrame([late], COLS))
    ingest(whole, book, f"{root}/once")
    new = (F.col("collected_date") == F.lit(date(2026, 5, 8))) | (F.col("flight_number") == "99")
    ingest(whole.where(~new), book, f"{root}/store")
    for _ in range(2):  # the second time nothing is new
        ingest(whole.where(new), book, f"{root}/store")
    key = ["collected_date", "route", "apw_days", "flight_number", "fare_family", "quality_flag"]
    once, by_day = (sorted(tuple(r) for r in spark.read.parquet(f"{root}/{s}").where(new).select(*key).na.fill("").collect()) for s in ("once", "store"))
    assert once == by_day and sum(r[-1] == "LONGITUDINAL_JUMP" for r in once) > 2
