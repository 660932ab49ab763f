from datetime import date

import pytest
from pyspark.sql import functions as F

from pricemill.operators import charges as ch
from pricemill.operators import cleaning as cl
from pricemill.operators import prepare
from pricemill.operators import quality as q
from pricemill.schemas import CHARGES, TAXES

COLS = ("collected_date date, departure_date date, route string, carrier string, apw_days int, flight_number string, fare_family string, "
        "cabin string, stops int, currency string, total_fare double, origin_iata string, dest_iata string, is_sold_out boolean, source string")
DAY = date(2026, 3, 1)


def batch(spark, change=None, day=DAY):
    rows = []
    for i in range(40):
        row = dict(collected_date=day, departure_date=date(2026, 3, 8), route="DEL-BOM", carrier="6E", apw_days=7, flight_number=str(i // 4),
                   fare_family="ABCD"[i % 4], cabin="economy", stops=0, currency="INR", total_fare=5000 * (1 + 0.02 * (i % 5)), origin_iata="DEL",
                   dest_iata="BOM", is_sold_out=False, source="s")
        row.update((change or {}).get(i, {}))
        rows.append(tuple(row.values()))
    return spark.createDataFrame(rows, COLS)


def split(spark, df, fee=299.0, levy=0.0):
    charges = spark.createDataFrame([("DEL", 129.0, 236.0, date(2020, 1, 1), date(2026, 4, 1)), ("DEL", 500.0, 236.0, date(2026, 4, 1), None)], CHARGES)
    taxes = spark.createDataFrame([("economy", 0.05, date(2020, 1, 1), None)], TAXES)
    return ch.decompose(df, charges, taxes, spark.createDataFrame([("DEL-BOM",)], "route string"), fee=fee, levy=levy)


def cleaned(spark, change=None):
    return cl.clean(split(spark, batch(spark, change)))


def test_components_resum(spark):
    r = split(spark, batch(spark), levy=50.0).agg(F.max("decomp_residual"), F.avg(F.col("gst") / F.col("base_fare"))).first()
    assert r[0] < 1e-6 and r[1] == pytest.approx(0.05)


def test_variant_order(spark):
    bad = split(spark, batch(spark)).where(~((F.col("price_B") <= F.col("price_T")) & (F.col("price_T") <= F.col("price_A"))
                                           & (F.abs(F.col("price_A") - F.col("price_T") - 299) < 1e-9)))
    assert bad.isEmpty()
    with pytest.raises(ValueError):
        prepare.variant_price("Z")


@pytest.mark.parametrize("day, udf", [(date(2026, 3, 1), 129.0), (date(2026, 4, 1), 500.0), (date(2026, 5, 1), 500.0), (date(2019, 1, 1), 0.0)])
def test_charges_are_effective_dated(spark, day, udf):
    assert split(spark, batch(spark, day=day)).select("udf").distinct().collect() == [(udf,)]


def test_overlapping_versions_do_not_multiply_rows(spark):
    charges = spark.createDataFrame([("DEL", 1.0, 0.0, date(2020, 1, 1), None), ("DEL", 2.0, 0.0, date(2021, 1, 1), None)], CHARGES)
    out = ch.airport_charges(batch(spark), charges)
    assert out.count() == 40 and out.select("udf").distinct().collect() == [(1.0,)]


def test_gates(spark):
    out = cl.validity_gates(split(spark, batch(spark, {0: {"total_fare": -5.0}, 1: {"currency": "USD"}, 2: {"apw_days": 3}})))
    assert {r["gate_reason"]: r["n"] for r in out.groupBy("gate_reason").agg(F.count("*").alias("n")).collect()} == {
        "": 37, "NONPOSITIVE_FARE": 1, "NON_INR_CURRENCY": 1, "APW_NOT_IN_WINDOW_SET": 1}


def test_extreme_is_pulled_in_and_kept(spark):
    out = cleaned(spark, {0: {"total_fare": 45000.0}})
    rows = out.where("total_fare = 45000").collect()
    assert out.count() == 40 and len(rows) == 1
    assert rows[0]["disposition"] == "WINSORISED" and rows[0]["quality_flag"] == "OUTLIER_CELL" and rows[0]["price_T"] < 45000
    again = prepare.rebuild_variants(out).where("total_fare = 45000").first()
    assert again["price_T"] == pytest.approx(rows[0]["price_T"]) and again["total_fare"] == 45000


def test_sold_out_is_quarantined(spark):
    r = cleaned(spark, {0: {"is_sold_out": True, "total_fare": None}}).where("is_sold_out").first()
    assert (r["disposition"], r["quality_flag"]) == ("QUARANTINED", "SOLD_OUT")


def test_wide_but_legal(spark):
    out = cleaned(spark, {i: {"total_fare": 3000 + 9000 * i / 39} for i in range(40)})
    assert out.where("disposition <> 'ACCEPTED'").isEmpty()


def test_raw_price_bounds_clip_a_far_price(spark):
    change = {i: {"flight_number": "x", "route": "R"} for i in range(6)}
    for i, p in enumerate((4000, 4100, 4200, 4300, 4400, 20000)):
        change[i]["total_fare"] = float(p)
    hit = cl.price_space_flags(batch(spark, change)).where("route = 'R' AND tukey_hit").collect()
    assert [r["total_fare"] for r in hit] == [20000.0]


def names(checks, severity):
    return {r["check_name"] for r in checks.where((F.col("severity") == severity) & ~F.col("passed")).collect()}


def test_contract(spark):
    good = cleaned(spark)
    assert names(q.contract(good), "BLOCK") == set()
    q.enforce(q.contract(good))
    broken = q.contract(good.withColumn("base_fare", F.col("base_fare") * 1.5))
    assert "components_resum_to_total" in names(broken, "BLOCK")
    with pytest.raises(q.PublicationBlocked):
        q.enforce(broken)
    assert "no_duplicate_product_date_source" in names(q.contract(good.unionByName(good.where("flight_number = '1'"))), "BLOCK")
    assert names(q.contract(good.drop("route")), "BLOCK") == {"required_columns_present"}
    assert "batch_non_empty" in names(q.contract(good.where("false")), "BLOCK")
