"""What is moved as tables grow: small sides known when a query is planned, facts shuffled as often as they must be."""
from datetime import date

import pytest
from pyspark.sql import functions as F

from pricemill.catalog import QUERIES, stage_zero
from pricemill.functions.quantiles import _in_stretches, present_values
from pricemill.operators import charges as ch
from pricemill.operators import cleaning as cl
from pricemill.operators import observations as ob
from pricemill.operators import prepare
from pricemill.schemas import COMPONENTS
from pricemill.sources import retail as R


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def raw(spark):
    return spark.range(200).select(
        F.lit("ASIA").alias("route"), F.lit("ASIA").alias("origin_iata"), F.lit("A").alias("carrier"), F.lit(7).alias("apw_days"), F.lit("1").alias("flight_number"),
        F.lit("Y").alias("fare_family"), F.lit("economy").alias("cabin"), F.lit(0).alias("stops"), F.lit(date(1997, 1, 1)).alias("collected_date"),
        F.lit(date(1997, 2, 1)).alias("departure_date"), F.lit("INR").alias("currency"), F.lit(False).alias("is_sold_out"), (5000.0 + F.col("id")).alias("total_fare"))


def test_literal_dimensions_move_no_fact_row(spark, raw):
    split = ch.decompose(raw, R.charges(spark), R.taxes(spark), R.rcs_routes(spark), fee=R.CONVENIENCE_FEE, levy=R.RCS_LEVY)
    gated = cl.validity_gates(split, R.distances(spark))
    assert "SortMergeJoin" not in plan(gated) and gated.where("udf = 91.0 AND gate_reason = ''").count() == 200


def test_outliers_and_jumps_move_no_fact_row(spark, raw):
    split = ch.decompose(raw, R.charges(spark), R.taxes(spark), R.rcs_routes(spark), fee=R.CONVENIENCE_FEE, levy=R.RCS_LEVY)
    out = cl.clean(split, R.distances(spark))
    assert "SortMergeJoin" not in plan(out) and "Exchange hashpartitioning" not in plan(out) and out.count() == 200


def test_lines_are_shuffled_by_order_and_by_part_only(spark, tmp_path):
    rows = {
        "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                     "l_returnflag string, l_linestatus string", [(1, 1, 5, 1, 2.0, 10.0, 0.0, 0.0, "A", "O"), (1, 9, 5, 2, 2.0, 10.0, 0.0, 0.0, "A", "O"), (None, 1, 5, 3, 2.0, 10.0, 0.0, 0.0, "A", "O")]),
        "orders": ("o_orderkey long, o_custkey long, o_orderdate timestamp_ntz", [(1, 1, None), (1, 1, None), (2, 7, None)]),
        "customer": ("c_custkey long, c_nationkey long", [(1, 1)]), "nation": ("n_nationkey long, n_regionkey long", [(1, 1)]),
        "region": ("r_regionkey long, r_name string", [(1, "ASIA")]), "part": ("p_partkey long, p_type string", [(1, "T"), (1, "U")])}
    for name, (shape, some) in rows.items():
        spark.createDataFrame(some, shape).write.parquet(f"{tmp_path}/{name}.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        quotes = R.retail_quotes(spark, str(tmp_path))
        shuffled = [x for x in plan(quotes).split("\n") if "Exchange hashpartitioning(l_" in x or "Exchange hashpartitioning(o_custkey" in x]
        assert [x.split("hashpartitioning(")[1].split("#")[0] for x in shuffled] in (["l_partkey", "l_orderkey", "o_custkey"], ["l_orderkey", "l_partkey", "o_custkey"])
        below = plan(quotes).split("Exchange hashpartitioning(o_custkey")[1]
        assert "l_orderkey" not in below.split("FileScan")[1]
        assert quotes.count() == 4 and quotes.where("route = 'ASIA' AND collected_date IS NULL AND flight_number = '2'").count() == 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_rows_grouped_by_order_are_not_shuffled_again(spark, tmp_path):
    rows = {"lineitem": ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                         "l_returnflag string, l_linestatus string", [(1, 1, 5, 1, 2.0, 10.0, 0.0, 0.0, "A", "O"), (1, 1, 5, 1, 2.0, 10.0, 0.0, 0.0, "A", "O")]),
            "orders": ("o_orderkey long, o_custkey long, o_orderdate timestamp_ntz", [(1, 1, None)]), "customer": ("c_custkey long, c_nationkey long", [(1, 1)]),
            "nation": ("n_nationkey long, n_regionkey long", [(1, 1)]), "region": ("r_regionkey long, r_name string", [(1, "ASIA")]),
            "part": ("p_partkey long, p_type string", [(1, "T")])}
    for name, (shape, some) in rows.items():
        spark.createDataFrame(some, shape).write.parquet(f"{tmp_path}/{name}.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        distinct = R.retail_quotes(spark, str(tmp_path)).select("order_id", "line_number", "price", "route").distinct()
        assert "Exchange hashpartitioning(order_id" not in plan(distinct) and distinct.count() == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_quotes_read_once_are_not_stored_and_stored_ones_are_narrow(spark, monkeypatch):
    stored = []

    def written(df, purpose):
        stored.append(purpose)
        return df

    shape = "route string, carrier string, disposition string, price_T double, fence_low double, total_fare double, " + ", ".join(
        f"{c} string" for c in ("apw_days", "flight_number", "fare_family", "cabin", "stops", "collected_date", "departure_date", "source", "quality_flag")) + ", " + ", ".join(
        f"{c} double" for c in COMPONENTS)
    one = spark.createDataFrame([], shape)
    monkeypatch.setattr(stage_zero, "materialise", written)
    monkeypatch.setattr(stage_zero, "cleaned", lambda spark, sf: one)
    QUERIES["A13_cross_source_spread"](spark, "")
    assert stored == []
    assert "fence_low" not in stage_zero.stored_quotes(spark, "").columns and stored == ["clean-quotes"]


def test_quantiles_move_only_values_near_a_wanted_rank(spark):
    values = present_values(spark.range(20000).withColumn("g", F.lit("hot")), ["g"], F.col("id").cast("double")).cache()
    assert _in_stretches(values, ["g"], {"med": 0.5}, "n_values").count() < 2000


def test_latest_fares_move_no_fact_row(spark):
    seen = spark.range(100).select((F.col("id") % 2).alias("k"), F.col("id").alias("collected_at"))
    latest = ob.latest_fares(seen, ["k"])
    assert "SortMergeJoin" not in plan(latest) and sorted(r["collected_at"] for r in latest.collect()) == [98, 99]


def test_variants_fold_before_they_are_stacked(spark, raw):
    priced = raw.selectExpr("*", "total_fare AS price_B", "-1.0 AS price_T", "IF(total_fare > 5100, total_fare, NULL) AS price_A")
    folded = prepare.fold_variants(priced)
    assert folded.count() == 1
    got = {(r["basis"], r["variant"]): r for r in prepare.collapse_variants(prepare.both_bases(folded)).collect()}
    assert sorted(got) == [("book", "A"), ("book", "B"), ("travel", "A"), ("travel", "B")]
    assert got["book", "B"]["n_sources"] == 200 and got["travel", "A"]["n_sources"] == 99 and got["book", "B"]["period"] == date(1997, 1, 1)
