"""How often the plans of heavy queries read their facts."""
import math
import random
from datetime import date, timedelta

import pytest
from panels import COLS

from pricemill.operators import cleaning as cl
from pricemill.operators import elasticity as els
from pricemill.operators import ladder


def relations(df, column):
    """Scans of tables that hold ``column``, as the optimized plan has them."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return sum("Relation" in line and f"{column}#" in line for line in plan.split("\n"))


@pytest.fixture(scope="module")
def fact(spark, tmp_path_factory):
    """A stored fact of priced rows, with the columns that cleaning reads."""
    rnd = random.Random(1)
    rows = [(date(2026, 1, 1) + timedelta(days=d), date(2026, 1, 1) + timedelta(days=d + a), r, "C", a, str(f), "Y", "economy", 0, 5000 * math.exp(rnd.gauss(0, 0.1)), "ACCEPTED")
            for d in range(8) for r in ("R1", "R2") for a in (1, 7, 15) for f in range(5)]
    path = str(tmp_path_factory.mktemp("fact"))
    quotes = spark.createDataFrame(rows, COLS)
    quotes.selectExpr("*", "price AS total_fare", "price AS price_T", "'INR' AS currency", "0.0 AS convenience_fee", "false AS is_sold_out").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def test_an_elasticity_reads_the_fact_once(fact):
    """The fact is folded into a written design first; what follows, however many branches it has, reads that."""
    observed = els.observations(fact)
    assert relations(observed, "flight_number") == 1
    for fit in (els.fit(observed), els.fit(observed, by=["route"], effects=("carrier", "dow"))):
        assert relations(fit, "price") == 0 and relations(fit, "total_fare") == 0 and fit.count() >= 1


def test_cleaning_reads_the_gated_rows_three_times_at_most(fact):
    """Gated rows are read for their distinct values and for their daily prices, both written, and then for the labels."""
    out = cl.clean(fact)
    assert relations(out, "gate_reason") == 1 and out.count() == fact.count()


def test_outliers_read_the_fact_twice_at_most(fact):
    """Quartiles, median and MAD come from one written table of distinct values."""
    flagged = cl.flag_outliers(cl.validity_gates(fact))
    assert relations(flagged, "price_T") <= 2 and flagged.where("tukey_hit").count() <= fact.count()


def test_a_ladder_reads_the_fact_once(fact):
    assert relations(ladder.fare_ladder(fact, max_components=2), "price") == 0
