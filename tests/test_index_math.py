import math
import random
from datetime import date, timedelta

import pytest
from panels import D1, frame, quote, values, weights
from pyspark.sql import functions as F

from pricemill.operators import aggregate as agg
from pricemill.operators import elementary as el
from pricemill.operators import prepare
from pricemill.params import Method
from pricemill.plans.index import compute

NO_CI = dict(bootstrap_draws=0, smoothing=False)
D2 = D1 + timedelta(days=1)
ONE = {"DEL-BOM": 1.0}


def surge(spark):
    rows = [quote(0, flight=f, family=k, price=p) for f in range(6) for k, p in (("SAVER", 4000), ("MID", 6000), ("TOP", 9000))]
    return frame(spark, rows + [quote(1, flight=f, family="TOP", price=9000) for f in range(6)])


def test_closed_buckets_move_only_the_adjusted_index(spark):
    plain = compute(surge(spark), weights(spark, ONE), Method(availability_adjustment=False, **NO_CI)).headline
    assert values(plain)[D2] == pytest.approx(100.0)
    assert values(compute(surge(spark), weights(spark, ONE), Method(**NO_CI)).headline)[D2] > 105


def test_suppressed_weight_goes_to_the_surviving_carrier(spark):
    rows = [quote(d, flight=f, price=5000 * (1.1 if d else 1)) for d in (0, 1) for f in range(8)]
    rows += [quote(d, carrier="AI", flight=f) for d in (0, 1) for f in range(2)]
    w = weights(spark, ONE, [("DEL-BOM", "6E", 0.5), ("DEL-BOM", "AI", 0.5)])
    f = compute(frame(spark, rows), w, Method(**NO_CI))
    assert values(f.headline)[D2] == pytest.approx(110.0)
    assert f.cells.where("suppressed").count() == 2


@pytest.mark.parametrize("a, b, expect", [(0.9, 0.1, 118.0), (0.1, 0.9, 102.0)])
def test_route_weights_are_injected(spark, a, b, expect):
    rows = [quote(d, route=r, flight=f, price=5000 * (1.2 if d and r == "DEL-BOM" else 1))
            for d in (0, 1) for r in ("DEL-BOM", "DEL-BLR") for f in range(6)]
    out = compute(frame(spark, rows), weights(spark, {"DEL-BOM": a, "DEL-BLR": b}), Method(**NO_CI))
    assert values(out.headline)[D2] == pytest.approx(expect)


def test_time_basis_decides_the_period(spark):
    rows = [quote(d, apw=30, flight=f, dep=date(2026, 6, 1)) for d in (0, 1) for f in range(6)]
    book = compute(frame(spark, rows), weights(spark, ONE), Method(**NO_CI)).headline
    travel = compute(frame(spark, rows), weights(spark, ONE), Method(basis="travel", **NO_CI)).headline
    assert sorted(values(book)) == [D1, D2]
    assert sorted(values(travel)) == [date(2026, 6, 1)]


def test_interval_holds_the_value(spark):
    rng = random.Random(7)
    rows = [quote(d, flight=f, family=k, price=5000 * 1.004 ** d * math.exp(rng.gauss(0, 0.02)))
            for d in range(14) for f in range(8) for k in ("A", "B", "C")]
    out = compute(frame(spark, rows), weights(spark, ONE), Method(bootstrap_draws=100, smoothing=False)).headline.collect()
    assert len(out) == 14
    assert all(r["ci_low"] <= r["value"] + 1e-9 and r["value"] <= r["ci_high"] + 1e-9 for r in out)
    # The spread of the draws is that of a mean of eight flights, to Monte Carlo accuracy.
    late = [r["se"] / r["value"] for r in out[1:]]
    assert 0.003 < sum(late) / len(late) < 0.010


def test_excluded_rows_do_not_move_the_index(spark):
    rows = [quote(d, flight=f) for d in (0, 1) for f in range(6)] + [quote(1, flight=99, price=999999, disposition="EXCLUDED")]
    assert values(compute(frame(spark, rows), weights(spark, ONE), Method(**NO_CI)).headline)[D2] == pytest.approx(100.0)


def panel(spark):
    rng = random.Random(1)
    rows = [quote(d, route=r, carrier=c, apw=a, flight=f, family=k, price=4000 * math.exp(rng.gauss(0.01 * d, 0.1)))
            for d in range(6) for r in ("R1", "R2", "R3") for c in ("C1", "C2", "C3") for a in (1, 7, 30) for f in range(6) for k in "XYZ"]
    phi = [(r, c, v) for r in ("R1", "R2", "R3") for c, v in (("C1", 0.6), ("C2", 0.3), ("C3", 0.1))]
    return frame(spark, rows), weights(spark, {"R1": 0.5, "R2": 0.3, "R3": 0.2}, phi, {1: 0.5, 7: 0.3, 30: 0.2})


def test_collapsed_weights_equal_the_stages(spark):
    quotes, w = panel(spark)
    f = compute(quotes, w, Method(**NO_CI))
    eff = agg.effective_weights(f.cells, w.carriers, w.routes, w.omega)
    folded = eff.groupBy("period").agg(F.sum(F.col("weight") * F.col("adjusted")).alias("value"), F.sum("weight").alias("one"))
    staged = values(f.headline)
    for r in folded.collect():
        assert r["one"] == pytest.approx(1.0, abs=1e-12)
        assert r["value"] == pytest.approx(staged[r["period"]], abs=1e-9)


def test_late_route_is_suppressed(spark):
    rows = [quote(d, flight=f) for d in range(10) for f in range(6)]
    rows += [quote(d, route="DEL-BLR", flight=f, price=9000) for d in range(5, 10) for f in range(6)]
    f = compute(frame(spark, rows), weights(spark, {"DEL-BOM": 0.5, "DEL-BLR": 0.5}), Method(**NO_CI))
    assert all(v == pytest.approx(100.0) for v in values(f.headline).values())
    assert f.cells.where("route = 'DEL-BLR' AND NOT suppressed").count() == 0


def ramp(spark):
    return frame(spark, [quote(d, apw=a, flight=f, price=5000 + 100 * a) for d in range(60) for a in (1, 7, 15, 30, 45) for f in range(6)])


def test_travel_base_is_the_first_fully_covered_period(spark):
    travel = compute(ramp(spark), weights(spark, ONE), Method(basis="travel", **NO_CI))
    assert travel.by_apw.select("apw_days").distinct().count() == 5
    assert travel.headline.agg(F.max("omega_covered")).first()[0] == pytest.approx(1.0)
    prepared = prepare.collapse_sources(prepare.with_period(ramp(spark), "book"))
    assert prepare.base_periods(prepared).first()[0] == D1


def test_pinned_base_must_exist(spark):
    assert compute(ramp(spark), weights(spark, ONE), Method(base_period="2026-05-20", **NO_CI)).headline.count() == 60
    with pytest.raises(ValueError):
        compute(ramp(spark), weights(spark, ONE), Method(base_period="1999-01-01", **NO_CI))


def test_linking_moves_levels_and_no_relative(spark):
    rows = [quote(d, flight=f, price=5000 * m) for d, m in enumerate((1.0, 1.1, 0.95)) for f in range(6)]
    out = compute(frame(spark, rows), weights(spark, ONE), Method(link_factor=105.63, **NO_CI)).headline
    for value, native in values(out, "value", "value_native").values():
        assert value == pytest.approx(native * 1.0563)
    for bad in (0, -105.63, float("nan")):
        with pytest.raises(ValueError):
            Method(link_factor=bad)


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="carrier"):
        compute(frame(spark, [quote()]).drop("carrier"), weights(spark, ONE), Method(**NO_CI))


@pytest.mark.parametrize("m, laf, a, expect", [
    (100.0, 150.0, 1.0, 100.0), (100.0, 150.0, 1e-6, 150.0), (100.0, 144.0, 0.5, 120.0), (None, 150.0, 0.5, 150.0), (100.0, None, 0.5, 100.0), (None, None, 0.5, None)])
def test_blend_limits(spark, m, laf, a, expect):
    df = spark.createDataFrame([(m, laf, a)], "m double, l double, a double")
    got = df.select(el.blend(F.col("m"), F.col("l"), F.col("a"))).first()[0]
    assert got is None if expect is None else got == pytest.approx(expect, rel=1e-4)


def test_availability_limits(spark):
    df = spark.createDataFrame([(7, 5), (0, 5), (3, 0)], "n_families long, n_families_ref long")
    got = [r[0] for r in df.select(el.availability_ratio()).collect()]
    assert got[0] == 1 and 0 < got[1] < 1e-3 and got[2] == 1


def test_seven_row_average_removes_a_weekly_cycle(spark):
    rows = [(D1 + timedelta(days=i), "R", "C", 7, 100 * math.exp(0.1 * math.sin(2 * math.pi * i / 7))) for i in range(35)]
    df = spark.createDataFrame(rows, "period date, route string, carrier string, apw_days int, adjusted double")
    inner = [r["adjusted"] for r in agg.smooth(df).orderBy("period").collect()][3:-3]
    assert max(inner) - min(inner) < 1e-9


def test_missing_windows_are_renormalised(spark):
    df = spark.createDataFrame([(D1, 7, 110.0, 5, 100.0), (D1, 30, 120.0, 5, 100.0)],
                               "period date, apw_days int, value double, n_matched long, coverage_pct double")
    omega = weights(spark, ONE).omega
    r = agg.lead_stage(df, omega).first()
    assert r["value"] == pytest.approx(115.0) and r["omega_covered"] == pytest.approx(0.4)


def naive_index(rows, base):
    """Matched geometric mean per cell, straight from the definition."""
    by = {}
    for r in rows:
        by.setdefault((r[0], r[2], r[3], r[4]), []).append(r)
    p0 = {(r[2], r[3], r[4], r[5], r[6]): r[9] for r in rows if r[0] == base}
    out = {}
    for key, group in by.items():
        logs = [math.log(r[9] / p0[k]) for r in group if (k := (r[2], r[3], r[4], r[5], r[6])) in p0]
        out[key] = 100 * math.exp(sum(logs) / len(logs)) if logs else None
    return out


def test_cells_equal_a_naive_loop(spark):
    rng = random.Random(3)
    rows = [quote(d, route=r, carrier=c, apw=a, flight=f, family=k, price=rng.uniform(3000, 9000))
            for d in range(12) for r in ("R1", "R2", "R3") for c in ("C1", "C2") for a in (7, 30) for f in range(5) for k in ("SAVER", "MID", "TOP")
            if not (r == "R1" and d in (4, 5) and k == "SAVER")]
    f = compute(frame(spark, rows), weights(spark, {"R1": 1.0}), Method(**NO_CI))
    want = naive_index(rows, D1)
    got = f.cells.collect()
    assert len(got) == len(want)
    for r in got:
        assert r["matched"] == pytest.approx(want[(r["period"], r["route"], r["carrier"], r["apw_days"])], abs=1e-9)
    assert min(r["availability"] for r in got) == pytest.approx(2 / 3)
