"""Commit-log tables and incremental publication."""
import math
import random
from datetime import date, timedelta

import pytest
from panels import weights
from pyspark.sql import functions as F

from pricemill.params import Method
from pricemill.plans import incremental
from pricemill.plans.index import compute
from pricemill.session import work_dir
from pricemill.sources import index_store, snapshots

KEY = ["series", "day"]


def rows(spark, series, days, value):
    return spark.createDataFrame([(s, d, value) for s in series for d in days], "series string, day int, value double")


def latest(new, old):
    return index_store.upserted(new.withColumn("at", F.lit(2)), None if old is None else old.withColumn("at", F.lit(1)), "at", KEY).drop("at")


def held(spark, path, **at):
    return sorted(tuple(r) for r in snapshots.read(spark, path, **at).select("series", "day", "value").collect())


def test_a_merge_rewrites_touched_partitions_only(spark):
    path = work_dir(spark, "snap")
    snapshots.merge(rows(spark, ["a", "b=/ %", None], [1, 2], 1.0), path, ["series"], latest)
    before = snapshots.current(spark, path)
    snapshots.merge(rows(spark, ["a"], [2, 3], 5.0), path, ["series"], latest)
    after = snapshots.current(spark, path)
    assert after.version == 2 and [n for n in after.folders if after.folders[n] != before.folders.get(n)] == ["series=a"]
    want = [("a", 1, 1.0), ("a", 2, 5.0), ("a", 3, 5.0), ("b=/ %", 1, 1.0), ("b=/ %", 2, 1.0)]
    assert sorted(tuple(r) for r in snapshots.read(spark, path).where("series is not null").collect()) == want
    assert snapshots.read(spark, path).where("series is null").count() == 2
    # The old snapshot is still there, until it is retired.
    assert snapshots.read(spark, path, before).where("series = 'a'").agg(F.sum("value")).first()[0] == 2.0
    assert snapshots.retire(spark, path) == 1
    assert snapshots.read(spark, path).count() == 7
    with pytest.raises(Exception):
        snapshots.read(spark, path, before).collect()


def test_a_failed_or_half_written_commit_is_not_seen(spark):
    path = work_dir(spark, "snap")
    snapshots.merge(rows(spark, ["a"], [1], 1.0), path, ["series"], latest)

    def broken(new, old):
        return new.withColumn("value", F.raise_error(F.lit("no")).cast("double"))

    with pytest.raises(Exception):
        snapshots.merge(rows(spark, ["a"], [1], 9.0), path, ["series"], broken)
    assert held(spark, path) == [("a", 1, 1.0)]
    fs, at = snapshots._fs(spark, f"{path}/_commits/{2:012d}")
    stream = fs.create(at, False)
    stream.write(bytearray('{"folders": {"ser', "utf-8"))
    stream.close()
    assert held(spark, path) == [("a", 1, 1.0)]
    assert snapshots.merge(rows(spark, ["a"], [1], 3.0), path, ["series"], latest) == 3
    assert held(spark, path) == [("a", 1, 3.0)]


def test_a_writer_that_comes_second_starts_again(spark):
    path = work_dir(spark, "snap")
    snapshots.merge(rows(spark, ["a"], [1], 1.0), path, ["series"], latest)
    raced = []

    def slow(new, old):
        if not raced:  # another writer commits while this one works
            raced.append(snapshots.merge(rows(spark, ["a"], [2], 2.0), path, ["series"], latest))
        return latest(new, old)

    assert snapshots.merge(rows(spark, ["a"], [3], 3.0), path, ["series"], slow) == 3 and raced == [2]
    assert held(spark, path) == [("a", 1, 1.0), ("a", 2, 2.0), ("a", 3, 3.0)]


def test_reading_some_partitions_opens_no_others(spark):
    path = work_dir(spark, "snap")
    snapshots.merge(rows(spark, ["a", "b", "c"], [1], 1.0), path, ["series"], latest)
    some = snapshots.read(spark, path, names=snapshots.partition_names(spark, ["series"], [("b",), ("absent",)]))
    assert [r["series"] for r in some.collect()] == ["b"] and all("series=b" in f for f in some.inputFiles())


BASE = date(2026, 5, 1)
METHOD = Method(bootstrap_draws=0, base_period="2026-05-01", n_min=2)


def quotes(spark, days, seed=3):
    rnd = random.Random(seed)
    out = []
    for d in range(days):
        for route in ("DEL-BOM", "DEL-BLR"):
            for apw in (1, 7, 15):
                for flight in range(4):
                    for family in "AB"[:1 + (d + flight) % 2]:
                        for source in ("s", "t"):
                            day = BASE + timedelta(days=d)
                            out.append((day, day + timedelta(days=apw), route, "6E", apw, str(flight), family, "economy", 0, source, 4000 * math.exp(rnd.gauss(0.02 * d, 0.1)),
                                        "EXCLUDED" if rnd.random() < 0.05 else "ACCEPTED"))
    return spark.createDataFrame(out, "collected_date date, departure_date date, route string, carrier string, apw_days int, flight_number string, fare_family string, "
                                      "cabin string, stops int, source string, price double, disposition string")


def published(spark, root):
    return {r["period"]: r["value"] for r in index_store.read_index_values(spark, f"{root}/index").collect()}


def full(df, w, method=METHOD):
    return {r["period"]: r["value"] for r in compute(df, w, method).headline.collect()}


def close(a, b):
    return set(a) == set(b) and all(math.isclose(a[k], b[k], rel_tol=1e-9) for k in a)


@pytest.mark.parametrize("basis", ["book", "travel"])
def test_maintained_index_equals_a_recompute(spark, basis):
    root, w, whole = work_dir(spark, "view"), weights(spark, {"DEL-BOM": 0.6, "DEL-BLR": 0.4}), quotes(spark, 7)
    method = Method(bootstrap_draws=0, base_period="2026-05-02" if basis == "travel" else "2026-05-01", n_min=2, basis=basis)
    late = (F.col("flight_number") == "3") & (F.col("route") == "DEL-BLR") & (F.col("collected_date") <= "2026-05-04")
    parts = [whole.where("collected_date <= DATE'2026-05-03'").where(~late), whole.where("collected_date = DATE'2026-05-04'").where(~late),
             whole.where("collected_date > DATE'2026-05-04'"), whole.where(late)]  # the last come late, for the base period too
    for i, part in enumerate(parts):
        incremental.apply(part, root, w, method, ("r", i))
    assert close(published(spark, root), full(whole, w, method))
    before = published(spark, root)
    incremental.apply(parts[1], root, w, method, ("r", 3))  # a replay
    incremental.apply(parts[1], root, w, method, ("other", 0))  # the same rows in another run
    assert close(published(spark, root), before)


def test_a_batch_of_one_day_reads_one_day(spark):
    root, w, whole = work_dir(spark, "view"), weights(spark, {"DEL-BOM": 1.0}), quotes(spark, 5)
    incremental.apply(whole.where("collected_date < DATE'2026-05-05'"), root, w, METHOD, ("r", 0))
    day = whole.where("collected_date = DATE'2026-05-05'")
    assert incremental.apply(day, root, w, METHOD, ("r", 1)) == [date(2026, 5, 5)]
    at = snapshots.current(spark, f"{root}/products")
    names = {n: f for n, f in at.folders.items() if f.startswith("commit=2-")}
    assert set(names) == {"period=2026-05-05"}
    opened = incremental.products_of(spark, f"{root}/products", [date(2026, 5, 5), METHOD.base_period]).inputFiles()
    assert opened and all("period=2026-05-05" in f or "period=2026-05-01" in f for f in opened)
    changed = {n for n, f in snapshots.current(spark, f"{root}/levels").folders.items() if f.startswith("commit=2-")}
    assert changed == {"period=2026-05-05"}
    plan = incremental.unseen(day, f"{root}/quotes")._jdf.queryExecution().executedPlan().toString()
    assert any("PartitionFilters: [" in line and ("2026-05-05" in line or "20578" in line) for line in plan.split("\n"))  # days since 1970
    incremental.tidy(spark, root)
    assert close(published(spark, root), full(whole, w))


def test_a_crash_between_the_tables_is_mended_by_the_replay(spark, monkeypatch):
    root, w, whole = work_dir(spark, "view"), weights(spark, {"DEL-BOM": 1.0}), quotes(spark, 4)
    incremental.apply(whole.where("collected_date < DATE'2026-05-04'"), root, w, METHOD, ("r", 0))
    last = whole.where("collected_date = DATE'2026-05-04'")
    for broken in ("levels_of", "headline"):
        with monkeypatch.context() as m:
            m.setattr(incremental, broken, lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
            with pytest.raises(RuntimeError):
                incremental.apply(last, root, w, METHOD, ("r", 1))
    incremental.apply(last, root, w, METHOD, ("r", 1))
    assert close(published(spark, root), full(whole, w))
