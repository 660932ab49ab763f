"""Incremental publication: the index as a view that each batch maintains.

Three stored tables stand between the quotes and the series, each partitioned by period:

* ``products`` — sum and number of log prices of every product and period. Sums merge, so a batch adds its own.
* ``levels`` — the elementary levels of every cell and period, which need the period's products and those of the base period.
* ``index`` — the published series, upserted.

A batch of one day reads that day's quotes, that period's products and the base period's; availability, smoothing and
the weighted stages run over the levels of all periods, a table of cells, not of quotes. The base period is pinned. Rows
that come late for it change every level, so all are made anew from the products then.

A batch may be replayed at any point: quotes are inserted or ignored, the product commit remembers the last batch of
each run, and levels and index follow from the products.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import aggregate, elementary, prepare
from ..params import Method
from ..schemas import PRODUCT
from ..session import materialise
from ..sources import snapshots
from ..sources.index_store import write_index_values
from ..sources.quotes import new_quotes, path_exists
from .index import Weights

PERIOD = ["period"]


def folded(quotes: DataFrame, basis: str) -> DataFrame:
    """The mergeable state of publishable quotes: ``s`` and ``n`` by product and period."""
    whole = F.lit(True)
    for c in PRODUCT:
        whole = whole & F.col(c).isNotNull()
    kept = prepare.with_period(prepare.publishable(quotes), basis).where(whole & F.col("period").isNotNull())
    return kept.groupBy(*PRODUCT, "period").agg(F.sum(F.ln("price")).alias("s"), F.count(F.lit(1)).alias("n"))


def _added(new: DataFrame, old: DataFrame | None) -> DataFrame:
    both = new if old is None else old.unionByName(new)
    return both.groupBy(*PRODUCT, "period").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))


def _replaced(new: DataFrame, old: DataFrame | None) -> DataFrame:
    return new


def unseen(batch: DataFrame, store: str) -> DataFrame:
    """Rows of a batch that the quote store doesn't hold; only the batch's days of the store are read."""
    if not path_exists(batch.sparkSession, store):
        return new_quotes(batch, None)
    days = [r["collected_date"] for r in batch.select("collected_date").distinct().collect()]
    held = batch.sparkSession.read.parquet(store).where(F.col("collected_date").isin(days) | (F.col("collected_date").isNull() & F.lit(None in days)))
    return new_quotes(batch, held)


def products_of(spark: SparkSession, path: str, periods: list, at: snapshots.Snapshot | None = None) -> DataFrame:
    """Prepared products (lp, price, n_sources) of the given periods; no other partition is opened."""
    names = snapshots.partition_names(spark, PERIOD, [(p,) for p in periods])
    found = snapshots.read(spark, path, at, names)
    return found.select(*PRODUCT, "period", (F.col("s") / F.col("n")).alias("lp"), F.col("n").alias("n_sources")).withColumn("price", F.exp("lp"))


def levels_of(spark: SparkSession, path: str, periods: list, base: str) -> DataFrame:
    """Cell levels of the given periods on the pinned base."""
    day = F.lit(base).cast("date")
    based = elementary.attach_base(products_of(spark, path, [*periods, base]), day)
    wanted = F.col("period").isin(periods)
    levels = elementary.cell_levels(based)
    return levels if base in map(str, periods) else levels.where(wanted)


def headline(levels: DataFrame, weights: Weights, method: Method) -> DataFrame:
    cells = aggregate.smooth(elementary.with_availability(levels, n_min=method.n_min, adjust=method.availability_adjustment),
                             window=method.dow_window if method.smoothing else 1)
    omega = weights.omega.where(F.col("omega_preset") == method.omega_preset)
    head = aggregate.lead_stage(aggregate.route_stage(aggregate.carrier_stage(cells, weights.carriers), weights.routes), omega)
    return head if method.link_factor is None else aggregate.link(head, method.link_factor)


def apply(batch: DataFrame, root: str, weights: Weights, method: Method, mark: tuple[str, int], index_code: str = "IDX-T") -> list:
    """Bring quotes, products, levels and index under ``root`` up to date with a batch; returns the periods that it touched.

    ``mark`` is (run, number of the batch); numbers of a run rise.
    """
    if method.base_period is None:
        raise ValueError("incremental publication needs a pinned base period")
    spark = batch.sparkSession
    store, products, levels = f"{root}/quotes", f"{root}/products", f"{root}/levels"
    run, number = mark
    batch = materialise(batch, "batch")
    fresh = materialise(unseen(batch, store), "unseen")
    state = materialise(folded(batch, method.basis).select("period").distinct(), "touched")
    periods = [r["period"] for r in state.collect()]  # a row per period of the batch
    done = snapshots.current(spark, products).notes.get(run)
    if done is None or done < number:
        snapshots.merge(folded(fresh, method.basis), products, PERIOD, _added, (run, number))
    fresh.repartition("collected_date", "route", "carrier").write.mode("append").partitionBy("collected_date").parquet(store)
    if not periods:
        return periods
    held = snapshots.current(spark, products)
    if method.base_period in map(str, periods):
        periods = [name.split("=", 1)[1] for name in held.folders]
    snapshots.merge(levels_of(spark, products, periods, method.base_period), levels, PERIOD, _replaced)
    rows = headline(snapshots.read(spark, levels), weights, method).select("period", "omega_preset", "value", "n_matched", "coverage_pct").withColumns({
        "index_code": F.lit(index_code), "frequency": F.lit("daily"), "basis": F.lit(method.basis), "method_version": F.lit(method.method_version),
        "weights_version": F.lit(weights.version), "computed_at": F.lit(number).cast("long")})
    write_index_values(rows, f"{root}/index")
    return periods


def tidy(spark: SparkSession, root: str, keep: int = 1) -> None:
    """Delete what the newest ``keep`` states of products, levels and index don't need."""
    for name in ("products", "levels", "index"):
        snapshots.retire(spark, f"{root}/{name}", keep)
