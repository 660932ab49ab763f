"""Ingest and publication as whole jobs over stored tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, functions as F

from ..operators import aggregate as agg
from ..operators import charges, cleaning, prepare, quality
from ..params import Method
from ..schemas import REQUIRED_QUOTE_COLUMNS
from ..session import materialise
from ..sources.index_store import write_cells, write_index_values
from ..sources.quotes import append_quotes, path_exists
from .index import IndexFrames, Weights, compute, fan_out_frames


@dataclass(frozen=True)
class ChargeBook:
    airports: DataFrame
    taxes: DataFrame
    rcs_routes: DataFrame
    fee: float = 0.0
    levy: float = 0.0


def ingest(raw: DataFrame, book: ChargeBook, store: str, distances: DataFrame | None = None, method: Method = Method()) -> None:
    """Decompose, clean and append a batch of any number of days at once.

    The jump test runs over the stored prices of the batch's cells and the batch, so it finds what it would find had all come
    at once. Only rows of the batch are flagged: a late row changes no stored flag.
    """
    spark = raw.sparkSession
    split = charges.decompose(raw, book.airports, book.taxes, book.rcs_routes, fee=book.fee, levy=book.levy)
    earlier = None
    if path_exists(spark, store):
        earlier = cleaning.stored_prices(spark.read.parquet(store), raw)
    append_quotes(cleaning.clean(split, distances, method.tukey_k, method.hampel_z, method.jump_sigma, method.apw_windows, earlier=earlier), store)


# What a published row holds beside its key; a measure that its series doesn't have is null.
MEASURES = {"value": "double", "value_native": "double", "se": "double", "ci_low": "double", "ci_high": "double", "n_quotes": "long", "n_cells": "long",
            "n_matched": "long", "coverage_pct": "double", "omega_covered": "double"}


def _measures(rows: DataFrame) -> DataFrame:
    native = F.col("value_native") if "value_native" in rows.columns else F.col("value")
    return rows.withColumns({c: (native if c == "value_native" else F.col(c) if c in rows.columns else F.lit(None)).cast(t) for c, t in MEASURES.items()})


def index_rows(headlines: DataFrame, method: Method, weights_version: str, prefix: str = "IDX", detail: DataFrame | None = None) -> DataFrame:
    """Long rows of every frequency for headlines keyed by variant, basis and preset, and of ``detail`` series.

    Periods resting on too little lead-time weight are withheld before any roll-up. Roll-ups have values, matches and coverage only.
    """
    key = ["variant", "basis", "omega_preset"]
    kept = agg.withhold_thin(headlines, method.min_omega_covered)
    columns = [*key, "period", "frequency", *MEASURES]
    out = _measures(kept.withColumn("frequency", F.lit("daily"))).select(*columns)
    for frequency in ("weekly", "monthly"):
        rolled = agg.to_frequency(kept, frequency, key)
        if "value_native" in kept.columns:
            native = agg.to_frequency(kept.withColumn("value", F.col("value_native")), frequency, key).select(*key, "period", F.col("value").alias("value_native"))
            rolled = rolled.join(native, [*key, "period"], "left")
        out = out.unionByName(_measures(rolled.withColumn("frequency", F.lit(frequency))).select(*columns))
    out = out.withColumn("index_code", F.concat(F.lit(f"{prefix}-"), F.col("variant"))).drop("variant")
    if detail is not None:
        out = out.unionByName(detail.select(*out.columns))
    return out.withColumns({"method_version": F.lit(method.method_version), "weights_version": F.lit(weights_version)})


def detail_rows(frames: IndexFrames, method: Method, prefix: str = "IDX") -> DataFrame:
    """Window and route series of the headline variant, daily."""
    key = {"omega_preset": F.lit(method.omega_preset), "frequency": F.lit("daily")}
    code = lambda *parts: F.concat(F.lit(f"{prefix}-"), F.col("variant"), *parts, F.lit(":apw="), F.col("apw_days").cast("string"))
    columns = ["basis", "omega_preset", "period", "frequency", *MEASURES, "index_code"]
    windows = frames.by_apw.where(F.col("variant") == method.variant).withColumns({**key, "index_code": code()})
    routes = frames.by_route.where(F.col("variant") == method.variant).withColumns({**key, "index_code": code(F.lit(":route="), F.col("route"))})
    return _measures(windows).select(*columns).unionByName(_measures(routes).select(*columns))


def intervals(priced: DataFrame, weights: Weights, method: Method, bases: Sequence[str] = ("book", "travel")) -> DataFrame:
    """Bootstrap intervals of the headline variant and preset, by basis and period; other series carry point values only."""
    own = priced.withColumn("price", F.col(prepare.VARIANT_COLUMNS[method.variant]))
    out = None
    for basis in bases:
        found = compute(own, weights, replace(method, basis=basis)).headline.select(
            F.lit(method.variant).alias("variant"), F.lit(basis).alias("basis"), F.lit(method.omega_preset).alias("omega_preset"), "period", "se", "ci_low", "ci_high")
        out = found if out is None else out.unionByName(found)
    return out


def publish(store: DataFrame, weights: Weights, method: Method, index_path: str, cell_path: str, run_id: str, computed_at: int,
            basket: DataFrame | None = None, ledger: DataFrame | None = None, enforce: bool = True) -> DataFrame:
    """Check the stored quotes, compute the index family and upsert it; returns the check table.

    A failed BLOCK check raises before anything is written.
    """
    checks = materialise(quality.contract(store, basket, ledger), "checks")
    if enforce:
        quality.enforce(checks)
    priced = prepare.rebuild_variants(store) if "total_fare" in store.columns else store
    publish_priced(priced, weights, method, index_path, cell_path, run_id, computed_at)
    return checks


def publish_priced(priced: DataFrame, weights: Weights, method: Method, index_path: str, cell_path: str, run_id: str, computed_at: int) -> None:
    """Compute the index family of quotes with variant prices and upsert it: headlines, roll-ups, sub-series, intervals and cells."""
    by = ["variant", "basis", "period"]
    used = [*REQUIRED_QUOTE_COLUMNS, "disposition", *prepare.VARIANT_COLUMNS.values()]
    priced = materialise(priced.select(*used), "priced")  # read by the family and by the interval of each basis
    frames = fan_out_frames(priced, weights, method)
    cells = materialise(frames.cells, "cells")
    headlines = frames.headline.join(agg.headline_counts(cells, by[:2]), by, "left")
    if method.bootstrap_draws > 0:
        headlines = headlines.join(intervals(priced, weights, method), [*by, "omega_preset"], "left")
    headlines = materialise(headlines, "headlines")
    rows = index_rows(headlines, method, weights.version, detail=detail_rows(frames, method))
    write_index_values(rows.withColumns({"run_id": F.lit(run_id), "computed_at": F.lit(computed_at).cast("long")}), index_path)
    own = cells.where(F.col("variant") == method.variant)
    for basis in ("book", "travel"):
        write_cells(own.where(F.col("basis") == basis).drop("variant", "basis"), cell_path, f"IDX-{method.variant}", basis, run_id)
