"""The index computation from prepared quotes to headline, as one lazy plan."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..operators import aggregate, bootstrap, elementary, prepare
from ..params import Method
from ..session import materialise


@dataclass(frozen=True)
class Weights:
    """Injected weight tables; nothing in the engine derives them."""
    routes: DataFrame      # route, w
    carriers: DataFrame    # route, carrier, phi
    omega: DataFrame       # omega_preset, apw_days, omega
    version: str = "v1"


@dataclass(frozen=True)
class IndexFrames:
    headline: DataFrame
    by_apw: DataFrame
    by_route: DataFrame
    cells: DataFrame
    blocks: DataFrame | None


def relatives(quotes: DataFrame, method: Method) -> DataFrame:
    """Publishable quotes of one basis, collapsed by product, with their log relatives."""
    prepare.require_columns(quotes)
    prepared = materialise(prepare.collapse_sources(prepare.with_period(prepare.publishable(quotes), method.basis)), "products")  # read by base periods, base prices and rows
    return elementary.attach_base(*_based(prepared, method))


def compute(quotes: DataFrame, weights: Weights, method: Method = Method()) -> IndexFrames:
    """Prepare, build cells, smooth, aggregate three times, bootstrap, link."""
    rel = relatives(quotes, method)
    blocks = elementary.flight_blocks(rel)
    raw = elementary.cells(rel, n_min=method.n_min, adjust=method.availability_adjustment)
    cells = aggregate.smooth(raw, window=method.dow_window if method.smoothing else 1)
    omega = weights.omega.where(F.col("omega_preset") == method.omega_preset)
    if method.bootstrap_draws > 0:
        # Both feed several branches below and are tiny beside the quotes.
        blocks, cells = materialise(blocks, "blocks"), materialise(cells, "cells")

    by_route = aggregate.carrier_stage(cells, weights.carriers)
    by_apw = aggregate.route_stage(by_route, weights.routes)
    headline = aggregate.lead_stage(by_apw, omega)
    if method.bootstrap_draws > 0:
        eff = aggregate.effective_weights(cells, weights.carriers, weights.routes, omega)
        ci = bootstrap.headline_interval(blocks, cells, eff, method.bootstrap_draws, method.bootstrap_seed,
                                         method.ci_level, method.availability_adjustment)
        raw_route = aggregate.carrier_stage(cells, weights.carriers, value="adjusted_raw")
        raw_head = aggregate.lead_stage(aggregate.route_stage(raw_route, weights.routes), omega)
        headline = bootstrap.transport(ci, headline, raw_head)
    else:
        for c in ("se", "ci_low", "ci_high", "value_unsmoothed"):
            headline = headline.withColumn(c, F.lit(None).cast("double"))
    headline = headline.join(aggregate.headline_counts(cells), "period", "left")
    headline = headline.withColumn("value_native", F.col("value"))
    if method.link_factor is not None:
        headline = aggregate.link(headline, method.link_factor, ["value", "se", "ci_low", "ci_high", "value_unsmoothed"])
        by_apw = aggregate.link(by_apw, method.link_factor).drop("value_native")
        by_route = aggregate.link(by_route, method.link_factor).drop("value_native")
        cells = aggregate.link(cells, method.link_factor, ["adjusted", "adjusted_raw"]).drop("value_native")
    return IndexFrames(headline, by_apw, by_route, cells, blocks)


def fan_out(priced: DataFrame, weights: Weights, method: Method = Method(), variants: Sequence[str] = ("B", "T", "A"),
            bases: Sequence[str] = ("book", "travel")) -> DataFrame:
    """Headlines of every variant x basis x weight preset in one pass, on the base and link of ``method``."""
    return fan_out_frames(priced, weights, method, variants, bases).headline


def fan_out_frames(priced: DataFrame, weights: Weights, method: Method = Method(), variants: Sequence[str] = ("B", "T", "A"),
                   bases: Sequence[str] = ("book", "travel")) -> IndexFrames:
    """``fan_out`` with its windows, routes and cells, all keyed by variant and basis; without blocks.

    The quotes are folded by both dates with one column per variant; only what is folded is stacked by basis, collapsed and stacked
    by variant. These products are written: base periods, base prices, cells and stages all read them. Cells are computed once per (variant, basis), and the presets
    only multiply the last, small stage.
    """
    by = ["variant", "basis"]
    kept = priced.where(F.col("disposition").isin("ACCEPTED", "WINSORISED"))
    folded = prepare.fold_variants(kept, variants)
    products = materialise(prepare.collapse_variants(prepare.both_bases(folded, bases), variants), "products")
    rel = elementary.attach_base(*_based(products, method, by), by)
    cells = aggregate.smooth(elementary.cells(rel, by, method.n_min, method.availability_adjustment), by,
                             method.dow_window if method.smoothing else 1)
    by_route = aggregate.carrier_stage(cells, weights.carriers, by)
    by_apw = aggregate.route_stage(by_route, weights.routes, by)
    headline = aggregate.lead_stage(by_apw, weights.omega, by)
    if method.link_factor is not None:
        headline, by_apw, by_route = (aggregate.link(df, method.link_factor) for df in (headline, by_apw, by_route))
    return IndexFrames(headline, by_apw, by_route, cells, None)


def _based(prepared: DataFrame, method: Method, by: Sequence[str] = ()) -> tuple:
    """The prepared products and their base period: the pinned one, or each group's own."""
    if not method.base_period:
        return prepared, materialise(prepare.base_periods(prepared, by) if by else prepare.base_periods(prepared), "base-periods")
    prepare.pinned_base(prepared, method.base_period)
    return prepared, F.lit(method.base_period).cast("date")


def sensitivity(headlines: DataFrame) -> DataFrame:
    """Spread of the headline across weight presets, per variant, basis and period."""
    return (
        headlines.groupBy("variant", "basis", "period")
        .agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count(F.lit(1)).alias("n_presets"))
        .withColumn("spread_pct", 100 * (F.col("high") - F.col("low")) / F.col("low"))
    )
