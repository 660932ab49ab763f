"""Connected components as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pricemill.session import materialise


def components(edges: DataFrame, purpose: str = "components") -> DataFrame:
    """``node`` and ``root``, the smallest node it reaches, for every node of ``edges`` (a, b).

    Large and small stars in turn: every node hands its larger neighbours to the smallest node it knows,
    then itself and its smaller neighbours to the smallest of those. The edges become stars around the
    roots in about log rounds. A round is a written table, so nothing is recomputed and the plan stays
    short; the driver only asks whether all edges are stars.
    """
    at = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), purpose)
    while not _stars(at):
        both = at.union(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written, so that the join below meets a plain table and a hub's edges can be split.
        least = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), purpose)
        large = materialise(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v"), purpose)
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(down.select("u", "m"))
        at = materialise(small.distinct(), purpose)
    return at.select(F.col("u").alias("node"), F.col("v").alias("root")).union(at.select("v", "v")).distinct()


def _stars(at: DataFrame) -> bool:
    """Whether every larger end has one edge and is nobody's smaller end."""
    ends = at.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("low")).union(at.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("low").alias("low")).filter("up > 1 or up = 1 and low = 1").isEmpty()
