"""Hash-chained ledger: build, verify, resolve."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ordered import split_lag
from ..functions.scalars import canonical_json
from ..schemas import LEDGER_FIELDS

GENESIS = "0" * 64
SEQ_PER_BUCKET = 100_000


def link_hash(prev: Column, payload: Column) -> Column:
    return F.sha2(F.concat(prev, payload), 256)


def payload(fields: Sequence[str] = LEDGER_FIELDS) -> Column:
    return canonical_json(*fields)


def check_links(ledger: DataFrame, body: Column | None = None, keys: Sequence[str] = (),
                per_bucket: int = SEQ_PER_BUCKET) -> DataFrame:
    """Mark each record whose stored hashes do not continue its predecessor's.

    Given the stored hashes a record depends only on the one before it, so the check runs bucket by
    bucket of the sequence with one carried value per bucket boundary.
    """
    body = payload() if body is None else body
    with_prev = split_lag(ledger, keys, ["seq"], "this_hash", "_before", F.floor(F.col("seq") / per_bucket))
    before = F.coalesce(F.col("_before"), F.lit(GENESIS))
    sound = (F.col("prev_hash") == before) & (F.col("this_hash") == link_hash(before, body))
    return with_prev.withColumn("is_broken", ~F.coalesce(sound, F.lit(False))).drop("_before")


def chain_summary(ledger: DataFrame, body: Column | None = None, keys: Sequence[str] = (),
                  per_bucket: int = SEQ_PER_BUCKET) -> DataFrame:
    bad = F.col("is_broken")
    return check_links(ledger, body, keys, per_bucket).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_records"),
        F.count_if(bad).alias("n_broken"),
        F.min(F.when(bad, F.col("seq"))).alias("first_broken_seq"),
        F.max_by("this_hash", "seq").alias("tip_hash"),
    )


def chain_records(records: DataFrame, segment: Sequence[str], body: Column, order: str = "seq") -> DataFrame:
    """Append prev_hash and this_hash, chaining in ``order`` inside each segment.

    A chain is a serial fold, so one global chain cannot be computed in parallel. ``segment`` must
    bound its rows, such as a source and floor(seq / 1000); segments are then chained independently
    and their tips can be chained in turn.
    """
    segment = list(segment)
    carried = F.struct(F.col(order).alias("_o"), body.alias("_body"), F.struct(*records.columns).alias("_row"))
    folded = records.groupBy(*segment).agg(F.array_sort(F.collect_list(carried), _by_order).alias("_items"))
    hashes = F.aggregate(
        "_items", F.array(F.lit(GENESIS)),
        lambda acc, x: F.concat(acc, F.array(link_hash(F.element_at(acc, -1), x["_body"]))))
    return (
        folded.select("_items", hashes.alias("_h"))
        .select("_h", F.posexplode("_items").alias("_i", "_item"))
        .select("_item._row.*", F.get("_h", F.col("_i")).alias("prev_hash"), F.get("_h", F.col("_i") + 1).alias("this_hash"))
    )


def _by_order(a: Column, b: Column) -> Column:
    return F.when(a["_o"] < b["_o"], -1).when(a["_o"] > b["_o"], 1).otherwise(0)


def behind_number(quotes: DataFrame, ledger: DataFrame, basis: str, period) -> DataFrame:
    """Counts of quotes, routes, sources and ledger records behind the value of one period."""
    from .prepare import with_period
    from .quality import published
    rows = with_period(published(quotes), basis).where(F.col("period") == F.lit(period).cast("date"))
    return rows.agg(
        F.count(F.lit(1)).alias("n_quotes"), F.countDistinct("route").alias("n_routes"),
        F.countDistinct("source").alias("n_sources"), F.countDistinct("provenance_id").alias("n_provenance"))


def behind_every_number(quotes: DataFrame, basis: str) -> DataFrame:
    from .prepare import with_period
    from .quality import published
    return with_period(published(quotes), basis).groupBy("period").agg(
        F.count(F.lit(1)).alias("n_quotes"), F.countDistinct("route").alias("n_routes"),
        F.countDistinct("source").alias("n_sources"), F.countDistinct("provenance_id").alias("n_provenance"))


def ledger_segment(ledger: DataFrame, quotes: DataFrame) -> DataFrame:
    """Ledger records that at least one of the quotes points at."""
    return ledger.join(quotes.select("provenance_id").distinct(), "provenance_id", "left_semi")
