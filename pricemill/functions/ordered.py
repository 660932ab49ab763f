"""Ordered look-back that splits a hot key by an order-preserving bucket."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def split_lag(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str, bucket: Column
) -> DataFrame:
    """``lag(value)`` over (keys order by order), evaluated bucket by bucket.

    ``bucket`` must not decrease along ``order``. Each bucket is one window group; the last value
    of the preceding non-empty bucket is carried over from a table with one row per bucket.
    """
    keys = list(keys)
    order = list(order)
    cut = df.withColumn("_bucket", bucket)
    tail = (
        cut.groupBy(*keys, "_bucket")
        .agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("_tail"))
        .withColumn("_carry", F.lag("_tail").over(W.partitionBy(*keys).orderBy("_bucket")))
        .select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_bucket").alias("_kb"), "_carry")
    )
    on = F.col("_bucket").eqNullSafe(F.col("_kb"))
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    within = W.partitionBy(*keys, "_bucket").orderBy(*order)
    return (
        cut.withColumn("_prev", F.lag(F.struct(F.col(value).alias("v"))).over(within))
        .join(tail, on, "left")
        .withColumn(out, F.coalesce(F.col("_prev"), F.col("_carry"))["v"])
        .drop("_prev", "_carry", "_kb", "_bucket", *[f"_k_{k}" for k in keys])
    )


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, columns: Sequence[str], bucket: Column, count: str | None = None) -> DataFrame:
    """``left`` with the last values, each the last that isn't null, of ``columns`` in ``right`` before its time ``at``.

    Both sides hold ``keys`` and ``at``; a row of ``right`` at the very time doesn't count. ``count`` names a column for the number of earlier rows.
    ``bucket`` is an expression over ``at`` and must not decrease with it: each bucket is one window group, and a table with one row
    per key and bucket carries values and counts from bucket to bucket. Nothing is joined by time. Null keys or times have no history.
    """
    keys, columns = list(keys), list(columns)
    rows = left.select(*keys, at, F.struct(*left.columns).alias("_row"), *[F.lit(None).cast(right.schema[c].dataType).alias(f"_v_{c}") for c in columns])
    timed = F.col(at).isNotNull()
    past = right.where(timed).select(*keys, at, F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), *[F.col(c).alias(f"_v_{c}") for c in columns])
    # Rows of the left side come first among equal times.
    both = rows.unionByName(past).withColumn("_old", F.col("_row").isNull().cast("int")).withColumn("_bucket", bucket)
    last = lambda c, w: F.last(c, ignorenulls=True).over(w)
    folded = both.groupBy(*keys, "_bucket").agg(
        F.sum("_old").alias("_n"), *[F.max_by(f"_v_{c}", F.when(F.col(f"_v_{c}").isNotNull(), F.col(at))).alias(f"_v_{c}") for c in columns])
    before = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    carried = folded.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_bucket").alias("_kb"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
                            *[last(f"_v_{c}", before).alias(f"_c_{c}") for c in columns])
    inside = W.partitionBy(*keys, "_bucket").orderBy(at, "_old").rowsBetween(W.unboundedPreceding, -1)
    here = both.withColumns({**{f"_i_{c}": last(f"_v_{c}", inside) for c in columns}, "_n": F.coalesce(F.sum("_old").over(inside), F.lit(0))}).where("_old = 0")
    on = F.col("_bucket") == F.col("_kb")
    for k in keys:
        on = on & (F.col(k) == F.col(f"_k_{k}"))
    joined = here.join(carried, on, "left")
    out = [F.coalesce(F.col(f"_i_{c}"), F.col(f"_c_{c}")).alias(c) for c in columns]
    return joined.select("_row.*", *out, *([(F.col("_n") + F.coalesce("_n0", F.lit(0))).cast("long").alias(count)] if count else []))
