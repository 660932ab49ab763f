"""Streaming ingest: duplicate suppression, late-quote quarantine, idempotent append, republish."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..operators.observations import FRESHNESS_HOURS, is_stale
from ..params import Method
from ..plans import incremental
from ..plans.index import Weights
from ..session import materialise
from ..sources.quotes import append_quotes


def suppressed(stream: DataFrame, now: Column | str | None = None, key: str = "duplicate_key", at: str = "collected_at",
               hours: int = FRESHNESS_HOURS, delay: str = "48 hours") -> DataFrame:
    """The stream split before any watermark: fresh rows lose repeats of their key, late ones go on to ``suppress_sink`` as they are.

    ``delay`` must exceed ``hours`` by the clocks' disagreement; then no fresh row is behind the watermark, and the state holds the keys of ``delay``.
    Rows without a time, which no watermark could ever forget, count as late.
    """
    moment = F.current_timestamp() if now is None else F.lit(now).cast("timestamp") if isinstance(now, str) else now
    late = F.coalesce(F.col(at) < moment - F.expr(f"INTERVAL {hours} HOURS"), F.lit(True))
    fresh = stream.where(~late).withWatermark(at, delay).dropDuplicatesWithinWatermark([key])
    return fresh.withColumn("_late", F.lit(False)).unionByName(stream.where(late).withColumn("_late", F.lit(True)))


def suppress_sink(path: str, run: str, key: str = "duplicate_key", at: str = "collected_at") -> Callable[[DataFrame, int], None]:
    """Keep the first row of a key of a ``suppressed`` stream, however late the others or itself arrive.

    A key belongs to one day, as its time bucket is part of it, so rows are compared only with the stored days that they touch, and fresh rows
    only with those of other runs: their own run's state has seen the rest. ``run`` names the stream's checkpoint: a replayed batch of a run
    overwrites its own folder. Rows without a time are a day of their own.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        offered = materialise(batch.withColumn("day", F.to_date(at)).groupBy(key).agg(F.min(F.struct("_late", *[c for c in batch.columns if c not in (key, "_late")], "day")).alias("_r"))
                              .select(key, "_r.*").select(*batch.columns, "day"), "batch")
        offered.drop("day", "_late").limit(0).write.mode("ignore").parquet(f"{path}/run=none/epoch=-1/day=1970-01-01")  # so that the first batch can read
        days = [r["day"] for r in offered.select("day").distinct().collect()]
        rows = offered.drop("_late")
        parts = T.StructType([*rows.schema.fields, T.StructField("run", T.StringType()), T.StructField("epoch", T.LongType())])
        touched = F.col("day").isin([d for d in days if d is not None]) | (F.col("day").isNull() & F.lit(None in days))
        stored = spark.read.schema(parts).parquet(path).where(touched & ~((F.col("run") == run) & (F.col("epoch") == epoch)))
        known = stored.select(key, (F.col("run") == run).alias("_own"))
        fresh = offered.where(~F.col("_late")).join(known.where(~F.col("_own")), key, "left_anti")
        late = offered.where("_late").join(known, key, "left_anti")
        fresh.unionByName(late).drop("_late").write.mode("overwrite").partitionBy("day").parquet(f"{path}/run={run}/epoch={epoch}")
    return write


def quarantine_sink(path: str, now: str, hours: int = FRESHNESS_HOURS) -> Callable[[DataFrame, int], None]:
    """Label late rows QUARANTINED and write both kinds, partitioned by disposition."""
    def write(batch: DataFrame, epoch: int) -> None:
        label = F.when(F.coalesce(is_stale(now, hours), F.lit(False)), "QUARANTINED").otherwise("ACCEPTED")
        batch.withColumn("disposition", label).write.mode("overwrite").partitionBy("disposition").parquet(f"{path}/epoch={epoch}")
    return write


def append_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Insert-or-ignore into the quote store; replays and overlaps add nothing."""
    def write(batch: DataFrame, epoch: int) -> None:
        append_quotes(batch, path)
    return write


def republish_sink(root: str, weights: Weights, method: Method, run: str, index_code: str = "IDX-T") -> Callable[[DataFrame, int], None]:
    """Append a batch and republish the series from the stored states of products and cells.

    Deterministic keys make the republication an upsert; the pinned base keeps history still. ``run`` names the stream's checkpoint.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        incremental.apply(batch, root, weights, method, (run, epoch), index_code)
    return write
