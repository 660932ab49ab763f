"""Quote scans and the append sink."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schemas import PRODUCT, PUBLISHABLE
from ..session import materialise

QUOTE_KEY = [*PRODUCT, "collected_date", "source"]


def scan_quotes(spark: SparkSession, path: str, publishable_only: bool = False) -> DataFrame:
    df = spark.read.parquet(path)
    return df.where(F.col("disposition").isin(PUBLISHABLE)) if publishable_only else df


def new_quotes(batch: DataFrame, store: DataFrame | None, key: Sequence[str] = QUOTE_KEY) -> DataFrame:
    """Rows of ``batch`` whose key is neither repeated in the batch nor present in ``store``.

    The survivor of a repeated key is the smallest row, so a retried task keeps the same one. The
    reduction is a partial aggregate: a key held by a third of the rows is folded before the shuffle.
    """
    rest = [c for c in batch.columns if c not in key]
    unique = batch.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_r")).select(*key, "_r.*").select(*batch.columns)
    if store is None:
        return unique
    return unique.join(store.select(*key), list(key), "left_anti")


def append_quotes(batch: DataFrame, path: str, key: Sequence[str] = QUOTE_KEY) -> None:
    """Insert-or-ignore into a date-partitioned store; replaying a batch adds nothing."""
    spark = batch.sparkSession
    store = None
    if path_exists(spark, path):
        batch = materialise(batch, "batch")  # read for its days and for its rows
        days = [r["collected_date"] for r in batch.select("collected_date").distinct().collect() if r["collected_date"] is not None]
        store = spark.read.parquet(path).where(F.col("collected_date").isin(days))
    (new_quotes(batch, store, key).repartition("collected_date", "route", "carrier")
     .write.mode("append").partitionBy("collected_date").parquet(path))


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
