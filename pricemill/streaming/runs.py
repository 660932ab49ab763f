"""Running streams: file sources, bounded triggers, update sinks that can be replayed."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..session import work_dir


def file_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


@contextmanager
def _local_state_partitions(spark: SparkSession):
    """State stores are one per shuffle partition; a single machine needs no more than its cores."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    if spark.sparkContext.master.startswith("local"):
        spark.conf.set(name, str(min(int(before), spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


# State with timers and several variables per key lives in RocksDB.
ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    """Session settings that a stream reads when it starts."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def drain(stream: DataFrame, checkpoint: str, each_batch: Callable[[DataFrame, int], None], mode: str = "append", **settings: str) -> None:
    """Process all input now available, batch by batch, then stop."""
    with _local_state_partitions(stream.sparkSession), _settings(stream.sparkSession, settings):
        q = (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).foreachBatch(each_batch).start())
        q.awaitTermination()


def to_folder(path: str) -> Callable[[DataFrame, int], None]:
    """Each batch overwrites its own sub-folder, so a replayed batch leaves one copy."""
    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
    return write


def run_to_table(stream: DataFrame, purpose: str, mode: str = "append", **settings: str) -> DataFrame:
    """Drain a stream into a fresh folder and return it as a table with its ``epoch``."""
    spark = stream.sparkSession
    root = work_dir(spark, purpose)
    drain(stream, f"{root}/checkpoint", to_folder(f"{root}/out"), mode, **settings)
    return spark.read.parquet(f"{root}/out")


def latest_updates(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Last emitted row of each key of an update-mode sink."""
    rest = [c for c in updates.columns if c not in keys and c != "epoch"]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "epoch").alias("_r")).select(*keys, "_r.*")
