"""Registry of named queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)``; float columns are rounded so that both engines agree."""
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(_in_utc(spark), sf_dir))
        if sql:
            ORACLES[name] = sql
        return fn
    return register


def _in_utc(spark: SparkSession) -> SparkSession:
    """The twins read timestamps as UTC, so the registered queries do too, whatever the session's zone."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    cols = [
        F.round(F.col(f"`{f.name}`"), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ]
    return df.select(*cols)
