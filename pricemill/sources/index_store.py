"""Index-value and cell stores: deterministic ids, latest-wins upsert, run hashes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.digests import merkle_root
from ..functions.scalars import row_key
from ..schemas import INDEX_KEY
from . import snapshots


def with_index_id(rows: DataFrame) -> DataFrame:
    return rows.withColumn("index_id", row_key(*INDEX_KEY))


def upserted(new: DataFrame, old: DataFrame | None, version: str, key: Sequence[str] = INDEX_KEY) -> DataFrame:
    """Latest version of every key; a partial aggregate, so repeated keys fold before the shuffle."""
    rows = new if old is None else old.unionByName(new, allowMissingColumns=True)
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), version).alias("_r")).select(*key, "_r.*").select(*rows.columns)


# One partition of the index store: a headline series, or all detail series of one kind below it.
SERIES = ["family", "frequency", "basis", "omega_preset"]


def with_family(rows: DataFrame) -> DataFrame:
    return rows.withColumn("family", F.regexp_extract("index_code", "^[^:]*(:[a-z]+)?", 0))


def write_index_values(new: DataFrame, path: str, version: str = "computed_at") -> int:
    """Upsert rows; only the partitions that ``new`` has rows of are rewritten. Returns the number of the commit."""
    return snapshots.merge(with_family(with_index_id(new)), path, SERIES, lambda rows, old: upserted(rows, old, version))


def read_index_values(spark, path: str) -> DataFrame:
    return snapshots.read(spark, path).drop("family")


def series_commits(spark, path: str) -> DataFrame:
    """The commit that wrote each partition of the store."""
    at = snapshots.current(spark, path)
    rows = [(*[p.split("=", 1)[1] for p in name.split("/")], int(folder.split("=")[1].split("-")[0])) for name, folder in at.folders.items()]
    return spark.createDataFrame(rows, ", ".join([*[f"{c} string" for c in SERIES], "commit int"]))


def cell_rows(cells: DataFrame, index_code: str, basis: str, run_id: str) -> DataFrame:
    """Store form of the cell table: the unsmoothed level is ``adjusted``."""
    return cells.select(
        F.lit(run_id).alias("run_id"), F.lit(index_code).alias("index_code"), F.lit(basis).alias("basis"),
        "period", "route", "carrier", "apw_days", "matched", "laf", F.col("adjusted_raw").alias("adjusted"),
        F.col("adjusted").alias("adjusted_smoothed"), "availability", "n_matched", "n_quotes", "suppressed")


def write_cells(cells: DataFrame, path: str, index_code: str, basis: str, run_id: str) -> None:
    (cell_rows(cells, index_code, basis, run_id)
     .write.mode("append").partitionBy("index_code", "basis", "run_id").parquet(path))


def output_hash(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Digest of the rows of a result of any size, and their number; null parts are left out of a row."""
    line = F.concat_ws("|", *[F.col(c).cast("string") for c in columns])
    return merkle_root(df, line).withColumnRenamed("root", "output_hash")


def input_hash(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Order-free fingerprint of a large input: a sum over row digests, so no row leaves its task. Null parts are left out of a row."""
    body = F.concat_ws("|", *[F.col(c).cast("string") for c in sorted(columns)])
    digest = F.conv(F.substring(F.md5(body), 1, 8), 16, 10).cast("decimal(38,0)")
    return df.agg(F.sum(digest).cast("string").alias("input_hash"), F.count(F.lit(1)).alias("n"))
