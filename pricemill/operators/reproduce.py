"""Compare a recomputed series with the stored one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

KEY = ("index_code", "period", "frequency", "basis", "omega_preset")


def diff(stored: DataFrame, recomputed: DataFrame, key: Sequence[str] = KEY, value: str = "value") -> DataFrame:
    """Full outer match on the key with presence on either side."""
    a = stored.select(*key, F.col(value).alias("stored"), F.lit(True).alias("_a"))
    b = recomputed.select(*key, F.col(value).alias("recomputed"), F.lit(True).alias("_b"))
    out = a.join(b, list(key), "full_outer")
    return out.select(
        *key, "stored", "recomputed", F.coalesce("_a", F.lit(False)).alias("in_stored"), F.coalesce("_b", F.lit(False)).alias("in_recomputed"),
        F.abs(F.col("stored") - F.col("recomputed")).alias("abs_diff"))


def report(differences: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    return differences.agg(
        F.count(F.lit(1)).alias("n_keys"), F.count_if(~F.col("in_stored")).alias("n_missing"),
        F.count_if(~F.col("in_recomputed")).alias("n_new"), F.count_if(F.col("abs_diff") > tolerance).alias("n_differing"),
        F.max("abs_diff").alias("max_abs_diff"))
