"""Digests of whole tables that no task has to hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Hex digits of a row's hash that name its place on each level of the tree, leaves first.
LEVELS = (6, 4, 2, 0)


def merkle_root(df: DataFrame, line: Column) -> DataFrame:
    """One row: ``root``, a digest of the table's lines whatever their order and partitioning, and their number ``n``.

    Lines are hashed and counted first, so a line that fills a third of the table is one entry. Entries gather by prefixes of their
    hashes, six digits, then four, two and none: a node has at most 256 children, and a leaf a 16-millionth of the lines.
    The root is the hash of no text for an empty table.
    """
    entries = df.select(F.sha2(line, 256).alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n")).withColumn("h", F.concat_ws(":", "p", F.col("n").cast("string")))
    for digits in LEVELS:
        child = F.array_sort(F.collect_list(F.struct("p", "h")))
        entries = entries.groupBy(F.substring("p", 1, digits).alias("p")).agg(
            F.sha2(F.array_join(F.transform(child, lambda c: c["h"]), ""), 256).alias("h"), F.sum("n").alias("n"))
    return entries.agg(F.coalesce(F.max("h"), F.sha2(F.lit(""), 256)).alias("root"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def merkle_sql(lines: str) -> str:
    """The same over ``lines``, a query with one column ``line``; a parenthesised query of root and n."""
    levels = "entries AS (SELECT sha256(line) AS p, sha256(line) || ':' || count(*) AS h, count(*) AS n FROM lines GROUP BY sha256(line)),\n"
    before = "entries"
    for digits in LEVELS:
        levels += f"level{digits} AS (SELECT substr(p, 1, {digits}) AS p, sha256(string_agg(h, '' ORDER BY p)) AS h, sum(n) AS n FROM {before} GROUP BY substr(p, 1, {digits})),\n"
        before = f"level{digits}"
    return f"(WITH lines AS ({lines}),\n{levels.rstrip(',\n')}\nSELECT coalesce(max(h), sha256('')) AS root, coalesce(sum(n), 0)::BIGINT AS n FROM {before})"
