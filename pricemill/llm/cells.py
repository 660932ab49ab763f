"""Operator 11 — centroid clustering over a VA-file.

1. Every vector is turned into integers and stored with its approximation: the number of the cell that holds each
   component, ``BITS`` bits, the cells bounded by quantiles of a sample. The sample (``SAMPLE`` vectors of smallest
   hash, the first of which are the first centroids) decides how wide cells are, never a result.
2. A round is one scan. Each task turns the centroids into lookup tables: for every dimension, cell and centroid the
   least and the greatest squared distance. Sums of looked-up values bound the distance of a vector to every
   centroid from both sides. A centroid whose least distance exceeds the smallest greatest one is out. Where one
   centroid is left the vector is assigned by its cells alone; where intervals overlap, its full components are
   fetched and exact distances to the centroids left decide, ties by the smaller number.
3. The next centroids are exact integer sums: a task hands on one row per cluster, however many vectors it saw, so
   nothing is shuffled but sums, and no cluster is gathered.

A round's update and the last round's distances are sums over all components, so the scan carries the full
vectors beside the cells; what the cells save is arithmetic.

Defined results: vectors that are null, of another length than ``DIMENSIONS``, or with a null or non-finite component
are left out; repeated rows are vectors of their own; a null id hashes like the empty text; rows with equal
id hashes are ordered by their components; fewer vectors than centroids give as many centroids as vectors; an empty
table gives no rows; components beyond 2 ** 19 count as 2 ** 19; other columns are left out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pricemill.session import materialise

from .vectors import embeddings, finite, integers, matrix, packed, squared_distances, summed_by, unpacked

DIMENSIONS, CENTROIDS, ROUNDS = 64, 40, 5
# Eight bits leave the intervals of nearly orthogonal vectors apart for a third of them (six bits: for a thirtieth).
BITS, SAMPLE = 8, 4096
# Vectors that a task bounds at once.
SLICE = 4096


def borders(sample: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Ascending cell borders of every dimension: cell i holds the values in (border i - 1, border i]."""
    cells = 1 << bits
    at = (np.arange(1, cells) * len(sample)) // cells
    return np.sort(sample, axis=0)[at].T if len(sample) else np.zeros((sample.shape[1], cells - 1), np.int32)


def cells_of(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(edges[d], x[:, d], "left") for d in range(x.shape[1])], 1).astype(np.uint8)


def lookup(edges: np.ndarray, ends: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest squared distance by (dimension, cell, centroid); ``ends`` are the extremes of every dimension."""
    low = np.concatenate([ends[:, :1].astype(np.float64), edges + 1.0], 1)[:, :, None]
    high = np.concatenate([edges, ends[:, 1:]], 1).astype(np.float64)[:, :, None]
    c = centroids.T.astype(np.float64)[:, None, :]
    off = np.maximum(np.maximum(low - c, c - high), 0.0)
    return off * off, np.maximum(np.abs(c - low), np.abs(high - c)) ** 2


def candidates(cells: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Which centroids (columns) the intervals leave for which vectors (rows)."""
    least, most = (sum(table[d][cells[:, d]] for d in range(cells.shape[1])) for table in tables)
    return least <= most.min(1, keepdims=True)


def nearest(cells: np.ndarray, x: np.ndarray, tables: tuple[np.ndarray, np.ndarray], centroids: np.ndarray) -> tuple[np.ndarray, int]:
    """The nearest centroid of every vector, and how many vectors had to be fetched in full."""
    left = candidates(cells, tables)
    best = left.argmax(1)
    open_ = np.flatnonzero(left.sum(1) > 1)
    if len(open_):
        exact = squared_distances(x[open_], centroids)
        best[open_] = np.where(left[open_], exact, np.iinfo(np.int64).max).argmin(1)
    return best, len(open_)


def approximate(edges: np.ndarray, length: int):
    def run(batches):
        for batch in batches:
            x = integers(matrix(batch.column("vector"), length))
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id"), "cells": packed(cells_of(x, edges)), "components": packed(x)})
    return run


def _slices(batches):
    for batch in batches:
        for i in range(0, batch.num_rows, SLICE):
            part = batch.slice(i, SLICE)
            yield part, unpacked(part.column("cells"), np.uint8), unpacked(part.column("components"), np.int32)


def _extremes(batches):
    """Least and greatest component of every dimension in a task."""
    low = high = None
    for batch in batches:
        if batch.num_rows:
            x = unpacked(batch.column("components"), np.int32)
            a, b = x.min(0), x.max(0)
            low, high = (a, b) if low is None else (np.minimum(low, a), np.maximum(high, b))
    if low is not None:
        yield pa.RecordBatch.from_pydict({"at": pa.array(range(len(low)), pa.int32()), "low": pa.array(low), "high": pa.array(high)})


def _sums(edges: np.ndarray, ends: np.ndarray, centroids: np.ndarray):
    """One row per cluster and task: number of vectors, how many were fetched, component sums."""
    def run(batches):
        tables, k = lookup(edges, ends, centroids), len(centroids)
        total, count, fetched = np.zeros(centroids.shape, np.int64), np.zeros(k, np.int64), 0
        for _, cells, x in _slices(batches):
            best, open_ = nearest(cells, x, tables, centroids)
            s, n = summed_by(best, x, k)
            total, count, fetched = total + s, count + n, fetched + open_
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(range(k), pa.int32()), "n": pa.array(count), "fetched": pa.array([fetched] + [0] * (k - 1), pa.int64()),
                                          "total": pa.array(total.tolist(), pa.list_(pa.int64()))})
    return run


def _assigned(edges: np.ndarray, ends: np.ndarray, centroids: np.ndarray):
    def run(batches):
        tables = lookup(edges, ends, centroids)
        for part, cells, x in _slices(batches):
            best, _ = nearest(cells, x, tables, centroids)
            distance = ((x.astype(np.int64) - centroids[best].astype(np.int64)) ** 2).sum(1)
            yield pa.RecordBatch.from_pydict({"vec_id": part.column("vec_id"), "cluster": pa.array(best.astype(np.int32)), "distance": pa.array(distance)})
    return run


def hashed_order(vec_id: Column) -> Column:
    return F.sha2(F.concat(F.lit("2:"), F.coalesce(vec_id.cast("string"), F.lit(""))), 256)


def cluster(table: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", centroids: int = CENTROIDS, rounds: int = ROUNDS,
            length: int = DIMENSIONS, bits: int = BITS, sample: int = SAMPLE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every usable vector of ``table``."""
    spark = table.sparkSession
    kept = table.filter((F.size(vector) == length) & finite(F.col(vector))).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector"))
    first = kept.orderBy(hashed_order(F.col("vec_id")), "vector").limit(max(sample, centroids)).select("vector").toArrow()
    shown = integers(matrix(first.column("vector").combine_chunks(), length))
    edges, now = borders(shown, bits), shown[:centroids]
    stored = materialise(kept.mapInArrow(approximate(edges, length), "vec_id long, cells binary, components binary"), "va-file")
    extremes = stored.select("components").mapInArrow(_extremes, "at int, low int, high int").groupBy("at").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    ends = np.array([(r["low"], r["high"]) for r in sorted(extremes.collect())], np.int32).reshape(-1, 2)  # a row per dimension
    for _ in range(rounds if len(now) else 0):
        sums = stored.select("cells", "components").mapInArrow(_sums(edges, ends, now), "cluster int, n long, fetched long, total array<long>")
        by_cell = sums.select("cluster", "n", F.posexplode("total").alias("at", "value")).groupBy("cluster", "at").agg(
            F.sum("n").alias("n"), F.sum("value").alias("value"))
        new = now.copy()
        for row in by_cell.filter("n > 0").collect():  # centroids x dimensions rows
            new[row["cluster"], row["at"]] = row["value"] // row["n"]
        now = new
    if not len(now):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    found = materialise(stored.mapInArrow(_assigned(edges, ends, now), "vec_id long, cluster int, distance long"), "assigned")
    sums = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # a row per centroid
    marks = [(i, sums.get(i, 0), sum(sums.values()), hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for i, row in enumerate(now.tolist())]
    side = spark.createDataFrame(marks, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(side), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster, distance and inertias of every embedding."""
    return cluster(embeddings(spark, sf_dir))


def _sql() -> str:
    floor = "((s - ((s % n) + n) % n) // n)"
    parts = ["""kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
             """c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1)::INT AS cluster, v FROM kept
  QUALIFY row_number() OVER (ORDER BY sha256('2:' || vec_id)) <= 40)"""]
    for i in range(6):
        parts.append(f"""a{i} AS MATERIALIZED (SELECT vec_id, v, m.cluster AS cluster, m.d AS d FROM (SELECT k.vec_id, k.v, min({{'d': list_sum(list_transform(
  range(1, 65), lambda i: (k.v[i] - c.v[i]) * (k.v[i] - c.v[i])))::BIGINT, 'cluster': c.cluster}}) AS m FROM kept k, c{i} c GROUP BY ALL))""")
        if i < 5:
            parts.append(f"""c{i + 1} AS MATERIALIZED (SELECT c{i}.cluster, coalesce(moved.v, c{i}.v) AS v FROM c{i} LEFT JOIN (SELECT cluster, list({floor}::BIGINT ORDER BY i) AS v
  FROM (SELECT cluster, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM a{i}, range(1, 65) r(i) GROUP BY ALL) GROUP BY cluster) moved ON moved.cluster = c{i}.cluster)""")
    return "WITH " + ",\n".join(parts) + """
SELECT vec_id, a5.cluster, d AS distance, sum(d) OVER (PARTITION BY a5.cluster)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(c5.v, ',')) AS centroid_sha256 FROM a5 JOIN c5 ON c5.cluster = a5.cluster"""


OP11_SQL = _sql()
