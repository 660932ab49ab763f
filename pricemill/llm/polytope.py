"""Operator 12 — near duplicates of embeddings by cross-polytope hashing.

1. Equal vectors are one node with a number of copies.
2. A hash turns the vector by three rounds of random signs and a fast Hadamard transform; the coordinate of greatest
   size and its sign are the value. ``K`` values make a bucket of a table. Multiprobe: a node also enters the
   buckets that lie next to its own, those with the smallest gap between a coordinate and the greatest one. Two nodes meet
   where any of their buckets agree. The number of tables follows from the chance, measured on random pairs at the very
   threshold, that a table brings a pair together: ``MISSED`` bounds the chance that none does. ``K`` grows with the
   logarithm of the nodes, so that buckets of unrelated vectors stay small.
3. Families of near copies fill buckets. From each crowded bucket a bounded sample gives the centre of its largest family.
   Nodes within half of the threshold's angle of one centre surely link with one another (the angle is a
   metric), so a ball is settled by one pass over its members. A node is in one ball, the most populous that holds it.
4. Inside a bucket, pairs that share no ball are verified by their cosine. A bucket of many rows is cut into
   blocks, each holding one large ball or none; two blocks are a task, blocks of one ball never meet. A pair that meets in
   several buckets counts in the first one they share. A task hands on link counts and a spanning forest, never pairs.
5. Components of the forests and balls are the classes.

Defined results: vectors that are null, empty, zero or with a null or non-finite component link with nothing, as do vectors of
different lengths; repeated rows, and rows that share an id, are vectors of their own and link if their vectors do; a
component without any id has none, else ``component_id`` is its smallest id; ``kept`` compares nulls as equal; an empty table gives no rows;
other columns are left out.
"""

from __future__ import annotations

import itertools
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from pricemill.session import materialise

from .bytework import mixed, whole_groups
from .common import sent_if_small
from .graph import components
from .vectors import embeddings, finite

LIKE = 0.95
# Most chance that two vectors at the very threshold meet in no bucket.
MISSED = 1e-4
# Rows of a block of a bucket; rows of unrelated vectors that a bucket may hold on average.
BLOCK, LOAD = 2048, 512
# A bucket of so many nodes gets a centre, from about so many of them.
CROWDED, SHOWN = 256, 48
SLICE = 2048
# Cosines of vectors nearer than this to the threshold's half angle are left to verification.
SLACK = 1e-9


def units(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def hadamard(x: np.ndarray) -> np.ndarray:
    """The normalised fast Hadamard transform of rows whose length is a power of two."""
    n, d = x.shape
    step = 1
    while step < d:
        pair = x.reshape(n, d // (2 * step), 2, step)
        x = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], 2).reshape(n, d)
        step *= 2
    return x / math.sqrt(d)


@lru_cache(maxsize=8)
def probe_sets(k: int) -> tuple[np.ndarray, ...]:
    return tuple(np.array(c) for c in zip(*itertools.product(range(3), repeat=k)))


class Tables:
    """Bucket keys of unit vectors of one length."""

    def __init__(self, length: int, k: int, tables: int):
        self.length, self.k, self.tables, self.probes = length, k, tables, 1 << k
        self.width = max(4, 1 << (length - 1).bit_length())
        self.signs = np.random.default_rng([length, k, 12]).choice(np.array([-1.0, 1.0]), (tables, k, 3, self.width))

    def keys(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables, probes): hashes of (length, table, values); the first probe is the vector's own bucket."""
        wide = np.zeros((len(x), self.width))
        wide[:, :self.length] = x
        out = np.zeros((len(x), self.tables, self.probes), np.uint64)
        places = probe_sets(self.k)
        for t in range(self.tables):
            values, gaps = [], []
            for f in range(self.k):
                y = wide
                for s in self.signs[t, f]:
                    y = hadamard(y * s)
                size = np.abs(y)
                best = np.argsort(-size, 1, kind="stable")[:, :3]
                top = np.take_along_axis(size, best, 1)
                values.append(2 * best + (np.take_along_axis(y, best, 1) < 0))
                gaps.append((top[:, :1] - top) ** 2)
            gap = sum(g[:, p] for g, p in zip(gaps, places))
            chosen = np.argsort(gap, 1, kind="stable")[:, :self.probes]
            key = np.full(chosen.shape, self.length, np.uint64) ^ mixed(np.full(1, t + 1, np.uint64))
            for v, p in zip(values, places):
                key = mixed(key ^ np.take_along_axis(v[:, p], chosen, 1).astype(np.uint64))
            out[:, t] = key
        return out


@lru_cache(maxsize=64)
def tables_for(length: int, k: int, like: float = LIKE, missed: float = MISSED) -> Tables:
    """As many tables as pairs at the threshold need, judged by random pairs."""
    if length == 1:
        return Tables(length, k, 1)
    rnd = np.random.default_rng([length, k, 95])
    a = units(rnd.normal(size=(4000, length)))
    z = rnd.normal(size=a.shape)
    b = like * a + math.sqrt(1 - like * like) * units(z - (z * a).sum(1, keepdims=True) * a)
    trial = Tables(length, k, 2)
    met = (trial.keys(a)[:, :, :, None] == trial.keys(b)[:, :, None, :]).any((2, 3)).mean()
    return Tables(length, k, max(1, math.ceil(math.log(missed) / math.log(max(1 - met, 1e-9)))))


def values_per_bucket(nodes: int, width: int = 64) -> int:
    """The fewest values, two at least, for which unrelated vectors stay below ``LOAD`` rows a bucket."""
    k = 2
    while nodes * (1 << k) > LOAD * (2 * width) ** k:
        k += 1
    return k


def by_length(column: pa.Array):
    """(rows, matrix of doubles) for every length of the vectors."""
    sizes = np.asarray(column.value_lengths())
    for length in np.unique(sizes):
        at = np.flatnonzero(sizes == length)
        part = column if len(at) == len(sizes) else column.take(pa.array(at))
        yield at, part.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), int(length))


def _hashed(k: int, like: float):
    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                part = batch.slice(i, SLICE)
                for at, x in by_length(part.column("vector")):
                    keys = tables_for(x.shape[1], k, like).keys(units(x)).reshape(len(x), -1).view(np.int64)
                    rows = part.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.ListArray.from_arrays(
                        pa.array(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32)), pa.array(keys.reshape(-1)))], [*rows.schema.names, "keys"])
    return run


def _centre(like: float):
    """The centre of the largest family among the rows of a bucket's sample."""
    def run(key, table):
        where, x = max(by_length(table.column("vector").combine_chunks()), key=lambda found: len(found[0]))
        x = units(x)
        near = x @ x.T >= like
        centre = units(x[near[int(near.sum(1).argmax())]].mean(0, keepdims=True))[0]
        return pa.table({"key": pa.array([key[0].as_py()], pa.int64()), "centre": pa.array([centre.tolist()], pa.list_(pa.float64()))})
    return run


def _inside(like: float):
    """(node, ball) for rows within half of the threshold's angle of the bucket's centre."""
    half = math.cos(math.acos(like) / 2) + SLACK

    def run(batches):
        for batch in batches:
            mine, centre = batch.column("vector"), batch.column("centre")
            same = np.asarray(mine.value_lengths()) == np.asarray(centre.value_lengths())
            batch = batch.filter(pa.array(same))
            for (at, x), (_, c) in zip(by_length(batch.column("vector")), by_length(batch.column("centre"))):
                hit = pa.array(at[(units(x) * units(c)).sum(1) >= half])
                yield pa.RecordBatch.from_arrays([batch.column(c).take(hit) for c in ("node", "copies", "key")], ["node", "copies", "ball"])
    return run


def balls(coded: DataFrame, like: float = LIKE, crowded: int = CROWDED, shown: int = SHOWN) -> DataFrame:
    """node, copies and ball of the nodes that lie in a ball of two nodes or more."""
    own = coded.withColumn("key", F.col("keys")[0])
    full = own.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= crowded)
    full = materialise(full, "crowded")
    drawn = F.pmod(F.xxhash64("node", F.lit(3)), F.lit(1 << 30)) * F.col("n") < (shown << 30)
    sample = own.join(sent_if_small(full, 32), "key").filter(drawn).select("key", "vector")
    centres = materialise(sample.groupBy("key").applyInArrow(_centre(like), "key long, centre array<double>"), "centres")
    met = coded.select("node", "copies", "vector", F.explode(F.array_distinct("keys")).alias("key")).join(sent_if_small(centres, 600), "key")
    inside = materialise(met.mapInArrow(_inside(like), "node long, copies long, ball long"), "inside")
    size = inside.groupBy("ball").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    best = inside.join(size, "ball").groupBy("node", "copies").agg(F.max(F.struct("n", "ball")).alias("b")).select("node", "copies", "b.ball")
    return materialise(best, "balls")


def tasks_of(rows: DataFrame, block: int) -> DataFrame:
    """``rows`` (key, node, ball, ...) with ``tasks``: every (task, side) in which the row is compared.

    A bucket of at most ``block`` rows is one task. In a larger one every ball of more than ``block`` rows is cut into blocks of its own
    and all other rows into common blocks; every two blocks but those of the same ball are a task.
    """
    counts = rows.groupBy("key", "ball").agg(F.count(F.lit(1)).alias("n"))
    held = counts.withColumn("ball", F.when(F.col("n") > block, F.col("ball")).otherwise(F.lit(-1).cast("long"))).groupBy("key", "ball").agg(F.sum("n").alias("n"))
    cut = F.struct("ball", F.ceil(F.col("n") / block).cast("int").alias("parts"))
    large = held.groupBy("key").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(cut)).alias("cuts")).filter(F.col("n") > block).drop("n")
    large = materialise(large, "large-buckets")
    small = rows.join(sent_if_small(large.select("key"), 16), "key", "left_anti")
    one = F.array(F.struct(F.col("key").alias("task"), F.lit(0).alias("side")))
    wide = rows.join(sent_if_small(large, 256), "key")
    mine = F.when(F.exists("cuts", lambda c: (c.ball == F.col("ball")) & (F.col("ball") != -1)), F.col("ball")).otherwise(F.lit(-1).cast("long"))
    parts = F.filter("cuts", lambda c: c.ball == F.col("_mine"))[0].parts
    wide = wide.withColumn("_mine", mine).withColumn("_block", F.pmod(F.xxhash64("node"), parts).cast("int"))
    others = F.flatten(F.transform("cuts", lambda c: F.transform(F.sequence(F.lit(0), c.parts - 1), lambda j: F.struct(c.ball.alias("ball"), j.alias("block")))))
    me = F.struct(F.col("_mine").alias("ball"), F.col("_block").alias("block"))
    meets = F.filter(others, lambda o: (o.ball != F.col("_mine")) | (F.col("_mine") == -1))
    task = F.transform(meets, lambda o: F.struct(
        F.xxhash64(F.col("key"), F.least(me, o).ball, F.least(me, o).block, F.greatest(me, o).ball, F.greatest(me, o).block).alias("task"),
        F.when(me <= o, 0).otherwise(1).alias("side")))
    return small.withColumn("tasks", one).unionByName(wide.withColumn("tasks", task).drop("cuts", "_mine", "_block"))


def first_met(left: np.ndarray, right: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether ``key`` is the first bucket that the rows of ``left`` and ``right`` (rows, tables, probes) share."""
    out = np.zeros(len(key), bool)
    for i in range(0, len(key), 1 << 15):
        a, b, here = left[i:i + (1 << 15)], right[i:i + (1 << 15)], key[i:i + (1 << 15)]
        common = (a[:, :, :, None] == b[:, :, None, :]).any(3)
        table = common.any(2).argmax(1)
        row = np.arange(len(here))
        shared = np.where(common[row, table], a[row, table], np.iinfo(np.int64).max)
        out[i:i + (1 << 15)] = shared.min(1) == here
    return out


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest row reachable from each of ``n`` rows by the links (a, b)."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def linked(x: np.ndarray, sides: np.ndarray, ball: np.ndarray, codes: np.ndarray, key: np.ndarray, like: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of a task's rows: unit vectors ``x`` of side 0, or of sides 0 and 1, side 0 first."""
    left = int((sides == 0).sum())
    if left < len(x):
        a, b = np.nonzero(x[:left] @ x[left:].T >= like)
        b = b + left
    else:
        a, b = np.nonzero(np.triu(x @ x.T >= like, 1))
    other = (ball[a] != ball[b]) | (ball[a] == -1)
    a, b = a[other], b[other]
    first = first_met(codes[a], codes[b], key[a])
    return a[first], b[first]


def _verified(probes: int, like: float):
    """(node, links, peer): copies that a node links with in a task, and an edge of the task's spanning forest."""
    def run(batches):
        for batch in whole_groups(batches, lambda b: np.flatnonzero(np.append(True, np.diff(b.column("task").to_numpy()) != 0))):
            task = batch.column("task").to_numpy()
            begin = np.flatnonzero(np.append(True, task[1:] != task[:-1]))
            size = np.diff(np.append(begin, len(task)))
            out = []
            for lo, m in zip(begin[size > 1].tolist(), size[size > 1].tolist()):
                whole = batch.slice(lo, m)
                for at, x in by_length(whole.column("vector")):
                    rows = whole if len(at) == m else whole.take(pa.array(at))
                    node, copies, side, ball, key = (rows.column(c).to_numpy() for c in ("node", "copies", "side", "ball", "key"))
                    codes = rows.column("keys").flatten().to_numpy().reshape(len(at), -1, probes)
                    a, b = linked(units(x), side, ball, codes, key, like)
                    links = np.bincount(a, copies[b], len(at)) + np.bincount(b, copies[a], len(at))
                    held = np.flatnonzero(links)
                    out.append((node[held], links[held].astype(np.int64), node[forest(a, b, len(at))[held]]))
            if out:
                n, links, peer = (np.concatenate(c) for c in zip(*out))
                yield pa.RecordBatch.from_pydict({"node": pa.array(n), "links": pa.array(links), "peer": pa.array(peer)})
    return run


def near_duplicates(table: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", like: float = LIKE, block: int = BLOCK, crowded: int = CROWDED) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``table``."""
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector"))
    real = finite(F.col("vector")) & F.exists("vector", lambda x: x != 0)
    marked = rows.withColumn("m1", F.when(real, F.xxhash64("vector"))).withColumn("m2", F.when(real, F.xxhash64(F.lit(12), "vector")))
    # 128 bits stand for a vector.
    nodes = marked.filter("m1 is not null").groupBy("m1", "m2").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"), F.first("vector").alias("vector"))
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    k = values_per_bucket(nodes.count())
    schema = nodes.select("node", "copies", "vector").schema.add("keys", T.ArrayType(T.LongType()))
    coded = materialise(nodes.select("node", "copies", "vector").mapInArrow(_hashed(k, like), schema), "buckets")
    settled = balls(coded, like, crowded)
    dealt = coded.join(sent_if_small(settled.select("node", "ball"), 24), "node", "left").withColumn("ball", F.coalesce("ball", F.lit(-1).cast("long")))
    met = tasks_of(dealt.select("*", F.explode(F.array_distinct("keys")).alias("key")), block)
    compared = met.select("key", "node", "copies", "ball", "vector", "keys", F.explode("tasks").alias("t")).select("*", "t.task", "t.side").drop("t")
    found = materialise(compared.repartition("task").sortWithinPartitions("task", "side", "node").mapInArrow(
        _verified(1 << k, like), "node long, links long, peer long"), "verified")
    inside = settled.groupBy("ball").agg(F.sum("copies").alias("all"), F.min("node").alias("hub"))
    sure = materialise(settled.join(inside, "ball").select("node", (F.col("all") - F.col("copies")).alias("links"), F.col("hub").alias("peer")), "sure")
    both = found.unionByName(sure)
    links = both.groupBy("node").agg(F.sum("links").alias("links"))
    classes = components(both.select(F.col("node").alias("a"), F.col("peer").alias("b")), "families")
    known = nodes.select("node", "m1", "m2", "copies", "least").join(links, "node", "left").join(classes, "node", "left").withColumn("root", F.coalesce("root", "node"))
    known = materialise(known, "classes")
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    by_mark = materialise(known.join(least, "root").select(F.col("m1").alias("a1"), F.col("m2").alias("a2"), "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "by-mark")
    joined = marked.select("vec_id", "m1", "m2").join(by_mark, (F.col("m1") == F.col("a1")) & (F.col("m2") == F.col("a2")), "left")
    component = F.when(F.col("m1").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and class of every embedding."""
    return near_duplicates(embeddings(spark, sf_dir))


OP12_SQL = """
WITH RECURSIVE usable AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM usable x JOIN usable y ON x.vec_id <> y.vec_id AND len(x.v) = len(y.v)
  WHERE list_cosine_similarity(x.v, y.v) >= 0.95),
reach AS (SELECT a AS node, a AS root FROM links UNION SELECT b, root FROM reach JOIN links ON a = node WHERE root < b),
least AS (SELECT node, min(root) AS root FROM reach GROUP BY node)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE a = e.vec_id) AS n_links, coalesce(root, e.vec_id) AS component_id, coalesce(root, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN least ON node = e.vec_id
"""
