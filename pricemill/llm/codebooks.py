"""Operator 13 — vector code compression with Drake-Hamerly adaptive bounds.

Vectors are cut into equal parts; every part position has a codebook of integer entries, fitted by rounds of
assignment and exact integer means. The first assignment measures all entries and persists, beside the vector, for
each part its ``b`` closest entries in order, lower bounds of their distances, and one outer bound below the distance
of every entry not in the list. After entries have moved, a bound sinks by its entry's drift, the outer one by the
greatest drift of the position. The exact distance of the present entry is compared with the ordered bounds: all
entries from the first bound above it on are out. Most parts are settled so; the few entries before that place are
verified by exact integer distances, ties by the lower index; where even the outer bound is too low, all entries are.
Every batch then adapts ``b`` to the depth that its parts needed, and persists the new lists for the next round.

Bounds are held in 16 bits and always rounded down, so they only ever cost a verification, never a wrong code.
Tasks hand on sums by part position and entry; nothing else is shuffled.

Defined results: vectors that are null, with a null or non-finite component, or of another length than ``DIMENSIONS`` are left out;
repeated rows are vectors of their own; null ids come last among the vectors that start the codebooks, equal ids are ordered by
their components; fewer vectors than entries give as many entries as vectors; an empty table gives no rows; components beyond
2 ** 19 count as 2 ** 19; other columns are left out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from pricemill.session import materialise

from .vectors import embeddings, finite, integers, matrix, packed, squared_distances, summed_by, unpacked

DIMENSIONS, PARTS, ENTRIES, ROUNDS = 64, 16, 64, 2
# Closest entries of a part that the first assignment persists; share of a batch's parts that its lists shall serve.
FIRST_B, SERVED = 8, 0.95
SLICE = 4096


class Bounds:
    """Lists of the closest entries of (vectors, parts): ``near`` (entry numbers, ascending by bound), ``low`` and ``outer``
    (lower bounds of distances, in units)."""

    def __init__(self, near: np.ndarray, low: np.ndarray, outer: np.ndarray):
        self.near, self.low, self.outer = near, low, outer

    def pack(self) -> pa.Array:
        n = len(self.near)
        return packed(np.concatenate([self.near.reshape(n, -1), self.low.reshape(n, -1).view(np.uint8).reshape(n, -1),
                                      np.ascontiguousarray(self.outer).view(np.uint8).reshape(n, -1)], 1))

    @classmethod
    def unpack(cls, raw: np.ndarray, parts: int) -> Bounds:
        n, b = len(raw), (raw.shape[1] // parts - 2) // 3
        cut = np.split(np.ascontiguousarray(raw), [parts * b, 3 * parts * b], axis=1)
        wide = [np.ascontiguousarray(c).view(np.uint16) for c in cut[1:]]
        return cls(cut[0].reshape(n, parts, b), wide[0].reshape(n, parts, b), wide[1].reshape(n, parts))


def floored(distance: np.ndarray, unit: float) -> np.ndarray:
    """Distances as 16-bit numbers of units, never above their value."""
    return np.clip(np.floor(distance / unit * (1 - 1e-12)) - 1, 0, 65535).astype(np.uint16)


def unit_of(books: np.ndarray) -> float:
    """A unit in which twice the widest spread of an entry position fits 16 bits."""
    return max(1e-3, 2.0 * float(np.sqrt(((books.max(1) - books.min(1)).astype(np.float64) ** 2).sum(-1).max())) / 65000)


def search(x: np.ndarray, book: np.ndarray, b: int, unit: float):
    """Full search of one part position: code, squared distance, and the lists of the ``b`` closest entries."""
    exact = squared_distances(x, book)
    order = np.argsort(exact, 1, kind="stable")  # ties: the lower index first
    ranked = np.take_along_axis(exact, order, 1)
    rest = np.sqrt(ranked[:, b].astype(np.float64)) if ranked.shape[1] > b else np.full(len(x), 65535.0 * unit)
    outer = floored(rest, unit) if ranked.shape[1] > b else np.full(len(x), 65535, np.uint16)
    return order[:, 0], ranked[:, 0], order[:, :b].astype(np.uint8), floored(np.sqrt(ranked[:, :b].astype(np.float64)), unit), outer


def settle(x: np.ndarray, book: np.ndarray, drift: np.ndarray, near: np.ndarray, low: np.ndarray, outer: np.ndarray, unit: float):
    """Codes after the entries of one part position have moved by ``drift``; the lists in step with them, and the depth needed."""
    n, b = near.shape
    down = np.ceil(drift / unit * (1 + 1e-12)).astype(np.int64)
    bound = np.maximum(low.astype(np.int64) - down[near], 0)
    # Nothing is outside a list of all entries.
    beyond = outer.astype(np.int64) if len(book) <= b else np.maximum(outer.astype(np.int64) - int(down.max()), 0)
    # Ordered again: a place's bound also holds for all places after it.
    ladder = np.minimum.accumulate(np.concatenate([bound, beyond[:, None]], 1)[:, ::-1], 1)[:, ::-1]
    own = ((x.astype(np.int64) - book[near[:, 0]].astype(np.int64)) ** 2).sum(1)
    reach = np.ceil(np.sqrt(own.astype(np.float64)) / unit * (1 + 1e-12)).astype(np.int64)
    out = ladder > reach[:, None]
    depth = np.where(out[:, 1:].any(1), out[:, 1:].argmax(1) + 1, b + 1)  # entries before this place may be closest
    if len(book) <= b:
        depth = np.minimum(depth, b)
    code, best = near[:, 0].astype(np.int64), own.copy()
    near, low, beyond = near.copy(), np.minimum(bound, 65535).astype(np.uint16), np.minimum(beyond, 65535).astype(np.uint16)
    low[:, 0] = floored(np.sqrt(own.astype(np.float64)), unit)
    some = np.flatnonzero((depth > 1) & (depth <= b))
    for deep in np.unique(depth[some]):
        at = some[depth[some] == deep]
        few = near[at, :deep].astype(np.int64)
        exact = ((x[at, None, :].astype(np.int64) - book[few].astype(np.int64)) ** 2).sum(2)
        order = np.lexsort((few, exact), axis=1)
        few, exact = np.take_along_axis(few, order, 1), np.take_along_axis(exact, order, 1)
        code[at], best[at] = few[:, 0], exact[:, 0]
        near[at, :deep], low[at, :deep] = few, floored(np.sqrt(exact.astype(np.float64)), unit)
    wide = np.flatnonzero(depth > b)
    if len(wide):
        code[wide], best[wide], near[wide], low[wide], beyond[wide] = search(x[wide], book, b, unit)
    return code, best, near, low, beyond, depth


def shrunk(bounds: Bounds, b: int) -> Bounds:
    """The lists cut to ``b`` entries; the bounds of those dropped go into the outer one."""
    if b >= bounds.near.shape[2]:
        return bounds
    return Bounds(bounds.near[:, :, :b].copy(), bounds.low[:, :, :b].copy(), np.minimum(bounds.outer, bounds.low[:, :, b:].min(2)))


def adapted(depth: np.ndarray, b: int) -> int:
    """List length for the next round: what served enough parts in this one, one entry to spare."""
    return int(min(b, max(2, np.quantile(depth, SERVED, method="higher") + 1))) if depth.size else b


def start(length: int, parts: int, books: np.ndarray, b: int):
    """vec_id, label, components, codes, error and lists of every vector by full search."""
    def run(batches):
        unit = unit_of(books)
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                part = batch.slice(i, SLICE)
                x = integers(matrix(part.column("vector"), length))
                cut = x.reshape(len(x), parts, -1)
                found = [search(cut[:, p], books[p], b, unit) for p in range(parts)]
                lists = Bounds(*(np.ascontiguousarray(np.stack([f[j] for f in found], 1)) for j in (2, 3, 4)))
                yield pa.RecordBatch.from_pydict({
                    "vec_id": part.column("vec_id"), "label": part.column("label"), "components": packed(x),
                    "codes": packed(np.stack([f[0] for f in found], 1).astype(np.uint8)), "error": pa.array(sum(f[1] for f in found)),
                    "verified": pa.array(np.full(len(x), parts * len(books[0]), np.int64)), "lists": lists.pack()})
    return run


def again(parts: int, books: np.ndarray, before: np.ndarray, unit: float):
    """The rows of the last round with codes, errors and lists for the moved entries."""
    def run(batches):
        drift = np.sqrt(((books.astype(np.float64) - before.astype(np.float64)) ** 2).sum(2))
        for batch in batches:
            width = batch.column("lists")
            sizes = np.diff(np.frombuffer(width.buffers()[1], np.int32)[width.offset:width.offset + len(width) + 1])
            cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(sizes)]  # lists of one length at a time
            for lo, hi in zip(cuts, cuts[1:]):
                for i in range(lo, hi, SLICE):
                    part = batch.slice(i, min(SLICE, hi - i))
                    x = unpacked(part.column("components"), np.int32)
                    held = Bounds.unpack(unpacked(part.column("lists"), np.uint8), parts)
                    cut = x.reshape(len(x), parts, -1)
                    found = [settle(cut[:, p], books[p], drift[p], held.near[:, p], held.low[:, p], held.outer[:, p], unit) for p in range(parts)]
                    lists = Bounds(*(np.ascontiguousarray(np.stack([f[j] for f in found], 1)) for j in (2, 3, 4)))
                    depth = np.stack([f[5] for f in found], 1)
                    b = held.near.shape[2]
                    cost = np.where(depth > b, len(books[0]), depth).sum(1)
                    yield pa.RecordBatch.from_pydict({
                        "vec_id": part.column("vec_id"), "label": part.column("label"), "components": part.column("components"),
                        "codes": packed(np.stack([f[0] for f in found], 1).astype(np.uint8)), "error": pa.array(sum(f[1] for f in found)),
                        "verified": pa.array(cost.astype(np.int64)), "lists": shrunk(lists, adapted(depth, b)).pack()})
    return run


def _sums(parts: int, entries: int):
    """One row per task, part position and used entry: number of parts and their component sums."""
    def run(batches):
        total = count = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x, codes = unpacked(batch.column("components"), np.int32), unpacked(batch.column("codes"), np.uint8)
            cut = x.reshape(len(x), parts, -1)
            got = [summed_by(codes[:, p].astype(np.int64), cut[:, p], entries) for p in range(parts)]
            s, n = np.stack([g[0] for g in got]), np.stack([g[1] for g in got])
            total, count = (s, n) if total is None else (total + s, count + n)
        if total is not None:
            p, e = np.nonzero(count)
            yield pa.RecordBatch.from_pydict({"part": pa.array(p.astype(np.int32)), "entry": pa.array(e.astype(np.int32)), "n": pa.array(count[p, e]),
                                              "total": pa.array(total[p, e].tolist(), pa.list_(pa.int64()))})
    return run


def moved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks with every used entry at the floor of the mean of its parts."""
    sums = rows.select("components", "codes").mapInArrow(_sums(len(books), books.shape[1]), "part int, entry int, n long, total array<long>")
    cells = sums.select("part", "entry", "n", F.posexplode("total").alias("at", "value")).groupBy("part", "entry", "at").agg(
        F.sum("n").alias("n"), F.sum("value").alias("value"))
    new = books.copy()
    for r in cells.collect():  # entries x dimensions rows at most
        new[r["part"], r["entry"], r["at"]] = r["value"] // r["n"]
    return new


def compress(table: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", label: str = "label", length: int = DIMENSIONS,
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, first_b: int = FIRST_B) -> tuple[DataFrame, np.ndarray | None]:
    """vec_id, label, codes (binary), error and ``verified`` (entries measured in the last assignment) of every usable vector,
    and the codebooks (part, entry, position). At most 256 entries; ``parts`` divides ``length``."""
    spark, schema = table.sparkSession, "vec_id long, label string, components binary, codes binary, error long, verified long, lists binary"
    kept = table.filter((F.size(vector) == length) & finite(F.col(vector))).select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(vector).alias("vector"))
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").toArrow()
    if not first.num_rows:
        return spark.createDataFrame([], schema).drop("components", "lists"), None
    head = integers(matrix(first.column("vector").combine_chunks(), length))
    books = np.ascontiguousarray(head.reshape(len(head), parts, -1).transpose(1, 0, 2))
    unit = unit_of(books)
    rows = materialise(kept.mapInArrow(start(length, parts, books, min(first_b, len(head))), schema), "codes-0")
    for i in range(rounds):
        new = moved(rows, books)
        rows, books = materialise(rows.mapInArrow(again(parts, new, books, unit), schema), f"codes-{i + 1}"), new
    return rows.drop("components", "lists"), books


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code, error and label error of every embedding, and the digest of all codebooks."""
    rows, books = compress(embeddings(spark, sf_dir))
    digest = hashlib.sha256(",".join(map(str, [] if books is None else books.reshape(-1).tolist())).encode()).hexdigest()
    by_label = rows.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    return rows.join(by_label, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql() -> str:
    floor = "((s - ((s % n) + n) % n) // n)"
    out = ["""kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
           "cut AS MATERIALIZED (SELECT vec_id, p, v[4 * p + 1:4 * p + 4] AS v FROM kept, range(16) r(p))",
           """b0 AS MATERIALIZED (SELECT p, (row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1)::INT AS e, v FROM cut
  QUALIFY row_number() OVER (PARTITION BY p ORDER BY vec_id) <= 64)"""]
    for i in range(3):
        out.append(f"""a{i} AS MATERIALIZED (SELECT vec_id, p, v, m.e AS e, m.d AS d FROM (SELECT x.vec_id, x.p, x.v, min({{'d': (x.v[1] - b.v[1]) * (x.v[1] - b.v[1])
  + (x.v[2] - b.v[2]) * (x.v[2] - b.v[2]) + (x.v[3] - b.v[3]) * (x.v[3] - b.v[3]) + (x.v[4] - b.v[4]) * (x.v[4] - b.v[4]), 'e': b.e}}) AS m
  FROM cut x JOIN b{i} b ON b.p = x.p GROUP BY ALL))""")
        if i < 2:
            means = ", ".join(f"{floor.replace('s', f's{j}')}::BIGINT" for j in range(1, 5))
            out.append(f"""b{i + 1} AS MATERIALIZED (SELECT b{i}.p, b{i}.e, coalesce(moved.v, b{i}.v) AS v FROM b{i} LEFT JOIN (SELECT p, e, [{means}] AS v FROM (
  SELECT p, e, count(*) AS n, {', '.join(f'sum(v[{j}])::BIGINT AS s{j}' for j in range(1, 5))} FROM a{i} GROUP BY p, e)) moved ON moved.p = b{i}.p AND moved.e = b{i}.e)""")
    return "WITH " + ",\n".join(out) + """,
coded AS (SELECT vec_id, string_agg(lower(lpad(to_hex(e), 2, '0')), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY vec_id)
SELECT coded.vec_id, code, error, sum(error) OVER (PARTITION BY kept.label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM b2) AS codebooks_sha256
FROM coded JOIN kept ON kept.vec_id = coded.vec_id"""


OP13_SQL = _sql()
