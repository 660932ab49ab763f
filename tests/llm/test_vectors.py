"""The operators on embeddings against brute-force versions on a small table with odd vectors."""
import collections
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricemill.llm import cells, codebooks, polytope, queries
from pricemill.llm.vectors import LARGEST, squared_distances


def ints(x):
    return [max(-LARGEST, min(LARGEST, math.floor(256.0 * v))) for v in x]


def usable(vectors):
    return [(i, x, label) for i, x, label in vectors if x is not None and len(x) == 64 and all(v is not None and math.isfinite(v) for v in x)]


def far(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b))


def means(assigned, centres):
    groups = collections.defaultdict(list)
    for at, v in assigned:
        groups[at].append(v)
    return [[sum(c) // len(c) for c in zip(*groups[i])] if groups[i] else centre for i, centre in enumerate(centres)]


def test_va_clusters(spark, fixture_dir, vectors):
    kept = [(i, ints(x)) for i, x, _ in usable(vectors)]
    order = sorted(((hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest(), x, i) for i, x, _ in usable(vectors)))
    centres = [ints(x) for _, x, _ in order[:40]]
    nearest = lambda v: min(range(len(centres)), key=lambda c: (far(v, centres[c]), c))
    for _ in range(5):
        centres = means([(nearest(v), v) for _, v in kept], centres)
    found = [(i, nearest(v), v) for i, v in kept]
    inertia = collections.Counter()
    for _, c, v in found:
        inertia[c] += far(v, centres[c])
    want = collections.Counter((i, c, far(v, centres[c]), inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for i, c, v in found)
    rows = cells.op11(spark, fixture_dir).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()
    assert collections.Counter(map(tuple, rows)) == want


@pytest.mark.parametrize("bits", [2, 4, 6, 8])
def test_intervals_hold_the_distances_and_spare_fetches(bits):
    rnd = np.random.default_rng(bits)
    centres = rnd.integers(-60, 60, (12, 64)).astype(np.int32)
    x = (centres[rnd.integers(0, 12, 600)] + rnd.integers(-12, 13, (600, 64))).astype(np.int32)
    x[0], x[1] = 80, -80
    edges = cells.borders(x[:300], bits)
    cell, tables = cells.cells_of(x, edges), cells.lookup(edges, np.stack([x.min(0), x.max(0)], 1), centres)
    exact = squared_distances(x, centres)
    least, most = (sum(t[d][cell[:, d]] for d in range(64)) for t in tables)
    assert (least <= exact).all() and (exact <= most).all() and cell.max() < 1 << bits
    best, fetched = cells.nearest(cell, x, tables, centres)
    assert (best == exact.argmin(1)).all()
    assert fetched < 300 if bits >= 4 else fetched <= 600


def test_fewer_vectors_than_centroids(spark):
    rows = [(i, [float(i)] * 64) for i in range(5)] + [(9, [1.0] * 64)]
    got = cells.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == 6 and max(r["cluster"] for r in got) == 4 or {r["distance"] for r in got} == {0}
    got, books = codebooks.compress(spark.createDataFrame([r + (None,) for r in rows], "vec_id long, embedding array<double>, label int"))
    assert books.shape == (16, 6, 4) and {r["error"] for r in got.collect()} == {0}


def brute_codes(vectors, b=64):
    kept = [(i, ints(x), label) for i, x, label in usable(vectors)]
    head = sorted(usable(vectors), key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:64]
    books = [[ints(x)[4 * p:4 * p + 4] for _, x, _ in head] for p in range(16)]
    code = lambda v, p: min(range(len(books[p])), key=lambda e: (far(v[4 * p:4 * p + 4], books[p][e]), e))
    for _ in range(2):
        books = [means([(code(v, p), v[4 * p:4 * p + 4]) for _, v, _ in kept], books[p]) for p in range(16)]
    out = [(i, [code(v, p) for p in range(16)], v, label) for i, v, label in kept]
    errors = [sum(far(v[4 * p:4 * p + 4], books[p][c[p]]) for p in range(16)) for _, c, v, _ in out]
    by_label = collections.Counter()
    for (_, _, _, label), e in zip(out, errors):
        by_label[label] += e
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    return collections.Counter((i, "".join(f"{x:02x}" for x in c), e, by_label[label], digest) for (i, c, _, label), e in zip(out, errors))


def test_bounded_codes(spark, fixture_dir, vectors):
    rows = codebooks.op13(spark, fixture_dir).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    assert collections.Counter(map(tuple, rows)) == brute_codes(vectors)


@pytest.mark.parametrize("first_b", [1, 2, 3, 8, 63, 64])
def test_bounds_never_change_a_code(first_b):
    """Rounds of small drifts with lists of every length, over many ties, against full search."""
    rnd = np.random.default_rng(first_b)
    x = rnd.integers(-6, 7, (500, 4)).astype(np.int32)
    book = x[:64].copy()
    unit = codebooks.unit_of(book[None])
    code, best, near, low, outer = codebooks.search(x, book, first_b, unit)
    spared = 0
    for i in range(6):
        new = book + rnd.integers(-1, 2, book.shape) * (rnd.random(book.shape) < 0.2)
        drift = np.sqrt(((new - book).astype(float) ** 2).sum(1))
        code, best, near, low, outer, depth = codebooks.settle(x, new, drift, near, low, outer, unit)
        exact = squared_distances(x, new)
        assert (code == exact.argmin(1)).all() and (best == exact.min(1)).all()
        assert (low <= np.sqrt(np.take_along_axis(exact, near.astype(np.int64), 1)) / unit).all()
        rest = np.ones(exact.shape, bool)
        np.put_along_axis(rest, near.astype(np.int64), False, 1)
        assert first_b == 64 or (outer <= np.sqrt(np.where(rest, exact, 1 << 40).min(1)) / unit).all()
        spared += (depth < first_b).sum()
        lists = codebooks.shrunk(codebooks.Bounds(near[:, None], low[:, None], outer[:, None]), codebooks.adapted(depth, near.shape[1]))
        raw = np.stack([np.frombuffer(v.as_py(), np.uint8) for v in lists.pack()])
        again = codebooks.Bounds.unpack(raw, 1)
        near, low, outer, book = again.near[:, 0], again.low[:, 0], again.outer[:, 0], new
        first_b = near.shape[1]
    assert spared or first_b < 3


def test_most_parts_are_settled_by_bounds(spark, tmp_path):
    rnd = np.random.default_rng(1)
    centre = rnd.normal(size=(64, 64))
    rows = [(i, (centre[i % 64] + 0.05 * rnd.normal(size=64)).tolist(), 0) for i in range(2000)]
    got, _ = codebooks.compress(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert got.agg(F.sum("verified")).first()[0] < 0.25 * 2000 * 16 * 64


def links_of(vectors):
    """(n_links, component) of every row by all pairs."""
    ok = [x is not None and len(x) > 0 and all(v is not None and math.isfinite(v) for v in x) and any(x) for _, x, _ in vectors]
    unit = [np.array(x) / max(map(abs, x)) / np.linalg.norm(np.array(x) / max(map(abs, x))) if good else None for (_, x, _), good in zip(vectors, ok)]
    n = len(vectors)
    pairs = [(a, b) for a in range(n) for b in range(a) if ok[a] and ok[b] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95]
    degree = collections.Counter(x for p in pairs for x in p)
    root = polytope.forest(np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]), n)
    least = {}
    for i in range(n):
        if vectors[i][0] is not None:
            least[root[i]] = min(least.get(root[i], 1 << 60), vectors[i][0])
    return [(vectors[i][0], degree[i], least.get(root[i]), vectors[i][0] == least.get(root[i])) for i in range(n)]


@pytest.mark.parametrize("how", [{}, {"block": 7, "crowded": 4}, {"block": 16, "crowded": 1 << 30}, {"block": 5, "crowded": 2}])
def test_polytope_links(spark, fixture_dir, vectors, how):
    table = spark.read.parquet(f"{fixture_dir}/embeddings.parquet")
    rows = [tuple(r) for r in polytope.near_duplicates(table, **how).select("vec_id", "n_links", "component_id", "kept").collect()]
    assert collections.Counter(rows) == collections.Counter(links_of(vectors))


def test_pairs_at_the_threshold_meet():
    rnd = np.random.default_rng(9)
    a = polytope.units(rnd.normal(size=(5000, 64)))
    z = rnd.normal(size=a.shape)
    b = 0.9501 * a + math.sqrt(1 - 0.9501 ** 2) * polytope.units(z - (z * a).sum(1, keepdims=True) * a)
    for k in (2, 3):
        tables = polytope.tables_for(64, k)
        met = (tables.keys(a)[:, :, :, None] == tables.keys(b)[:, :, None, :]).any((1, 2, 3))
        assert met.mean() > 0.999


def test_tasks_compare_every_pair_but_those_of_a_ball(spark):
    """Blocks of one crowded bucket: every pair that shares no ball meets in exactly one task."""
    rows = [(1, i, 5 if i < 40 else 6 if i < 60 else -1 if i < 75 else 7) for i in range(80)] + [(2, i, -1) for i in range(6)]
    got = polytope.tasks_of(spark.createDataFrame(rows, "key long, node long, ball long"), 8).collect()
    meet = collections.Counter()
    tasks = collections.defaultdict(list)
    for r in got:
        for t in r["tasks"]:
            tasks[t["task"]].append((t["side"], r["key"], r["node"], r["ball"]))
    for members in tasks.values():
        two = len({m[0] for m in members}) > 1
        meet.update(frozenset([(a[1], a[2]), (b[1], b[2])]) for a in members for b in members if a < b and (a[0] != b[0] if two else True))
    ball = {(k, n): b for k, n, b in rows}
    same = lambda p: len({ball[x] for x in p}) == 1 and {ball[x] for x in p} <= {5, 6}
    want = {frozenset([x, y]) for x in ball for y in ball if x < y and x[0] == y[0]}
    assert {p for p in want if not same(p)} <= set(meet) and set(meet) <= want
    assert all(n == 1 for p, n in meet.items()) and not any(same(p) for p in meet)


def test_names(spark):
    assert {"op11_va_clusters", "op12_polytope_dedup", "op13_bounded_codes"} <= set(queries.ORACLES)
