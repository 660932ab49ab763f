"""Operator 2 — n-gram Jaccard join as a blocked sparse matrix product.

Rows of the matrix are documents, columns the hashes of their distinct word n-grams. Two documents
link when their overlap is at least ``SHARE`` percent of their union.

1. Documents with the same set of n-grams are one row: the one with the smallest id stands for all.
2. Column blocks: sets that link differ in at most 1 / 19 of their sizes' sum (for 90 percent). The
   columns are dealt into blocks by hash, so many that linked sets agree on a whole block that isn't empty:
   the chance that they don't is below exp(-SURE) per pair at the very bound, as small as that of a
   collision of hashes. Sizes are cut into classes; a set shows the contents of its blocks to its own class and to the
   next ones, and sets that show the same content are candidates. A block of many n-grams must agree as a
   whole, so frequent n-grams and passages alone make few candidates.
   Where these components grow large, as passages in many texts chain them, they are cut: linked sets share one of the rarest
   n-grams of each, as many as a linked set may lack and one more, and n-grams that are frequent in the component count as the least rare.
3. Row blocks: components of the candidates bound where links can be. Inside one, the product of the
   document by n-gram incidence with its transpose accumulates exact overlap counts, block of rows by block
   of rows; pairs below the bound that their sizes set are discarded. Every block leaves a spanning
   forest of its links, so the output is linear in the documents and no link between components is lost. In a cluster
   of many blocks all members are compared with two hubs first; members that the hubs connect aren't compared with one another.
4. Components of the links are the classes.

Copies within a batch of a task are joined there, so the shuffle of 2 carries at most a row per batch and content.

Defined results: null and empty texts, and texts without words, have no n-grams and link with nothing;
a text of fewer words than ``N`` has one n-gram, all its words; rows that share a doc_id are one node with links of all of them;
a null doc_id links with nothing and has no component; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from pricemill.session import materialise

from .bytework import BASE_A, BASE_B, SMALL, Rolling, mixed, rounds, run_starts, tidy, word_hashes, words
from .common import BROADCAST_BYTES, Sieve, documents, held_by, sent_if_small, without
from .graph import components

N, SHARE = 3, 90
SURE = 28.0
# A task of the product holds at most about so many n-grams and documents on either side.
TASK_GRAMS, TASK_DOCS = 2_000_000, 1_500
# Counters (a power of 2) behind the order of n-grams in large clusters; any counts give the same links.
COUNTERS = 1 << 21


class Grams:
    """Distinct n-gram hashes of texts."""

    def __init__(self, n: int):
        self.n, self.by_byte, self.by_word = n, Rolling(BASE_A), Rolling(BASE_B)

    def sets(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct hashes of all texts in a row, and the bounds of each text's."""
        data = SMALL[data]
        start, end, first = words(data, offsets)
        prefix = self.by_word.prefix(word_hashes(data, start, end, self.by_byte))
        at, text = run_starts(first, self.n)
        size = np.diff(first)
        short = np.flatnonzero((size > 0) & (size < self.n))
        begin = np.concatenate([at, first[short]])
        h = self.by_word.runs(prefix, begin, np.concatenate([at + self.n, first[short + 1]]))
        text = np.concatenate([text, short])
        order = np.lexsort((h, text))
        h, text = h[order], text[order]
        new = np.append(True, (h[1:] != h[:-1]) | (text[1:] != text[:-1])) if len(h) else np.zeros(0, bool)
        h, text = h[new], text[new]
        return h, np.searchsorted(text, np.arange(len(offsets)))


def set_marks(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that are equal for equal sets only."""
    marks = []
    for salt in (0, 0x9E37):
        run = np.append(np.zeros(1, np.uint64), np.cumsum(mixed(h ^ np.uint64(salt)), dtype=np.uint64))
        marks.append(mixed(run[bounds[1:]] - run[bounds[:-1]]).view(np.int64))
    return marks[0], marks[1]


def size_classes(most: int, share: int = SHARE) -> np.ndarray:
    """Smallest sizes of classes such that sizes of linked sets lie in one class or in neighbouring ones."""
    out = [1]
    while out[-1] <= most:
        out.append(100 * out[-1] // share + 1)
    return np.array(out + [100 * out[-1] // share + 1, 100 * (100 * out[-1] // share + 1) // share + 1])


def blocks_of(smallest: int, largest: int, share: int = SHARE) -> int:
    """Blocks for sets of ``smallest`` to ``largest`` n-grams: the fewest for which linked sets surely agree on one.

    ``differ`` n-grams of two sets at the bound and ``common`` ones fall on blocks at random. All blocks with
    common n-grams are hit by a differing one with probability at most exp(-SURE).
    """
    def sure(n: int, k: int) -> float:
        differ, common = 2 * n * (100 - share) // (100 + share), 2 * n * share // (100 + share)
        if not differ or not common:
            return math.inf
        return -k * -math.expm1(-common / k) * math.log(-math.expm1(-differ / k))

    k = 1
    while min(sure(smallest, k), sure(largest, k)) < SURE:
        k += max(1, k // 20)
    return k


def shown_blocks(h: np.ndarray, bounds: np.ndarray, share: int = SHARE) -> tuple[np.ndarray, np.ndarray]:
    """(key, text): hash of (class pair, block, content) for every block that a set shows."""
    size = np.diff(bounds)
    if not len(h):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    edges = size_classes(int(size.max()), share)
    class_ = np.searchsorted(edges, size, "right") - 1
    value = np.append(np.zeros(1, np.uint64), np.cumsum(mixed(h ^ np.uint64(0x5EED)), dtype=np.uint64))
    top = int(class_.max()) + 1
    count = np.array([blocks_of(int(edges[c]), int(edges[c + 2]) - 1, share) for c in range(top)])
    keys, owners = [], []
    for step in (-1, 0):  # with the class below, with the class above
        pair = class_ + step
        use = np.flatnonzero((size > 0) & (pair >= 0))
        if not len(use):
            continue
        k = count[pair[use]]
        begin = np.append(0, np.cumsum(k))
        # Blocks are ranges of the hash, so each is a run of the sorted set.
        lengths = size[use]
        flat = np.repeat(bounds[:-1][use] - np.append(0, np.cumsum(lengths))[:-1], lengths) + np.arange(lengths.sum())
        row = np.repeat(np.arange(len(use)), lengths)
        block = (((h[flat] >> np.uint64(32)) * k[row].astype(np.uint64)) >> np.uint64(32)).astype(np.int64) + begin[row]
        held = np.bincount(block, minlength=begin[-1])
        owner = np.repeat(np.arange(len(use)), k)
        stop = np.cumsum(held) - np.repeat(np.append(0, np.cumsum(lengths))[:-1], k) + np.repeat(bounds[:-1][use], k)
        content = value[stop] - value[stop - held]
        show = held > 0
        place = (np.arange(begin[-1]) - begin[owner]).astype(np.uint64)
        key = mixed(content ^ mixed(place ^ (pair[use][owner].astype(np.uint64) << np.uint64(32))))
        keys.append(key[show])
        owners.append(use[owner[show]])
    return (np.concatenate(keys), np.concatenate(owners)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _marks(n: int):
    def run(batches):
        grams = Grams(n)
        for batch in batches:
            ids = batch.column("doc_id")
            for i, j, data, offsets in rounds(batch.column("text")):
                h, bounds = grams.sets(data, offsets)
                a, b = set_marks(h, bounds)
                yield pa.RecordBatch.from_pydict({"doc_id": ids.slice(i, j - i), "n": pa.array(np.diff(bounds)), "m1": pa.array(a), "m2": pa.array(b)})
        tidy()
    return run


def _shown(n: int, share: int):
    """(key, doc, peer): contents to be matched, and edges to a peer for those matched in the batch."""
    def run(batches):
        grams = Grams(n)
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            keys, docs = [], []
            for i, j, data, offsets in rounds(batch.column("text")):
                h, bounds = grams.sets(data, offsets)
                a, b = set_marks(h, bounds)
                order = np.lexsort((ids[i:j], b, a))
                one = np.zeros(j - i, bool)
                one[order[np.append(True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1]))]] = True
                key, text = shown_blocks(h, bounds, share)
                keep = one[text]
                keys.append(key[keep])
                docs.append(ids[i:j][text[keep]])
            yield from _matched(keys, docs)
            tidy()
    return run


def _matched(keys: list[np.ndarray], docs: list[np.ndarray]):
    """(key, doc, peer) of a batch: of equal keys the one with the least doc stays, the others are edges to it."""
    if not sum(map(len, keys)):
        return
    key, doc = np.concatenate(keys).view(np.int64), np.concatenate(docs)
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    group = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    least = np.repeat(doc[group], np.diff(np.append(group, len(key))))
    pair = np.unique(np.stack([doc[doc > least], least[doc > least]], 1), axis=0)
    salt = mixed(pair[:, 0].astype(np.uint64) ^ mixed(pair[:, 1].astype(np.uint64))).view(np.int64)
    yield pa.RecordBatch.from_pydict({
        "key": pa.array(np.concatenate([key[group], salt])), "doc": pa.array(np.concatenate([doc[group], pair[:, 0]])),
        "peer": pa.concat_arrays([pa.nulls(len(group), pa.int64()), pa.array(pair[:, 1])])})


def _in_cluster(h: np.ndarray, bounds: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    """A hash of every n-gram and its text's cluster."""
    return mixed(h ^ np.repeat(mixed(cluster.astype(np.uint64)), np.diff(bounds)))


def _counter(key: np.ndarray) -> np.ndarray:
    return (key >> np.uint64(33)).astype(np.int64) % COUNTERS


def _counted(n: int):
    """(counter, n): how many sets of the task hold n-grams that fall on a counter."""
    def run(batches):
        grams, counts = Grams(n), np.zeros(COUNTERS, np.int32)
        for batch in batches:
            cluster = batch.column("cluster").to_numpy()
            for i, j, data, offsets in rounds(batch.column("text")):
                h, bounds = grams.sets(data, offsets)
                counts += np.bincount(_counter(_in_cluster(h, bounds, cluster[i:j])), minlength=COUNTERS).astype(np.int32)
        used = np.flatnonzero(counts)
        for k in range(0, len(used), 1 << 16):
            yield pa.RecordBatch.from_pydict({"counter": pa.array(used[k:k + (1 << 16)].astype(np.int32)), "n": pa.array(counts[used[k:k + (1 << 16)]].astype(np.int64))})
        tidy()
    return run


def rarest(key: np.ndarray, bounds: np.ndarray, counts: np.ndarray, share: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, text): of every set the keys lowest in the order of their counts, such that linked sets share one of them.

    A linked set lacks at most size - share * size keys of the other's, so the first key that two have in common has at most so many
    before it in either set.
    """
    size = np.diff(bounds)
    text = np.repeat(np.arange(len(size)), size)
    order = np.lexsort((key, counts[_counter(key)], text))
    first = (np.arange(len(key)) - np.repeat(bounds[:-1], size))[np.argsort(order, kind="stable")] <= (size + -share * size // 100)[text]
    return key[first], text[first]


def _rarest(n: int, share: int, counts):
    """(key, doc, peer) of the rarest n-grams."""
    def run(batches):
        grams = Grams(n)
        for batch in batches:
            ids, cluster = batch.column("doc_id").to_numpy(), batch.column("cluster").to_numpy()
            keys, docs = [], []
            for i, j, data, offsets in rounds(batch.column("text")):
                h, bounds = grams.sets(data, offsets)
                key, text = rarest(_in_cluster(h, bounds, cluster[i:j]), bounds, counts.value, share)
                keys.append(key)
                docs.append(ids[i:j][text])
            yield from _matched(keys, docs)
            tidy()
    return run


def _sets(n: int):
    def run(batches):
        grams = Grams(n)
        for batch in batches:
            for i, j, data, offsets in rounds(batch.column("text")):
                h, bounds = grams.sets(data, offsets)
                values = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((bounds * 8).astype(np.int32)), pa.py_buffer(h)])
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(i, j - i), "tasks": batch.column("tasks").slice(i, j - i), "grams": values})
        tidy()
    return run


def overlaps(sets: list[np.ndarray], left: int) -> np.ndarray:
    """Overlap counts of rows [0, left) with the rest, or of all rows if ``left`` is 0, by column blocks."""
    m = len(sets)
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = times[column] > 1  # an n-gram of one document adds to no overlap
    number = np.cumsum(times > 1) - 1
    row, column = row[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = max(64, 4_000_000 // m)
    out = np.zeros((left or m, m - left if left else m), np.float32)
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [c, c + width])
        part = np.zeros((m, min(width, int(column[-1]) + 1 - c)), np.float32)
        part[row[lo:hi], column[lo:hi] - c] = 1
        out += part[:left] @ part[left:].T if left else part @ part.T
    return out


def _links(share: int):
    """(a, b): a spanning forest of the links of every task."""
    def linked(docs: list, sides: list, sets: list):
        m, left = len(docs), sides.count(0) if 1 in sides else 0
        if m < 2 or (1 in sides and not left):
            return
        size = np.array([len(s) for s in sets], np.float64)
        both = overlaps(sets, left)
        a, b = (size[:left, None], size[None, left:]) if left else (size[:, None], size[None, :])
        hit = 100 * both >= share * (a + b - both)
        adjacent = np.zeros((m, m), bool)
        if left:
            adjacent[:left, left:], adjacent[left:, :left] = hit, hit.T
        else:
            adjacent = hit
        root = np.arange(m)
        while True:
            new = np.minimum(root, np.where(adjacent, root[None, :], m).min(1))
            new = new[new]
            if (new == root).all():
                break
            root = new
        for i in np.flatnonzero(root != np.arange(m)):
            yield docs[i], docs[root[i]]

    def run(batches):
        task, docs, sides, sets, out = None, [], [], [], []

        def flush():
            out.extend(linked(docs, sides, sets))
            docs.clear(), sides.clear(), sets.clear()

        for batch in batches:
            for t, s, d, g in zip(batch.column("task").to_pylist(), batch.column("side").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("grams")):
                if t != task:
                    flush()
                    task = t
                docs.append(d), sides.append(s), sets.append(np.frombuffer(g.as_buffer(), np.uint64).copy())
            if out:
                yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})
                out = []
        flush()
        tidy()
        yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})
    return run


def _parts(task_grams: int, task_docs: int) -> Column:
    """Tasks that the rows of a group fill."""
    return F.greatest(F.ceil(F.sum("n") / task_grams), F.ceil(F.count(F.lit(1)) / task_docs)).cast("int")


def hub_tasks(members: DataFrame, task_grams: int = TASK_GRAMS, task_docs: int = TASK_DOCS) -> DataFrame:
    """doc_id and ``tasks`` (task, side) that compare every member of a large cluster with the cluster's hubs.

    A cluster has two hubs, drawn by hash. A hub goes to every row block, any other member to one: linear in the members.
    """
    order = F.struct(F.xxhash64("doc_id", F.lit(7)).alias("h"), "doc_id")
    large = members.groupBy("cluster").agg(_parts(task_grams, task_docs).alias("parts"), F.min(order).alias("_low"), F.max(order).alias("_high")).filter("parts > 1")
    # Written, so that the join meets a plain table: sent if it is small, else a hot cluster's side can be split.
    large = materialise(large, "large-clusters")
    placed = members.join(sent_if_small(large, 64), "cluster").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
    at = lambda block, side: F.struct(F.xxhash64(F.col("cluster"), block, F.lit(-2)).alias("task"), F.lit(side).alias("side"))
    hub = (F.col("doc_id") == F.col("_low.doc_id")) | (F.col("doc_id") == F.col("_high.doc_id"))
    every = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: at(j, 0))
    own = F.array(at(F.col("block"), 1))
    return placed.select("doc_id", F.when(hub, F.concat(every, own)).otherwise(own).alias("tasks"))


def product_tasks(members: DataFrame, share: int = SHARE, task_grams: int = TASK_GRAMS, task_docs: int = TASK_DOCS) -> DataFrame:
    """doc_id and ``tasks`` (task, side) of ``members`` (doc_id, cluster, n, core).

    A small cluster is one task. A large one is cut by size bands — linked sizes lie in one band or in neighbours — and each
    band into row blocks, those of the core (members known to be of one component) apart from those of the rest; every two row blocks
    that can hold links are a task, but for two of the core.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / -float(np.log(share / 100 - 0.005))).cast("int")
    banded = members.withColumn("band", band)
    whole = banded.groupBy("cluster").agg(F.count(F.lit(1)).alias("docs"), _parts(task_grams, task_docs).alias("parts")).filter("docs > 1").drop("docs")
    cut = banded.groupBy("cluster", "band", "core").agg(_parts(task_grams, task_docs).alias("blocks"))
    both = cut.groupBy("cluster", "band").agg(F.max(F.when(~F.col("core"), F.col("blocks"))).alias("rest"), F.max(F.when(F.col("core"), F.col("blocks"))).alias("cores"))
    whole, both = materialise(whole, "clusters"), materialise(both, "bands")
    near = lambda step, name: both.select("cluster", (F.col("band") + step).alias("band"), F.struct("rest", "cores").alias(name))
    sized = banded.join(sent_if_small(whole, 24), "cluster")
    for step, name in ((0, "here"), (1, "below"), (-1, "above")):
        sized = sized.join(sent_if_small(near(step, name), 32), ["cluster", "band"], "left")
    block = F.pmod(F.xxhash64("doc_id"), F.when(F.col("core"), F.col("here.cores")).otherwise(F.col("here.rest"))).cast("int")
    me = F.struct("band", "core", "block")

    def blocks(name: str, step: int, core: bool) -> Column:
        n = F.coalesce(F.col(f"{name}.{'cores' if core else 'rest'}"), F.lit(0))
        numbers = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(numbers, lambda j: F.struct((F.col("band") + step).alias("band"), F.lit(core).alias("core"), j.alias("block")))

    def task(other: Column) -> Column:
        low, high = F.least(me, other), F.greatest(me, other)
        return F.struct(F.xxhash64(F.col("cluster"), low.band, low.core, low.block, high.band, high.core, high.block).alias("task"),
                        F.when(me <= other, 0).otherwise(1).alias("side"))

    around = (("here", 0), ("below", -1), ("above", 1))
    rest = F.concat(*[blocks(name, step, False) for name, step in around])
    cores = F.concat(*[blocks(name, step, True) for name, step in around])
    meets = F.when(F.col("core"), rest).otherwise(F.concat(rest, cores))
    one = F.array(F.struct(F.xxhash64(F.col("cluster"), F.lit(-1)).alias("task"), F.lit(0).alias("side")))
    return sized.withColumn("block", block).select("doc_id", F.when(F.col("parts") <= 1, one).otherwise(F.transform(meets, task)).alias("tasks"))


def _edges(shown: DataFrame) -> DataFrame:
    """(a, b) such that documents that show the same content are connected; at most a row per batch and content comes together."""
    shown = shown.withColumn("settled", F.col("peer").isNotNull())
    return shown.withColumn("least", F.min("doc").over(Window.partitionBy("key", "settled"))).select(
        F.col("doc").alias("a"), F.coalesce("peer", "least").alias("b")).filter("a <> b").distinct()


def narrowed(docs: DataFrame, members: DataFrame, n: int, share: int, task_grams: int = TASK_GRAMS, task_docs: int = TASK_DOCS) -> DataFrame:
    """``members`` (doc_id, cluster, n) with large clusters cut where no link can be, and without members that have no link.

    Every round counts the n-grams inside the clusters that are large still, so that what chains a cluster in one round is put
    last in the next. The counts only order: whatever they are, every link stays inside a cluster. Rounds end when they no longer help.
    """
    before = None
    while True:
        large = materialise(members.groupBy("cluster").agg(_parts(task_grams, task_docs).alias("parts")).filter("parts > 1").select("cluster"), "clusters-to-cut")
        inside = materialise(members.join(sent_if_small(large, 16), "cluster").select("doc_id", "cluster"), "members-to-cut")
        left = inside.count()
        if not left or before is not None and 4 * left > 3 * before:
            return members
        before = left
        texts = held_by(docs, inside, 24)
        total = texts.mapInArrow(_counted(n), "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros(COUNTERS, np.int64)
        counts[total["counter"].to_numpy()] = total["n"].to_numpy()
        shown = texts.mapInArrow(_rarest(n, share, docs.sparkSession.sparkContext.broadcast(counts)), "key long, doc long, peer long")
        label = components(_edges(shown), "narrowed").withColumnsRenamed({"node": "doc_id", "root": "cluster"})
        cut = members.join(sent_if_small(large, 16), "cluster", "left_semi").select("doc_id", "n").join(label, "doc_id").select("doc_id", "cluster", "n")
        members = materialise(members.join(sent_if_small(large, 16), "cluster", "left_anti").select("doc_id", "cluster", "n").union(cut), "members")


def cluster_links(docs: DataFrame, members: DataFrame, n: int, share: int, **task) -> DataFrame:
    """(a, b): edges that connect whatever links connect inside each of the clusters of ``members`` (doc_id, cluster, n).

    The members of a large cluster are first compared with its hubs alone. The largest component that this finds is
    the cluster's core; after that only what is outside the core is compared, with the core and with itself. So a family of near copies
    costs as much as it has members, and only members far from the hubs cost more.
    """
    def linked(tasks: DataFrame, purpose: str) -> DataFrame:
        sets = held_by(docs, tasks, 80).mapInArrow(_sets(n), "doc_id long, tasks array<struct<task:long,side:int>>, grams binary")
        dealt = sets.select("doc_id", "grams", F.explode("tasks").alias("t")).select("t.task", "t.side", "doc_id", "grams")
        return materialise(dealt.repartition("task").sortWithinPartitions("task", "side", "doc_id").mapInArrow(_links(share), "a long, b long"), purpose)

    first = materialise(hub_tasks(members, **task), "hub-tasks")
    if first.isEmpty():
        return linked(materialise(product_tasks(members.withColumn("core", F.lit(False)), share, **task), "product-tasks"), "links")
    near = linked(first, "hub-links")
    label = components(near, "hub-components").select(F.col("node").alias("doc_id"), "root")
    sizes = members.join(label, "doc_id").groupBy("cluster", "root").agg(F.count(F.lit(1)).alias("size"))
    core = materialise(sizes.groupBy("cluster").agg(F.max(F.struct("size", "root")).alias("c")).select(F.col("c.root").alias("root"), F.lit(True).alias("core")), "cores")
    marked = members.join(label.join(sent_if_small(core, 16), "root").select("doc_id", "core"), "doc_id", "left").withColumn("core", F.coalesce("core", F.lit(False)))
    tasks = materialise(product_tasks(materialise(marked, "marked-members"), share, **task), "product-tasks")
    return linked(tasks.filter(F.size("tasks") > 0), "links").union(near)


def join_components(docs: DataFrame, n: int = N, share: int = SHARE, **task) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marks = materialise(docs.mapInArrow(_marks(n), "doc_id long, n long, m1 long, m2 long"), "gram-marks")
    real = marks.filter("n > 0 and doc_id is not null")
    first = materialise(real.groupBy("m1", "m2").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n")), "gram-sets")
    keyed = docs.filter("doc_id is not null")
    # Where many documents are copies, those that stand for a set show its blocks, and few others do.
    many = 16 * first.count() < 15 * real.count()
    showing = Sieve(first.select(F.col("rep").alias("doc_id")), "doc_id").passed(keyed) if many else keyed
    shown = showing.mapInArrow(_shown(n, share), "key long, doc long, peer long")
    clusters = components(_edges(shown), "candidates")
    members = clusters.join(first.select(F.col("rep").alias("node"), "n"), "node").select(F.col("node").alias("doc_id"), F.col("root").alias("cluster"), "n")
    members = narrowed(keyed, materialise(members, "members"), n, share, **task)
    links = cluster_links(keyed, members, n, share, **task)
    # Rows of one id that hold several sets make these sets one node.
    reps = real.join(first.select("m1", "m2", "rep"), ["m1", "m2"]).select("doc_id", "rep")
    same = reps.groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low <> high")
    more = reps.join(same.select("doc_id"), "doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    found = components(materialise(links.union(more), "links"), "links")
    owner = reps.join(found.select(F.col("node").alias("rep"), "root"), "rep", "left").groupBy("doc_id").agg(F.min(F.coalesce("root", "rep")).alias("component_id"))
    return marks.join(owner, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def row_numbers(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_row``, a number that no two rows share: the id where it is the only one, a free number otherwise.

    Rows whose id repeats, or is null, are written down once with their numbers; the rest isn't copied. Where so many ids repeat that
    they can't be sent to the tasks, all rows are.
    """
    ids = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    twice = materialise(ids.filter("n > 1 and doc_id is not null").select("doc_id"), "repeated-ids")
    if 32 * twice.count() > BROADCAST_BYTES:
        return materialise(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    sent = F.broadcast(twice)
    odd = docs.join(sent, "doc_id", "left_semi").unionByName(docs.filter("doc_id is null"))
    placed = materialise(odd.withColumn("_nth", F.monotonically_increasing_id()), "numbered-rows")
    most = placed.agg(F.max("_nth")).first()[0]
    plain = docs.filter("doc_id is not null").join(sent, "doc_id", "left_anti").select("*", F.col("doc_id").cast("long").alias("_row"))
    if most is None:
        return plain
    start = -1 - most
    while not docs.filter(F.col("doc_id").between(start, start + most)).isEmpty():  # numbers that are ids already
        start = -(1 << 63) + (start * 0x9E3779B97F4A7C15 + 1) % ((1 << 64) - most - 1)
    return plain.unionByName(placed.select(*docs.columns, (F.lit(start) + F.col("_nth")).alias("_row")))


def keep_one(docs: DataFrame, n: int = N, share: int = SHARE) -> DataFrame:
    """``docs`` with one row of every component: the one with the smallest id; a row without id only where no row has one.

    A row is judged by its own text. Rows that share an id but not their texts are documents of their own: each goes only
    if its own text has a near copy that is kept. Texts without a word link with nothing and stay, also where they repeat.
    """
    numbered = row_numbers(docs)
    classes = join_components(numbered.select(F.col("_row").alias("doc_id"), "text"), n, share).select(F.col("doc_id").alias("_row"), "component_id")
    whole = materialise(classes, "row-classes")
    several = whole.groupBy("component_id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("component_id")
    placed = whole.join(several, "component_id").join(numbered.select("_row", "doc_id"), "_row")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_row")
    kept = materialise(placed.groupBy("component_id").agg(F.min(order).alias("k")).select(F.col("k._row").alias("_row")), "kept-rows")
    gone = materialise(whole.join(several, "component_id", "left_semi").join(kept, "_row", "left_anti").select("_row"), "copies")
    return without(numbered, gone, whole.select("_row"), "_row", 16).select(*docs.columns)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle count and near-duplicate component of every document."""
    return join_components(documents(spark, sf_dir))


OP2_SQL = """
WITH RECURSIVE cut AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
grams AS (SELECT DISTINCT doc_id, array_to_string(words[i + 1:i + 3], ' ') AS gram
  FROM (SELECT doc_id, words, unnest(range(greatest(len(words) - 2, 1))) AS i FROM cut WHERE len(words) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
links AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM grams x JOIN grams y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b WHERE 100 * common >= 90 * (s.n + t.n - common)),
reach AS (SELECT DISTINCT a AS node, a AS root FROM links UNION SELECT b, root FROM reach JOIN links ON a = node WHERE root < b),
least AS (SELECT node, min(root) AS root FROM reach GROUP BY node)
SELECT cut.doc_id, coalesce(sizes.n, 0)::BIGINT AS n_shingles, coalesce(least.root, cut.doc_id) AS component_id
FROM cut LEFT JOIN sizes ON sizes.doc_id = cut.doc_id LEFT JOIN least ON least.node = cut.doc_id
"""
