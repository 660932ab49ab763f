"""Operator 7 — substring dedup with difference-cover anchors.

Two places that hold the same ``WINDOW`` words may lie at any two positions of their documents. The
places in ``COVER`` modulo ``PERIOD`` are chosen so that for any two positions some shift below the
period takes both into the cover. So hashing the runs of WINDOW - PERIOD + 1 words only at cover
positions is enough: every common window holds a hashed run that both documents share.

1. Anchors: the runs' hashes of every document, once per document.
2. Anchors that two documents share are looked up by hash, and returned to their documents.
3. Extension: only windows around a shared anchor are hashed whole, with 96 bits, and the smallest
   document that holds each of them is found.
4. Words covered by a window that a smaller document holds are removed.

Copies that meet in one batch of a task are settled there, so the shuffles of 2 and 3 carry a row per
batch and hash at most, however often a passage occurs. Texts are shuffled once, by document.

Defined results: null and empty texts have no words; rows that share a doc_id are one document to
each other (they remove nothing from each other); rows without doc_id take no part and keep all words; an empty table
gives no rows; other columns are left out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from pricemill.session import materialise

from .bytework import BASE_A, BASE_B, Rolling, mixed, rounds, run_starts, whole_groups, word_hashes, words
from .common import documents, sent_if_small

WINDOW = 50
# A perfect difference set, every difference modulo 31 occurs.
PERIOD, COVER = 31, (0, 1, 3, 8, 12, 18)
ANCHOR = WINDOW - PERIOD + 1
LONE, NOTE, SETTLED = 0, 1, 2  # needs an answer; only tells others; answered in its batch
SETTLED_BIT = 1 << 31


class Hasher:
    def __init__(self):
        self.by_byte, self.other = Rolling(BASE_A), Rolling(BASE_B)

    def read(self, data, offsets):
        """First word of every text, and prefix hashes over words of two kinds."""
        start, end, first = words(data, offsets)
        h = word_hashes(data, start, end, self.by_byte)
        return first, self.by_byte.prefix(h), self.other.prefix(mixed(h))

    def anchors(self, first, prefix):
        """Hash, text and word of the anchors."""
        at, text = run_starts(first, ANCHOR)
        inside = np.zeros(PERIOD, bool)
        inside[list(COVER)] = True
        keep = inside[(at - first[:-1][text]) % PERIOD]
        at, text = at[keep], text[keep]
        return self.by_byte.runs(prefix, at, at + ANCHOR), text, at


def _begins(*keys: np.ndarray) -> np.ndarray:
    """Where groups of equal keys begin in sorted rows."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _with_id(batches):
    """Batches without the rows that have no id."""
    for batch in batches:
        ids = batch.column("doc_id")
        yield batch.filter(pc.is_valid(ids)) if ids.null_count else batch


def _own_place(doc: np.ndarray, place: np.ndarray) -> pa.Array:
    """Places that differ from the id; null elsewhere, which costs no room in a shuffle."""
    return pa.array(place, mask=place == doc)


def _anchor_rows(batches):
    """(key, doc, place, state): one row per anchor hash and document; see LONE, NOTE and SETTLED."""
    hasher = Hasher()
    for batch in _with_id(batches):
        ids, places = batch.column("doc_id").to_numpy(), batch.column("place").to_numpy()
        hs, rows = [], []
        for i, j, data, offsets in rounds(batch.column("text")):
            first, prefix, _ = hasher.read(data, offsets)
            h, text, _ = hasher.anchors(first, prefix)
            hs.append(h)
            rows.append(text + i)
        if not hs:
            continue
        h, row = np.concatenate(hs).view(np.int64), np.concatenate(rows)
        doc, place = ids[row], places[row]
        order = np.lexsort((place, doc, h))
        one = order[_begins(h[order], doc[order], place[order])]
        h, doc, place = h[one], doc[one], place[one]
        group = _begins(h)
        size = np.diff(np.append(group, len(h)))
        some = (np.maximum.reduceat(doc, group) != np.minimum.reduceat(doc, group)) if len(h) else np.zeros(0, bool)
        several = np.repeat(some, size)
        pick = np.concatenate([np.flatnonzero(~several), group[some], np.flatnonzero(several)])
        state = np.repeat(np.array([LONE, NOTE, SETTLED], np.int8), [int((~several).sum()), int(some.sum()), int(several.sum())])
        yield pa.RecordBatch.from_pydict({"key": pa.array(h[pick]), "doc": pa.array(doc[pick]), "place": _own_place(doc[pick], place[pick]), "state": pa.array(state)})


def _shared_rows(batches):
    """(place, anchor) of anchors that two documents share; the rows of a key come together."""
    for batch in whole_groups(batches, lambda b: _begins(b.column("key").to_numpy())):
        key, doc, state = (batch.column(c).to_numpy() for c in ("key", "doc", "state"))
        settled = state == SETTLED
        rest = np.flatnonzero(~settled)
        group = _begins(key[rest])
        shared = np.zeros(0, bool)
        if len(rest):
            most, least = np.maximum.reduceat(doc[rest], group), np.minimum.reduceat(doc[rest], group)
            told = np.maximum.reduceat(state[rest], group) == NOTE
            shared = np.repeat((most != least) | told, np.diff(np.append(group, len(rest)))) & (state[rest] == LONE)
        out = np.concatenate([np.flatnonzero(settled), rest[shared]])
        yield pa.RecordBatch.from_pydict({"place": pc.coalesce(batch.column("place"), batch.column("doc")).take(pa.array(out)), "anchor": pa.array(key[out])})


def shared_anchors(docs: DataFrame) -> DataFrame:
    """place and the anchor hashes that another document has too."""
    rows = docs.mapInArrow(_anchor_rows, "key long, doc long, place long, state byte")
    # A hash has at most one row per batch, and those settled there go anywhere.
    dealt = rows.repartition(F.when(F.col("state") == SETTLED, F.xxhash64("doc")).otherwise(F.col("key"))).sortWithinPartitions("key")
    shared = dealt.mapInArrow(_shared_rows, "place long, anchor long")
    return shared.groupBy("place").agg(F.collect_list("anchor").alias("anchors"))


def _window_rows(batches):
    """(key, rest, doc, place): windows around shared anchors, and settled ones as runs of window starts.

    ``rest`` holds 32 bits more of a window's hash, or the length of a settled run; then one bit that
    tells which; then the window's first word.
    """
    hasher = Hasher()
    for batch in _with_id(batches):
        ids, places = batch.column("doc_id").to_numpy(), batch.column("place").to_numpy()
        parts = []
        for i, j, data, offsets in rounds(batch.column("text")):
            first, prefix, second = hasher.read(data, offsets)
            h, text, at = hasher.anchors(first, prefix)
            lists = batch.column("anchors").slice(i, j - i)
            marked = lists.flatten().to_numpy()
            owner = np.repeat(np.arange(j - i), np.diff(lists.offsets.to_numpy()))
            hit = np.isin(mixed(h ^ mixed(text.astype(np.uint64))), mixed(marked.view(np.uint64) ^ mixed(owner.astype(np.uint64))))
            # A window around a shared anchor starts at most PERIOD - 1 words before it.
            step = np.zeros(first[-1] + 2, np.int64)
            low = np.maximum(at[hit] - PERIOD + 1, first[:-1][text[hit]])
            np.add.at(step, low, 1)
            np.add.at(step, at[hit] + 1, -1)
            start, owner = run_starts(first, WINDOW)
            keep = np.cumsum(step)[start] > 0
            start, owner = start[keep], owner[keep]
            parts.append((hasher.by_byte.runs(prefix, start, start + WINDOW), hasher.other.runs(second, start, start + WINDOW),
                          owner + i, start - first[:-1][owner]))
        if not parts:
            continue
        h1, h2, row, at = (np.concatenate(x) for x in zip(*parts))
        h2 >>= np.uint64(32)
        order = np.lexsort((at, row, h2, h1))
        h1, h2, row, at = h1[order], h2[order], row[order], at[order].astype(np.uint64)
        doc, place = ids[row], places[row]
        if not len(h1):
            continue
        group = _begins(h1, h2)
        least = np.repeat(np.minimum.reduceat(doc, group), np.diff(np.append(group, len(h1))))
        open_, told = np.flatnonzero(doc == least), np.flatnonzero(doc > least)
        told = told[np.lexsort((at[told], row[told]))]
        a = at[told]
        head = _begins(row[told], a - np.arange(len(a), dtype=np.uint64))
        length = np.diff(np.append(head, len(a))).astype(np.uint64)
        out = np.concatenate([open_, told[head]])
        rest = np.concatenate([(h2[open_] << np.uint64(32)) | at[open_], (length << np.uint64(32)) | np.uint64(SETTLED_BIT) | a[head]])
        yield pa.RecordBatch.from_pydict({
            "key": pa.array(np.concatenate([h1[open_], np.zeros(len(head), np.uint64)]).view(np.int64)), "rest": pa.array(rest.view(np.int64)),
            "doc": pa.array(doc[out]), "place": _own_place(doc[out], place[out])})


def _later_rows(batches):
    """(place, at, runs) of windows that a smaller document holds; the rows of a hash come together."""
    def hashes(batch):
        return batch.column("key").to_numpy(), batch.column("rest").to_numpy() >> 32

    for batch in whole_groups(batches, lambda b: _begins(*hashes(b))):
        key, high = hashes(batch)
        rest, doc = batch.column("rest").to_numpy(), batch.column("doc").to_numpy()
        settled = (rest & SETTLED_BIT) != 0
        own = np.flatnonzero(~settled)
        group = _begins(key[own], high[own])
        later = np.zeros(0, np.int64)
        if len(own):
            least = np.repeat(np.minimum.reduceat(doc[own], group), np.diff(np.append(group, len(own))))
            later = own[doc[own] > least]
        told = np.flatnonzero(settled)
        out = np.concatenate([told, later])
        yield pa.RecordBatch.from_pydict({
            "place": pc.coalesce(batch.column("place"), batch.column("doc")).take(pa.array(out)), "at": pa.array((rest[out] & (SETTLED_BIT - 1)).astype(np.int32)),
            "runs": pa.array(np.concatenate([high[told], np.ones(len(later), np.int64)]).astype(np.int32))})


def _kept(batches):
    """n_words, n_removed and the digest of the kept words of every row."""
    for batch in batches:
        n_words, n_removed, digest = [], [], []
        for text, runs in zip(batch.column("text"), batch.column("removed")):
            all_ = (text.as_py() or "").encode().split()  # bytes split at the six ASCII blanks
            runs = runs.as_py()
            if runs:
                gone = np.zeros(len(all_) + 1, np.int64)
                for r in runs:
                    gone[r["at"]] += 1
                    gone[min(r["at"] + r["runs"] - 1 + WINDOW, len(all_))] -= 1
                keep = np.cumsum(gone)[:-1] == 0
                kept = [w for w, k in zip(all_, keep.tolist()) if k]
            else:
                kept = all_
            n_words.append(len(all_))
            n_removed.append(len(all_) - len(kept))
            digest.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_words": pa.array(n_words, pa.int64()),
                                          "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digest, pa.string())})


def repeated_runs(keyed: DataFrame) -> DataFrame:
    """place and ``removed``: runs (at, runs) of window starts that a smaller document holds too."""
    near = keyed.join(shared_anchors(keyed), "place")
    rows = near.mapInArrow(_window_rows, "key long, rest long, doc long, place long")
    settled = F.col("rest").bitwiseAND(SETTLED_BIT) != 0
    dealt = rows.repartition(F.when(settled, F.xxhash64("doc", "rest")).otherwise(F.col("key"))).sortWithinPartitions("key", "rest")
    later = dealt.mapInArrow(_later_rows, "place long, at int, runs int")
    return later.groupBy("place").agg(F.collect_list(F.struct("at", "runs")).alias("removed"))


def dedup(docs: DataFrame) -> DataFrame:
    """n_words, n_removed and kept_sha256 of every document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    twice = materialise(docs.groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("twice")), "repeated-ids")
    # Where a row is looked up again: by its id; by id and text where an id has several rows; rows without id only by text.
    # It is written so that it can't be null: else a join would filter its side, and the texts be shuffled twice.
    place = F.coalesce(F.col("doc_id"), F.xxhash64("text"))
    if not twice.isEmpty():
        docs = docs.join(sent_if_small(twice, 16), F.col("doc_id") == F.col("twice"), "left")
        place = F.coalesce(F.when(F.col("twice").isNull(), F.col("doc_id")), F.xxhash64("doc_id", "text"))
    docs = docs.select("doc_id", "text", place.alias("place"))
    keyed = docs.repartition("place")  # one shuffle of the texts serves both joins by document
    marked = keyed.join(repeated_runs(keyed), "place", "left")
    return marked.select("doc_id", "text", F.when(F.col("doc_id").isNotNull(), F.col("removed")).alias("removed")).mapInArrow(
        _kept, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of every document without passages of an earlier one."""
    return dedup(documents(spark, sf_dir).select("doc_id", "text"))


OP7_SQL = """
WITH cut AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
windows AS (SELECT doc_id, i, sha256(array_to_string(words[i + 1:i + 50], ' ')) AS h
  FROM (SELECT doc_id, words, unnest(range(len(words) - 49)) AS i FROM cut WHERE len(words) >= 50)),
firsts AS (SELECT h, min(doc_id) AS least FROM windows GROUP BY h),
covered AS (SELECT DISTINCT doc_id, i + k + 1 AS place FROM windows JOIN firsts USING (h), range(50) t(k) WHERE least < doc_id),
placed AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM cut),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS text, count(*) AS n FROM placed ANTI JOIN covered USING (doc_id, place) GROUP BY doc_id)
SELECT cut.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM cut LEFT JOIN kept ON kept.doc_id = cut.doc_id
"""
