"""Operator 3 — document fingerprints by one-permutation MinHash.

The hashes of a text's five-word shingles are dealt once into ``BINS`` bins by their upper bits, and
each bin keeps its smallest hash. An empty bin borrows from a full one by optimal densification:
bin i asks the bins in a random order of its own, the same for all texts, and takes the first full
one. The low ``BITS`` bits of every bin, stirred with its number, are packed into one hex digit. Two fingerprints agree in a digit with
probability J + (1 - J) / 2 ** BITS, so the share of equal digits, corrected for that chance,
estimates the Jaccard similarity J of the shingle sets.

A text of fewer than five words is one shingle; the empty text and null have no shingle and the
fingerprint of zeros; equal texts have equal fingerprints; repeated rows follow each other in the order of ids, then of texts;
an empty table gives no rows; ``fingerprint`` replaces a column of that name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .bytework import BASE_A, BASE_B, Rolling, mixed, rounds, run_starts, word_hashes, words
from .common import documents

SHINGLE, BINS, BITS = 5, 256, 4
# Text that one range of neighbouring ids holds, and the most ranges: their ends are known to the driver.
RANGE_BYTES, MOST_RANGES = 8 << 20, 20_000


def bin_orders(bins: int = BINS) -> np.ndarray:
    """For every bin, the order in which it asks the others when it is empty: one fixed random order each."""
    grid = mixed(np.arange(bins * bins, dtype=np.uint64) + np.uint64(0x51ED)).reshape(bins, bins)
    return np.argsort(grid, axis=1, kind="stable")


class Sketcher:
    def __init__(self):
        self.by_byte, self.by_word, self.orders = Rolling(BASE_A), Rolling(BASE_B), bin_orders()

    def shingles(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash and text number of every shingle."""
        start, end, first = words(data, offsets)
        prefix = self.by_word.prefix(word_hashes(data, start, end, self.by_byte))
        at, text = run_starts(first, SHINGLE)
        size = np.diff(first)
        short = np.flatnonzero((size > 0) & (size < SHINGLE))
        begin = np.concatenate([at, first[short]])
        return self.by_word.runs(prefix, begin, np.concatenate([at + SHINGLE, first[short + 1]])), np.concatenate([text, short])

    def digits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Digits of every text's fingerprint, one byte each."""
        n = len(offsets) - 1
        h, text = self.shingles(data, offsets)
        least = np.full(n * BINS, np.iinfo(np.uint64).max, np.uint64)
        np.minimum.at(least, text * BINS + (h >> np.uint64(56)).astype(np.int64), h & np.uint64((1 << 56) - 1))
        least = least.reshape(n, BINS)
        full = least != np.iinfo(np.uint64).max
        some = full.any(1)
        row, bin_ = np.nonzero(~full & some[:, None])
        for asked in range(BINS):
            if not len(row):
                break
            donor = self.orders[bin_, asked]
            ok = full[row, donor]
            least[row[ok], bin_[ok]] = least[row[ok], donor[ok]]
            row, bin_ = row[~ok], bin_[~ok]
        # A text of few shingles has the same hash in many bins: each bin stirs it its own way.
        stirred = mixed(least ^ mixed(np.arange(BINS, dtype=np.uint64))[None, :])
        out = (stirred & np.uint64((1 << BITS) - 1)).astype(np.uint8)
        out[~some] = 0
        return out

    def sketch(self, texts: pa.Array) -> np.ndarray:
        parts = [self.digits(data, offsets) for _, _, data, offsets in rounds(texts)]
        return np.concatenate(parts) if parts else np.zeros((0, BINS), np.uint8)


HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def packed(digits: np.ndarray) -> pa.Array:
    """Hex strings of rows of digits."""
    n = len(digits)
    return pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer((np.arange(n + 1) * BINS).astype(np.int32)), pa.py_buffer(HEX[digits].tobytes())])


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity estimated from digits, without the share that agrees by chance."""
    chance = 2.0 ** -BITS
    return np.clip(((a == b).mean(1) - chance) / (1 - chance), 0, 1)


def fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the fingerprint of each text."""
    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return packed(Sketcher().sketch(texts))

    return docs.withColumn("fingerprint", run(F.col(text)))


def similarity(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two fingerprints, by built-in functions."""
    same = F.size(F.filter(F.sequence(F.lit(1), F.lit(BINS)), lambda i: a.substr(i, F.lit(1)) == b.substr(i, F.lit(1))))
    chance = 2.0 ** -BITS
    return F.least(F.greatest((same / float(BINS) - chance) / (1 - chance), F.lit(0.0)), F.lit(1.0))


def with_next(docs: DataFrame, function, schema: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``function(ids, texts, at, after)`` over all rows in descending order of doc_id, nulls last.

    ``texts[after[i]]`` follows ``texts[at[i]]``; after the last row comes the first. Rows are cut into
    ranges of ids of about ``range_bytes`` of text; the rows that open a range are also sent, as guests,
    to the range before it, so every range knows what follows its last row. ``function`` gets Arrow
    slices and returns a record batch of a row for each of ``at``.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    ranges = max(1, min(MOST_RANGES, size // range_bytes + 1))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0] if ranges > 1 else []
    cuts = sorted(set(cuts or []))
    # Range 0 holds the largest ids: as many ranges come before a row's as there are cuts at or above its id.
    placed = docs.withColumn("range", F.when(F.col("doc_id").isNull(), len(cuts)).otherwise(len(cuts) - _below(F.col("doc_id"), cuts)).cast("int"))
    opening = {r["range"]: r["first"] for r in placed.groupBy("range").agg(F.max("doc_id").alias("first")).collect()}  # a row per range
    order = sorted(opening)
    before = {r: order[i - 1] for i, r in enumerate(order)}  # the first range opens for the last one
    table = lambda values: F.array(*[F.lit(values.get(r)).cast("long") for r in range(len(cuts) + 1)])
    opens = F.col("doc_id").eqNullSafe(F.get(table(opening), F.col("range")))
    here = F.struct(F.col("range").alias("r"), F.lit(False).alias("guest"))
    there = F.struct(F.get(table(before), F.col("range")).cast("int").alias("r"), F.lit(True).alias("guest"))
    sent = placed.withColumn("_to", F.explode(F.when(opens, F.array(here, there)).otherwise(F.array(here))))
    ordered = sent.select(F.col("_to.r").alias("range"), F.col("_to.guest").alias("guest"), "doc_id", "text").repartition(
        len(cuts) + 1, "range").sortWithinPartitions("range", "guest", F.desc_nulls_last("doc_id"), "text")

    def run(batches):
        waiting = None  # the last own row, whose following text has not come yet
        for batch in batches:
            guests = batch.column("guest").to_numpy(zero_copy_only=False)
            for i, j, _, _ in rounds(batch.column("text"), 8_000_000):
                ids, texts, guest = batch.column("doc_id").slice(i, j - i), batch.column("text").slice(i, j - i), guests[i:j]
                if waiting is not None:
                    ids, texts, guest = pa.concat_arrays([waiting[0], ids]), pa.concat_arrays([waiting[1], texts]), np.append(False, guest)
                # The own rows of a range come first, its guests last: each own row is followed by its next.
                at = np.flatnonzero(~guest[:-1])
                waiting = None if guest[-1] else (ids.slice(len(ids) - 1, 1), texts.slice(len(ids) - 1, 1))
                if len(at):
                    yield function(ids, texts, at, at + 1)

    return ordered.mapInArrow(run, schema)


def _below(value: Column, cuts: list) -> Column:
    """Number of ``cuts`` (ascending) below ``value``, by binary search in an array of literals."""
    if not cuts:
        return F.lit(0)
    table = F.array(*[F.lit(c).cast("long") for c in cuts])
    steps = F.array(*[F.lit(1 << k) for k in range(len(cuts).bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda s, step: F.when(F.get(table, s + step - 1) < value, s + step).otherwise(s))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    schema = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    def compare(ids: pa.Array, texts: pa.Array, at: np.ndarray, after: np.ndarray) -> pa.RecordBatch:
        sketcher = Sketcher()
        plain = texts.to_pylist()
        edited = []
        for i, k in zip(at, after):
            cut = len(plain[i]) // 3
            edited.append(plain[i][:len(plain[i]) - cut] + plain[k][:cut])
        own, changed = sketcher.sketch(texts), sketcher.sketch(pa.array(edited, pa.string()))
        return pa.RecordBatch.from_pydict({
            "doc_id": ids.take(pa.array(at)), "n_chars": pa.array([len(plain[i]) for i in at], pa.int64()),
            "edited_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]), "fingerprint": packed(own[at]),
            "edited_fingerprint": packed(changed), "near_edited": pa.array(likeness(own[at], changed)), "near_next": pa.array(likeness(own[at], own[after]))})

    return with_next(documents(spark, sf_dir), compare, schema)
