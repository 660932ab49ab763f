"""Operator 4 — SentencePiece encoding with sampled segmentations, and lossless decoding.

Every word's piece lattice is filtered forwards (summed weights of all ways to a node) and sampled
backwards: from the word's end, an incoming piece is drawn in proportion to the weight it carries.
The draws are hashes of (seed, row key, word number, step), so a row is segmented alike in every run
and on every executor. No piece crosses a space or a line end, so words are independent, and the
lattice of a word that repeats within a batch is built once.

Spaces are written as the word mark, a text starts with one, and a character without a piece is
spelled in bytes (also a literal word mark), so decoding gives back every text byte for byte; each encoded row says so.

Defined results: null has null pieces; the empty text is a single word mark; repeated rows are
segmented alike; an empty table gives no rows; ``encode`` replaces columns named as those it adds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .bytework import BASE_A, Rolling, mixed, rounds, tidy
from .common import documents
from .lattice import MODEL_FILE, Lattice, Pieces, load

SEED = 77
ROUND = 2_000_000


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts with a leading space, cut before every space and around every line end: bytes, starts, ends, first segment by text."""
    n = len(offsets) - 1
    out = np.full(len(data) + n, 32, np.uint8)
    where = offsets + np.arange(n + 1)
    text = np.repeat(np.arange(n), np.diff(offsets))
    out[np.arange(len(data)) + text + 1] = data
    cut = (out == 32) | (out == 10)
    cut[1:] |= out[:-1] == 10
    cut[where[:-1]] = True
    start = np.flatnonzero(cut)
    return out, start, np.append(start[1:], len(out)), np.searchsorted(start, where)


def encode_round(pieces: Pieces, data: np.ndarray, offsets: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all texts, and the first id of every text (one more at the end)."""
    flat, start, end, first = segments(data, offsets)
    roll = Rolling(BASE_A)
    h = roll.runs(roll.prefix(flat.astype(np.uint64) + np.uint64(1)), start, end)
    code = pa.array(h).dictionary_encode().indices.to_numpy()
    example = np.empty(int(code.max()) + 1, np.int64)
    example[code[::-1]] = np.arange(len(code))[::-1]
    size = (end - start)[example]
    bounds = np.append(0, np.cumsum(size))
    at = np.repeat(start[example] - bounds[:-1], size) + np.arange(bounds[-1])
    words = Lattice(pieces, flat[at], bounds)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    number = (np.arange(len(code)) - first[:-1][text]).astype(np.uint64)
    ids, taken = words.sample(code, mixed(keys[text] ^ mixed(number + np.uint64(1))))
    done = np.append(0, np.cumsum(taken))
    return ids, done[first]


def spellings(pieces: Pieces) -> pa.Array:
    """Bytes of every piece id."""
    out = list(pieces.texts)
    for b, i in enumerate(pieces.byte_ids):
        out[i] = bytes([b])
    return pa.array(out, pa.binary())


def decode_round(table: pa.Array, ids: np.ndarray, first: np.ndarray) -> list[bytes]:
    """Texts behind the ids: the pieces' bytes side by side, without the leading space."""
    joined = table.take(pa.array(ids))
    at = np.frombuffer(joined.buffers()[1], np.int32)[:len(ids) + 1]
    raw = joined.buffers()[2]
    view = memoryview(raw) if raw is not None else memoryview(b"")
    return [bytes(view[at[a] + 1:at[b]]) for a, b in zip(first[:-1], first[1:])]


def row_keys(ids: np.ndarray, seed: int) -> np.ndarray:
    return mixed(ids.astype(np.uint64) ^ np.uint64(mixed(np.array([seed], np.uint64))[0]))


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, path: str = MODEL_FILE, sharpness: float = 1.0,
           keep_text: bool = True, round_bytes: int = ROUND) -> DataFrame:
    """``docs`` with ``pieces`` (ids), ``n_pieces`` and ``lossless``; pieces weigh their probability to the power ``sharpness``.

    Rows leave a task in the rounds of ``round_bytes`` that they are encoded in: larger rounds meet more repeated
    words, smaller ones need less memory.
    """
    model = load(path)
    model = model.with_logp(model.logp * sharpness)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the vocabulary
    whole = docs.schema[key].dataType.typeName() in ("byte", "short", "integer", "long")
    number = F.coalesce(F.col(key), F.lit(0)).cast("long") if whole else F.xxhash64(F.col(key))
    new = ("pieces", "n_pieces", "lossless")
    kept = [c for c in docs.columns if c not in new and (keep_text or c != text)]

    def run(batches):
        pieces = shared.value
        table = spellings(pieces)
        for batch in batches:
            texts = batch.column("_text")
            keys = row_keys(batch.column("_number").to_numpy().view(np.uint64), seed)
            for i, j, data, offsets in rounds(texts, round_bytes):
                ids, first = encode_round(pieces, data, offsets, keys[i:j])
                raw = memoryview(np.ascontiguousarray(data))
                same = [d == raw[a:b] for d, a, b in zip(decode_round(table, ids, first), offsets[:-1], offsets[1:])]
                gone = texts.slice(i, j - i).is_null().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(n).slice(i, j - i) for n in range(len(kept))],
                     pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids), mask=pa.array(gone)),
                     pa.array(np.diff(first), mask=gone), pa.array(np.array(same, bool), mask=gone)], names=[*kept, *new])
        tidy()

    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField("pieces", T.ArrayType(T.IntegerType())), T.StructField("n_pieces", T.LongType()),
                           T.StructField("lossless", T.BooleanType())])
    return docs.select(*kept, F.col(text).alias("_text"), number.alias("_number")).mapInArrow(run, schema)


def decoded(pieces: Column, path: str = MODEL_FILE) -> Column:
    """Text behind an array of piece ids; null for null."""
    table = [t or b"" for t in spellings(load(path)).to_pylist()]

    @F.arrow_udf("string")
    def run(ids: pa.Array) -> pa.Array:
        return pa.array([None if x is None else b"".join(map(table.__getitem__, x))[1:].decode() for x in ids.to_pylist()], pa.string())

    return run(pieces)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled pieces of every document, and whether they decode to its text."""
    return encode(documents(spark, sf_dir).select("doc_id", "text"), keep_text=False).select("doc_id", "n_pieces", "lossless", "pieces")
