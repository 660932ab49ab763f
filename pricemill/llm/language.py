"""Operator 9 — language identification by prediction by partial matching.

For every language a context tree over bytes holds which bytes followed which contexts of up to
``order`` bytes. Under frozen counts the probability of a byte is fixed by its context: a byte seen
in the longest known context has its count over count plus escapes there; any other byte pays the
escape and is predicted by the shorter context, whose bytes already refused are left out and whose
probabilities are scaled up accordingly, down to equal shares of all 256 bytes. So the code length
of a text is a sum of table entries, which whole texts are looked up in.

The trees of all labelled languages are fitted on a bounded sample of the labelled rows: about ``sample_bytes``
of text per language, or an equal share of ``TOTAL_BYTES`` if that is less, drawn in pieces of ``PIECE`` bytes by a hash of id, text and place. So a language
whose text lies in a few long documents, or in copies of one row, has its share too. Every text is scored whole.

Defined results: null text, or a text without a letter, is ``und`` with score 0; without any labelled
text every row is ``und``; repeated rows get the same answer; a null id is never held out and never
learned from; ``identify`` replaces columns named as those it adds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from pricemill.session import materialise

from .bytework import mixed, rounds, tidy
from .common import documents, id_hash, sent_if_small

ORDER = 3
SAMPLE_BYTES = 1 << 20
TOTAL_BYTES = 16 << 20
ROUND = 500_000
# Bytes that are drawn together, and the fewest that are drawn of a language on average.
PIECE, LEAST_BYTES = 256, 8192
# Table entries that one step of the scoring reads.
STEP = 4_000_000
# What a text starts with, in training and in scoring.
START = b"\n\n\n"


def _counts(batches):
    """(lang, key, n) of a batch: key holds ORDER + 1 bytes, the last of which followed the others, in a piece that is drawn."""
    for batch in batches:
        lang = batch.column("lang").to_numpy(zero_copy_only=False)
        row, share = batch.column("row").to_numpy().view(np.uint64), batch.column("share").to_numpy()
        for i, j, data, offsets in rounds(batch.column("text")):
            grams, text = _grams(data, offsets)
            size = np.diff(offsets)
            pieces = -(-size // PIECE)
            owner = np.repeat(np.arange(j - i), pieces)
            nth = np.arange(len(owner)) - (np.cumsum(pieces) - pieces)[owner]
            place = (mixed(row[i:j][owner] ^ mixed(nth.astype(np.uint64))) >> np.uint64(11)) / float(1 << 53)
            drawn = np.repeat(place < share[i:j][owner], np.minimum(size[owner] - nth * PIECE, PIECE))
            grams, text = grams[drawn], text[drawn]
            names, code = np.unique(lang[i:j].astype(str), return_inverse=True)
            key, n = np.unique(grams.astype(np.uint64) | (code[text].astype(np.uint64) << np.uint64(32)), return_counts=True)
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array(names[(key >> np.uint64(32)).astype(np.int64)].tolist(), pa.string()),
                "key": pa.array((key & np.uint64(0xFFFFFFFF)).astype(np.int64)), "n": pa.array(n.astype(np.int64))})


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every byte with the ORDER bytes before it, as one 32-bit number, and its text."""
    pad = len(START)
    size = np.diff(offsets)
    text = np.repeat(np.arange(len(size)), size)
    padded = np.empty(len(data) + pad * len(size), np.uint8)
    at = np.arange(len(data)) + pad * (text + 1)
    padded[(offsets[:-1] + pad * np.arange(len(size)))[:, None] + np.arange(pad)] = np.frombuffer(START, np.uint8)
    padded[at] = data
    b = padded.astype(np.uint32)
    return (b[at - 3] << np.uint32(24)) | (b[at - 2] << np.uint32(16)) | (b[at - 1] << np.uint32(8)) | b[at], text


class ContextTrees:
    """Frozen code lengths of all languages, for the bytes that some language has seen in a state.

    A state is a context known to some language: none, one, two or three bytes. ``row[state, byte]`` numbers the
    rows of ``bits``, one column a language; where it is -1, the byte costs ``escape[state]`` and what it costs
    in the state of one byte less, ``parent``. ``pair`` numbers the two-byte strings that start a longer
    context; ``long`` gives the state of such a pair and one byte more, or 0; ``short`` gives the state of
    the last two bytes. So the tables grow with the contexts seen times the languages.
    """

    def __init__(self, counts: list[tuple[str, int, int]] | pa.Table, languages: list[str]):
        self.languages = languages
        if not isinstance(counts, pa.Table):
            counts = pa.table({"lang": pa.array([c[0] for c in counts], pa.string()), "key": pa.array([c[1] for c in counts], pa.int64()), "n": pa.array([c[2] for c in counts], pa.int64())})
        code = pc.index_in(counts["lang"], pa.array(languages, pa.string())).to_numpy()
        rows = np.stack([counts["key"].to_numpy(), counts["n"].to_numpy()], 1)
        order = np.argsort(code, kind="stable")
        table = dict(zip(languages, map(self._levels, np.split(rows[order], np.searchsorted(code[order], np.arange(1, len(languages)))))))
        states: list[tuple[int, int]] = [(0, 0)]  # (length, context)
        for length in (1, 2, 3):
            states += [(length, int(c)) for c in np.unique(np.concatenate([t[length][0] for t in table.values()] or [np.zeros(0, np.int64)]))]
        number = {s: i for i, s in enumerate(states)}
        seen = np.zeros(256, bool)
        for t in table.values():
            seen[t[0][1]] = True
        # Bytes that no language has seen cost the same everywhere and share one column.
        self.column = np.where(seen, np.cumsum(seen) - 1, seen.sum()).astype(np.int64)
        self.width = int(seen.sum()) + 1
        self.parent = np.array([0] + [number[(n - 1, c & ((1 << 8 * (n - 1)) - 1))] for n, c in states[1:]], np.int32)
        first = [next((i for i, s in enumerate(states) if s[0] == length), len(states)) for length in range(ORDER + 1)] + [len(states)]
        context = np.array([c for _, c in states], np.int64)
        place = {name: [first[length] + np.searchsorted(context[first[length]:first[length + 1]], t[length][0]) for length in range(ORDER + 1)] for name, t in table.items()}
        self.row = np.full(len(states) * self.width, -1, np.int32)
        self.row[:self.width] = 0  # every byte has a row in the state without context
        for name, t in table.items():
            for length in range(ORDER + 1):
                self.row[place[name][length] * self.width + self.column[t[length][1]]] = 0
        where = np.flatnonzero(self.row == 0)
        self.row[where] = np.arange(len(where))
        self.bits = np.empty((len(where), len(languages)), np.float32)
        self.escape = np.empty((len(states), len(languages)), np.float32)
        for x, name in enumerate(languages):
            self._code_lengths(x, table[name], place[name], first, where, seen)
        self.short = np.zeros(1 << 16, np.int32)
        one = np.zeros(256, np.int32)
        for (n, c), i in number.items():
            if n == 1:
                one[c] = i
        self.short[:] = np.tile(one, 256)
        pairs = sorted({c >> 8 for n, c in states if n == 3})
        self.pair = np.zeros(1 << 16, np.int32)
        self.pair[pairs] = np.arange(1, len(pairs) + 1)
        self.long = np.zeros((len(pairs) + 1) * 256, np.int32)
        for (n, c), i in number.items():
            if n == 2:
                self.short[c] = i
            elif n == 3:
                self.long[self.pair[c >> 8] * 256 + (c & 255)] = i

    @staticmethod
    def _levels(rows: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For contexts of 0 to 3 bytes: context, byte, count."""
        out = []
        for length in range(ORDER + 1):
            key, inverse = np.unique(rows[:, 0] & ((1 << 8 * (length + 1)) - 1), return_inverse=True)
            out.append((key >> 8, key & 255, np.bincount(inverse, rows[:, 1], len(key)) if len(key) else np.zeros(0)))
        return out

    def _code_lengths(self, x: int, levels, place, first, where: np.ndarray, seen: np.ndarray) -> None:
        """Fill column ``x``: state by state, from the shortest contexts on, the rows of ``bits`` and ``escape``."""
        width = self.width
        state, byte = where // width, where % width
        weight = np.ones(width)
        weight[-1] = max(256 - int(seen.sum()), 1)
        base = np.full(width, 1 / 256)  # the last column stands for each unseen byte
        if seen.all():
            base[-1] = 0
        cost, pay = np.empty(len(where)), np.zeros(len(self.parent))
        for length, (_, of, n) in enumerate(levels):
            lo, hi = first[length], first[length + 1]
            rows = np.arange(*np.searchsorted(state, [lo, hi]))
            lower = base if not length else np.exp2(-self._cost(self.parent[state[rows]], byte[rows], cost, pay))
            lower = np.array(lower[byte[rows]] if not length else lower)
            at = place[length]
            number = self.row[at * width + self.column[of]] - (rows[0] if len(rows) else 0)
            count = np.bincount(number, n, len(rows)) if len(number) else np.zeros(len(rows))
            total = np.bincount(at - lo, n, hi - lo) if len(at) else np.zeros(hi - lo)
            kinds = np.bincount(at - lo, minlength=hi - lo)
            # The shares of all bytes sum to 1, so the open bytes have what the known ones leave.
            known = np.bincount(state[rows] - lo, np.where(count > 0, lower * weight[byte[rows]], 0), hi - lo)
            left = 1 - known
            # Where every byte is already known the escape has nothing to go to.
            escape = np.where(left > 1e-12, kinds, 0)
            below = np.maximum(total + escape, 1)
            factor = np.where(total > 0, escape / below / np.maximum(left, 1e-300), 1.0)
            pay[lo:hi] = -np.log2(np.maximum(factor, 1e-300))
            own = state[rows] - lo
            cost[rows] = -np.log2(np.maximum(np.where(count > 0, count / below[own], factor[own] * lower), 1e-300))
        self.bits[:, x], self.escape[:, x] = cost, pay

    def _cost(self, state: np.ndarray, byte: np.ndarray, bits: np.ndarray, escape: np.ndarray) -> np.ndarray:
        """What the bytes cost in their states: the first row on the way to shorter contexts, and the escapes to it."""
        row = self.row[state.astype(np.int64) * self.width + byte]
        missing = np.flatnonzero(row < 0)
        out = bits[row]
        if len(missing):
            state = state[missing]
            out[missing] = escape[state] + self._cost(self.parent[state], byte[missing], bits, escape)
        return out

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits that each language needs for each text."""
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        grams, text = _grams(data, offsets)
        if not len(grams):
            return out
        last = (grams >> np.uint32(8)) & np.uint32(0xFFFF)
        state = self.long[self.pair[grams >> np.uint32(16)] * 256 + ((grams >> np.uint32(8)) & np.uint32(255)).astype(np.int32)]
        state = np.where(state > 0, state, self.short[last])
        byte = self.column[grams & np.uint32(255)]
        # However many languages there are and however long a text is, a step takes bounded memory.
        step = max(STEP // len(self.languages), 1000)
        for lo in range(0, len(grams), step):
            owner = text[lo:lo + step]
            begin = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            out[owner[begin]] += np.add.reduceat(self._cost(state[lo:lo + step], byte[lo:lo + step], self.bits, self.escape), begin, axis=0, dtype=np.float64)
        return out


def learn(docs: DataFrame, sample_bytes: int = SAMPLE_BYTES, total_bytes: int = TOTAL_BYTES) -> ContextTrees:
    """Fit the trees of all languages on about ``sample_bytes`` of labelled text each, or equal shares of ``total_bytes``; rows without label don't count."""
    labelled = docs.filter(F.col("lang").isNotNull() & (F.octet_length("text") > 0)).select("lang", "text", F.xxhash64("doc_id", "text").alias("row"))
    # Copies of a row are drawn together, so they count once for the share.
    once = labelled.select("lang", "row", F.octet_length("text").cast("long").alias("bytes")).distinct()
    sizes = materialise(once.groupBy("lang").agg(F.sum("bytes").alias("bytes")), "language-sizes")
    languages = sorted(r["lang"] for r in sizes.select("lang").collect())
    if not languages:
        return ContextTrees([], [])
    each = min(sample_bytes, max(total_bytes // len(languages), LEAST_BYTES))
    sample = labelled.join(sent_if_small(sizes, 80), "lang").select("lang", "text", "row", (each / F.col("bytes")).alias("share"))
    counts = sample.mapInArrow(_counts, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    # At most one row per sampled byte.
    return ContextTrees(counts.toArrow(), languages)


def identify(docs: DataFrame, trees: ContextTrees, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (its posterior under equal priors) and ``bits_per_byte``."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    @F.arrow_udf("struct<lang_pred:string,score:double,bits_per_byte:double>")
    def run(texts: pa.Array) -> pa.Array:
        model = shared.value
        names = np.array(model.languages, dtype=object)
        pred, score, rate = [], [], []
        for i, j, data, offsets in rounds(texts, ROUND):
            bits = model.lengths(data, offsets) if len(names) else np.zeros((j - i, 1))
            best = bits.argmin(1)
            least = bits[np.arange(len(best)), best]
            pred += names[best].tolist() if len(names) else [None] * (j - i)
            score += (1 / np.exp2(np.minimum(least[:, None] - bits, 0)).sum(1)).tolist()
            rate += (least / np.maximum(np.diff(offsets), 1)).tolist()
        tidy()
        kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("bits_per_byte", pa.float64())])
        return pa.array([{"lang_pred": p, "score": s, "bits_per_byte": r} for p, s, r in zip(pred, score, rate)], kind)

    spoken = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    told = docs.withColumn("_told", run(F.col(text)))
    known = spoken & F.col("_told.lang_pred").isNotNull()
    return told.withColumn("lang_pred", F.when(known, F.col("_told.lang_pred")).otherwise("und")).withColumn(
        "score", F.when(known, F.col("_told.score")).otherwise(0.0)).withColumn(
        "bits_per_byte", F.when(known, F.col("_told.bits_per_byte"))).drop("_told")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; a third of the ids is held out from learning."""
    third = F.coalesce(id_hash(F.col("doc_id")) % 3 == 1, F.lit(False))
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang").withColumn("held_out", third)
    trees = learn(docs.filter(~F.col("held_out") & F.col("doc_id").isNotNull()))
    return identify(docs.drop("lang"), trees).select("doc_id", "held_out", "lang_pred", "score", F.round("bits_per_byte", 6).alias("bits_per_byte"))
