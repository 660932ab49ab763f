"""Operator 5 — language-model scores from the piece lattice.

A text is its words (A-Z in lower case) and an end. The model gives a word the sum over all ways to
spell it with vocabulary pieces, each way weighing the product of its pieces' probabilities, summed
forwards in log space, and the end a probability of its own. Piece probabilities start from the
vocabulary's own scores; ``PASSES`` passes over the training words' lattices count how often each
piece is expected, and are blended with the scores before, which weigh ``PRIOR_PIECES`` pieces.

All words of the corpus are counted in one shuffle; a lattice is built once per distinct word. To
score, the at most ``FREQUENT`` most frequent words travel to the tasks with their numbers, and only
the remaining words of a text are shuffled to theirs.

Defined results: null counts as the empty text, which has the end only; a null id is not held out and
not learned from; without training texts every word is unknown, and its base score uses N = V = 0;
repeated rows get the same scores; an empty table gives no rows; ``score_texts`` uses its own column names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from pricemill.session import materialise

from .bytework import BLANK, SMALL, rounds
from .common import documents, id_hash
from .lattice import MODEL_FILE, Lattice, Pieces, load

# Words that are sent to every task: bounded, whatever the size of the corpus.
FREQUENT = 200_000
PRIOR_PIECES = 1e5
PASSES = 2
ROUND = 4_000_000
WORDS_AT_ONCE = 50_000
# The smoothing of the base score, a fixed value.
LAMBDA = 0.1


def lower_words(column: pa.Array):
    """(first row, end row, flat words, first word of every text) of slices of the column."""
    letters = SMALL.copy()
    letters[BLANK] = 32
    for i, j, data, offsets in rounds(column, ROUND):
        even = letters[data]
        texts = pa.Array.from_buffers(pa.string(), j - i, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(even)])
        lists = pc.split_pattern(texts, " ")
        flat, first = lists.flatten(), lists.offsets.to_numpy()
        full = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
        yield i, j, flat.filter(pa.array(full)), np.append(0, np.cumsum(full))[first - first[0]]


def _count(batches):
    """(word, uses in training texts, uses) of each slice of a batch."""
    for batch in batches:
        learn = batch.column("learn").to_numpy(zero_copy_only=False)
        for i, j, flat, first in lower_words(batch.column("text")):
            coded = flat.dictionary_encode()
            code = coded.indices.to_numpy()
            trained = np.repeat(learn[i:j], np.diff(first))
            n = len(coded.dictionary)
            yield pa.RecordBatch.from_pydict({
                "word": coded.dictionary, "c": pa.array(np.bincount(code[trained], minlength=n).astype(np.int64)),
                "uses": pa.array(np.bincount(code, minlength=n).astype(np.int64))})


def _lattices(words: pa.Array, pieces: Pieces):
    """Lattices of slices of the words, each with the mark of a word's start, and the slices' bounds."""
    for a in range(0, len(words), WORDS_AT_ONCE):
        part = words.slice(a, WORDS_AT_ONCE)
        for i, j, data, offsets in rounds(part, ROUND):
            size = np.diff(offsets) + 1
            ends = np.append(0, np.cumsum(size))
            flat = np.full(ends[-1], 32, np.uint8)
            inside = np.ones(ends[-1], bool)
            inside[ends[:-1]] = False
            flat[inside] = data
            yield a + i, a + j, Lattice(pieces, flat, ends)


def fit_pieces(words: DataFrame, pieces: Pieces, texts: int) -> tuple[Pieces, float]:
    """Pieces with learned log probabilities, and the log probability of the end; ``words`` has word and c."""
    shared = words.sparkSession.sparkContext.broadcast(pieces)

    def expect(batches):
        model = shared.value
        total = np.zeros(len(model.logp))
        for batch in batches:
            times = batch.column("c").to_numpy().astype(float)
            for i, j, lattice in _lattices(batch.column("word"), model):
                total += lattice.expected(times[i:j])
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"piece": pa.array(used.astype(np.int32)), "n": pa.array(total[used])})

    got = words.filter("c > 0").select("word", "c").mapInArrow(expect, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n"))
    count = np.zeros(len(pieces.logp))
    for r in sorted(got.collect(), key=lambda r: r["piece"]):  # at most the vocabulary
        count[r["piece"]] = r["n"]
    blended = count + PRIOR_PIECES * np.exp(pieces.logp)
    end = texts + 1.0
    with np.errstate(divide="ignore"):
        return pieces.with_logp(np.log(blended / (blended.sum() + end))), math.log(end / (blended.sum() + end))


def score_texts(texts: DataFrame, path: str = MODEL_FILE, frequent: int = FREQUENT, passes: int = PASSES) -> DataFrame:
    """Scores by row of ``texts``, which has a unique long ``row``, ``text`` and boolean ``learn``.

    Returns row, n_tokens, n_known, train_tokens, base_score and score (log10).
    """
    spark = texts.sparkSession
    counted = texts.select("text", "learn").mapInArrow(_count, "word string, c long, uses long")
    words = materialise(counted.groupBy("word").agg(F.sum("c").alias("c"), F.sum("uses").alias("uses")), "words")
    trained = texts.filter("learn").count()
    seen = words.agg(F.sum("c").alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    total, distinct = (seen["n"] or 0) + trained, seen["v"] + (trained > 0)
    floor = math.log10(total + LAMBDA * (distinct + 1))
    pieces = load(path)
    for _ in range(passes):
        pieces, end = fit_pieces(words, pieces, trained)
    shared = spark.sparkContext.broadcast(pieces)

    def spell(batches):
        for batch in batches:
            word = batch.column("word")
            logs = np.empty(len(word))
            for i, j, lattice in _lattices(word, shared.value):
                logs[i:j] = lattice.log_marginals()
            yield pa.RecordBatch.from_pydict({"word": word, "c": batch.column("c"), "uses": batch.column("uses"), "log_p": pa.array(logs / math.log(10))})

    spelled = materialise(words.mapInArrow(spell, "word string, c long, uses long, log_p double"), "spelled")
    # The few words that make up most of the text: whole steps of a histogram of uses, from the top, while they fit.
    step = F.floor(F.log2("uses") * 16)
    floor_step, held = None, 0
    for r in sorted(spelled.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):  # 16 steps per doubling
        held += r["count"]
        if held > frequent:
            break
        floor_step = r["step"]
    top = spelled.filter(step >= floor_step if floor_step is not None else F.lit(False)).select("word", "c", "log_p").toArrow()
    known = spark.sparkContext.broadcast((top.column("word").cast(pa.string()).combine_chunks(), top.column("c").to_numpy(), top.column("log_p").to_numpy()))
    end_c = trained

    def parts(batches):
        """By text (word null): the sums over frequent words and the end; and one row per other word of a text."""
        vocabulary, c, log_p = known.value
        base = np.log10(c + LAMBDA) - floor
        for batch in batches:
            row = batch.column("row").to_numpy()
            for i, j, flat, first in lower_words(batch.column("text")):
                code = pc.index_in(flat, vocabulary)
                at = code.fill_null(-1).to_numpy()
                text = np.repeat(np.arange(j - i), np.diff(first))
                hit = at >= 0
                sums = [np.bincount(text[hit], v[at[hit]], j - i) for v in (base, log_p, (c > 0).astype(float))]
                yield pa.RecordBatch.from_pydict({
                    "row": pa.array(row[i:j]), "word": pa.nulls(j - i, pa.string()), "n": pa.array(np.diff(first) + 1),
                    "known": pa.array(sums[2].astype(np.int64) + (end_c > 0)), "base": pa.array(sums[0] + math.log10(end_c + LAMBDA) - floor),
                    "score": pa.array(sums[1] + end / math.log(10))})
                rest = np.flatnonzero(~hit)
                if len(rest):
                    coded = flat.take(pa.array(rest)).dictionary_encode()
                    pair, n = np.unique(text[rest] * len(coded.dictionary) + coded.indices.to_numpy(), return_counts=True)
                    yield pa.RecordBatch.from_pydict({
                        "row": pa.array(row[i:j][pair // len(coded.dictionary)]), "word": coded.dictionary.take(pa.array(pair % len(coded.dictionary))),
                        "n": pa.array(n.astype(np.int64)), "known": pa.nulls(len(n), pa.int64()), "base": pa.nulls(len(n), pa.float64()), "score": pa.nulls(len(n), pa.float64())})

    cut = materialise(texts.select("row", "text").mapInArrow(parts, "row long, word string, n long, known long, base double, score double"), "parts")
    rare = cut.filter("word is not null").select("row", "word", "n").join(spelled.select("word", "c", "log_p"), "word").groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known_"), F.sum(F.col("n") * (F.log10(F.col("c") + LAMBDA) - floor)).alias("base_"),
        F.sum(F.col("n") * F.col("log_p")).alias("score_"))
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return cut.filter("word is null").join(rare, "row", "left").select(
        "row", F.col("n").alias("n_tokens"), plus("known", "known_").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        plus("base", "base_").alias("base_score"), plus("score", "score_").alias("score"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and lattice scores of every document; a tenth of the ids is held out from learning."""
    tenth = id_hash(F.col("doc_id")) % 10 == 0
    docs = documents(spark, sf_dir).select("doc_id", "text").withColumn("held_out", F.coalesce(tenth, F.lit(False)))
    # Rows are numbered by place, so that rows which share an id stay apart; the ids are stored once.
    numbered = docs.withColumn("row", F.monotonically_increasing_id()).withColumn("learn", ~F.col("held_out") & F.col("doc_id").isNotNull())
    ids = materialise(numbered.select("row", "doc_id", "held_out"), "rows")
    return ids.join(score_texts(numbered.select("row", "text", "learn")), "row").drop("row")
