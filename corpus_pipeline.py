"""A corpus pipeline of training-data operators: ``run(spark, sf_dir)`` applies STAGES to the documents.

Every stage takes (spark, docs, sf_dir), works on all rows it is given and returns the columns of
``docs``; the last one returns the training rows. Each result is written and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pricemill.llm import jaccard_join, language, mixing, pieces, secret_scan
from pricemill.llm.common import documents
from pricemill.session import materialise

# The context trees behind the first stage have no SQL form.
ORACLE_SQL = None

# A text is rejected when no learned language codes it in fewer bits than these per byte, plus a start.
MOST_BITS, START_BITS = 6.0, 64.0
# Near duplicates: word n-grams and percent of their union.
NEAR_WORDS, NEAR_SHARE = 5, 80


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in a language that the labelled rows show; texts without letters, and those no language fits, go.

    Without a single labelled row, every text with a letter stays.
    """
    trees = language.learn(docs)
    told = language.identify(docs.select(F.struct(*docs.columns).alias("_row")), trees, "_row.text")
    bits = F.col("bits_per_byte") * F.octet_length(F.col("_row.text"))
    fits = (F.col("lang_pred") != "und") & (bits <= MOST_BITS * F.octet_length(F.col("_row.text")) + START_BITS)
    if not trees.languages:
        fits = F.coalesce(F.col("_row.text").rlike(r"\p{L}"), F.lit(False))
    return told.filter(fits).select("_row.*")


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of every group linked by five-word Jaccard similarity of 0.8 or more.

    Rows are judged by their own texts, also where they share an id or have none. Null, empty and wordless texts link with nothing
    and stay; of repeated rows one stays.
    """
    return jaccard_join.keep_one(docs, NEAR_WORDS, NEAR_SHARE)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets replaced by a mark and n_chars counted anew where that changed the text.

    Null and empty texts stay as they are; repeated rows are masked alike.
    """
    masked = docs.withColumn("_new", secret_scan.redacted(F.col("text")))
    other = ~F.col("_new").eqNullSafe(F.col("text"))
    new = {"text": F.col("_new"), "n_chars": F.when(other, F.length("_new").cast("long")).otherwise(F.col("n_chars"))}
    return masked.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once; sources below their target are repeated, up to twice.

    Null and empty texts have no words and count for nothing in the targets; a null source is one of its own; rows that share an id are drawn alike.
    """
    return mixing.mix(docs, floor=1.0)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled pieces of every row, with its id, language and source.

    A null text has null pieces, the empty one a single word mark; repeated rows are segmented alike.
    """
    return pieces.encode(docs.select("doc_id", "lang", "source", "text"), keep_text=False, round_bytes=700_000).select("doc_id", "lang", "source", "n_pieces", "lossless", "pieces")


STAGES = [
    ("language_id", keep_known_languages),
    ("ngram_jaccard_join", keep_one_of_near_copies),
    ("secret_scan", mask_secrets),
    ("source_mix", mix_sources),
    ("sampled_pieces", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
