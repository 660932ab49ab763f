"""Column expressions and plan steps that several training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from pricemill.session import materialise

# Fixed value: a word is a run of characters other than the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often a nested lambda reads it."""
    return F.transform(F.array(value), body)[0]


def id_hash(doc_id: Column) -> Column:
    """CRC-32 of the id written as text; null for a null id."""
    return F.crc32(doc_id.cast("string"))


def ordinals(df: DataFrame, order: list[str], within: list[str], into: str, purpose: str) -> DataFrame:
    """Number the rows of every ``within`` group without gaps from 0, in ``order``, and without gathering a group.

    The rows go to sorted ranges of (within, order), where the running id gives the place inside the
    range; only the number of rows by range and group (as many as there are ranges, plus the groups)
    is summed up front to back. Rows that tie on all of ``order`` are numbered in any order.
    """
    keys = [*within, *order]
    salted = df.withColumn("_tie", F.monotonically_increasing_id())
    ranged = salted.repartitionByRange(*[F.col(c) for c in keys], F.col("_tie")).sortWithinPartitions(*keys, "_tie")
    placed = materialise(ranged.withColumn("_at", F.monotonically_increasing_id()).drop("_tie"), purpose)
    part = F.shiftright("_at", 33)
    same = [F.col(f"_g{i}").eqNullSafe(F.col(c)) for i, c in enumerate(within)]
    counts = placed.groupBy(part.alias("_part"), *[F.col(c).alias(f"_g{i}") for i, c in enumerate(within)]).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*[f"_g{i}" for i in range(len(within))]).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialise(counts.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))), f"{purpose}-ranges")
    joined = placed.withColumn("_p", part).join(offsets, [F.col("_p") == F.col("_part"), *same], "left")
    return joined.select(*df.columns, (F.col("_at") - F.col("_first") + F.col("_base")).alias(into))


# Most bytes of a side that is sent to every task.
BROADCAST_BYTES = 32 << 20


def sent_if_small(side: DataFrame, row_bytes: int) -> DataFrame:
    """``side``, a stored table, marked for broadcast if its counted rows stay below ``BROADCAST_BYTES``."""
    return F.broadcast(side) if side.count() * row_bytes <= BROADCAST_BYTES else side


# Bits of a sieve; a table of as many 64-bit words at most is sent to every task.
SIEVE_BITS = 1 << 26


class Sieve:
    """The keys of a table as bits of their hashes, small enough to send: passes every row that has one of the keys, and by chance a few others.

    Where a join with these keys is too large to send, only rows that pass need to be shuffled.
    """

    def __init__(self, keys: DataFrame, on: str):
        self.on = on
        bits = keys.select(self._bit().alias("_bit")).groupBy(F.shiftright("_bit", 6).alias("_word")).agg(F.expr("bit_or(shiftleft(1L, cast(_bit & 63 as int)))").alias("_bits"))
        self.words = materialise(bits, "sieve")

    def _bit(self) -> Column:
        return F.pmod(F.xxhash64(self.on, F.lit(11)), F.lit(SIEVE_BITS))

    def told(self, df: DataFrame) -> DataFrame:
        """``df`` with ``_passed``."""
        placed = df.withColumn("_bit", self._bit()).join(F.broadcast(self.words), F.shiftright("_bit", 6) == F.col("_word"), "left")
        return placed.select(*df.columns, F.expr("_bits is not null and (shiftrightunsigned(_bits, cast(_bit & 63 as int)) & 1) = 1").alias("_passed"))

    def passed(self, df: DataFrame) -> DataFrame:
        return self.told(df).filter("_passed").drop("_passed")


def held_by(df: DataFrame, side: DataFrame, row_bytes: int, on: str = "doc_id") -> DataFrame:
    """``df`` joined with ``side``, a stored table, which is sent if it is small; else the rows of ``df`` are sieved before they are shuffled."""
    if side.count() * row_bytes <= BROADCAST_BYTES:
        return df.join(F.broadcast(side), on)
    return Sieve(side, on).passed(df).join(side, on)


def without(df: DataFrame, gone: DataFrame, keys: DataFrame, on: str, row_bytes: int) -> DataFrame:
    """Rows of ``df`` without a key of ``gone``, a stored table; ``keys`` are all keys of ``df``.

    Where ``gone`` is too large to send, its sieve is, with those of the other keys that pass by chance.
    """
    if gone.count() * row_bytes <= BROADCAST_BYTES:
        return df.join(F.broadcast(gone), on, "left_anti")
    sieve = Sieve(gone, on)
    spared = materialise(sieve.passed(keys.select(on).join(gone, on, "left_anti")).distinct(), "spared").withColumn("_spared", F.lit(True))
    told = sieve.told(df).join(sent_if_small(spared, row_bytes), on, "left")
    return told.filter("not _passed or _spared").select(*df.columns)
