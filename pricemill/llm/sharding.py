"""Operator 10 — sharding by jump consistent hashing.

A stable key runs through the published jump recurrence: it leaps from shard to shard with a
64-bit linear congruential generator until the next leap passes the last shard. No ring table
exists, every shard gets an equal share of keys, and a shard that is appended takes rows only into
itself (1 / (n + 1) of them). Everything is built-in column arithmetic.

Defined results: a null key counts as key 0; a null text has no bytes and the CRC-32 of the empty
text; repeated rows share a shard and get a slot each; an empty table gives no rows; other columns
of the input pass through ``assign`` unless they carry the name of a column it adds, which wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import documents, ordinals

# Fixed value: the multiplier of the jump generator, cut into limbs of 22, 22 and 20 bits.
MULTIPLIER = 2862933555777941757
LIMB, LOW = 22, (1 << 22) - 1
A0, A1, A2 = MULTIPLIER & LOW, (MULTIPLIER >> LIMB) & LOW, MULTIPLIER >> 2 * LIMB
# Leaps taken before the rare unfinished keys enter the loop that is long enough for any key.
FIRST_LEAPS = 12


def _leap(state: Column, shards: Column) -> Column:
    """One step of the recurrence; the product stays below 2**47 per limb, so nothing overflows."""
    k0, k1, k2 = state["k0"], state["k1"], state["k2"]
    p0 = k0 * A0 + 1
    p1 = k0 * A1 + k1 * A0 + F.shiftright(p0, LIMB)
    p2 = k0 * A2 + k1 * A1 + k2 * A0 + F.shiftright(p1, LIMB)
    n1, n2 = p1.bitwiseAND(LOW), p2.bitwiseAND((1 << 20) - 1)
    high = F.shiftleft(n2, 11) + F.shiftright(n1, 11)  # the upper 31 bits of the key
    jump = F.floor((state["at"] + 1).cast("double") * (F.lit(float(1 << 31)) / (high + 1).cast("double"))).cast("long")
    moved = F.struct(p0.bitwiseAND(LOW).alias("k0"), n1.alias("k1"), n2.alias("k2"), state["at"].alias("shard"), jump.alias("at"))
    return F.when(state["at"] < shards, moved).otherwise(state)


def jump(key: Column, shards: int) -> Column:
    """Struct of the key's ``shard`` below ``shards`` and ``at``, the shard count index it leaps to next.

    With one shard more, the key moves to the new shard exactly when ``at`` equals ``shards``.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    key, n = F.coalesce(key.cast("long"), F.lit(0)), F.lit(shards).cast("long")
    start = F.struct(
        key.bitwiseAND(LOW).alias("k0"), F.shiftright(key, LIMB).bitwiseAND(LOW).alias("k1"),
        F.shiftright(key, 2 * LIMB).bitwiseAND((1 << 20) - 1).alias("k2"),
        F.lit(-1).cast("long").alias("shard"), F.lit(0).cast("long").alias("at"))
    fold = lambda state, steps: F.aggregate(F.sequence(F.lit(1), F.lit(steps)), state, lambda s, _: _leap(s, n))
    some = F.transform(F.array(fold(start, min(shards, FIRST_LEAPS))),
                       lambda s: F.when(s["at"] < n, fold(s, shards)).otherwise(s))
    return some[0]


def assign(docs: DataFrame, shards: int, key: str = "doc_id") -> DataFrame:
    """``docs`` with ``shard`` and ``grown_shard``, the shard under one shard more.

    A key that isn't an integer is hashed first.
    """
    kind = docs.schema[key].dataType.typeName()
    number = F.col(key) if kind in ("byte", "short", "integer", "long") else F.xxhash64(F.col(key))
    placed = docs.withColumn("_jump", jump(number, shards))
    return placed.withColumn("shard", F.col("_jump.shard").cast("int")).withColumn(
        "grown_shard", F.when(F.col("_jump.at") == shards, F.lit(shards)).otherwise(F.col("_jump.shard")).cast("int")).drop("_jump")


def write_shards(docs: DataFrame, shards: int, path: str, key: str = "doc_id") -> None:
    """Write ``docs`` under ``path``, one folder per shard, many writers per shard."""
    assign(docs, shards, key).drop("grown_shard").write.partitionBy("shard").parquet(path)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard, size and place of every document in 24 shards."""
    sized = documents(spark, sf_dir).select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"))
    placed = assign(sized, 24)
    slotted = ordinals(placed, ["doc_id", "size", "text_crc32"], ["shard"], "slot", "shards")
    return slotted.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


OP10_SQL = """
WITH RECURSIVE leap AS (
  SELECT k, (k::HUGEINT + 18446744073709551616) % 18446744073709551616 AS key, -1::BIGINT AS shard, 0::BIGINT AS nxt
  FROM (SELECT DISTINCT coalesce(doc_id, 0) AS k FROM documents)
  UNION ALL
  SELECT k, nk, nxt, floor((nxt + 1) * (2147483648.0::DOUBLE / ((nk // 8589934592) + 1)::DOUBLE))::BIGINT
  FROM (SELECT k, nxt, (key * 2862933555777941757 + 1) % 18446744073709551616 AS nk FROM leap WHERE nxt < 24)
), done AS (SELECT k, shard, nxt FROM leap WHERE nxt >= 24),
crc_table AS (
  SELECT n, list_reduce(list_prepend(n::BIGINT, range(8)),
    lambda c, i: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) AS v
  FROM range(256) t(n)
), lut AS (SELECT list(v ORDER BY n) AS l FROM crc_table),
sized AS (
  SELECT doc_id, (coalesce(octet_length(encode(text)), 0) + 8)::BIGINT AS size,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(regexp_replace(hex(encode(coalesce(text, ''))), '(..)', '\\1,', 'g'), ',')[:-2],
      lambda h: ('0x' || h)::BIGINT)), lambda c, b: xor(c >> 8, l[(xor(c, b) % 256) + 1]))) AS text_crc32
  FROM documents, lut
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INT AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot,
  (CASE WHEN nxt = 24 THEN 24 ELSE shard END)::INT AS grown_shard
FROM sized JOIN done ON k = coalesce(doc_id, 0)
"""
