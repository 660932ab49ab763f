"""Operator 1 — mixing sources to target weights.

Words are summed by source, a share of all words is dealt to the sources by weight under a cap, and
every document is emitted floor(rate) times plus once more with probability rate - floor(rate),
where rate is target over size of its source. The extra copy is drawn from a hash of the seed and
the document's id, so reruns and recomputed tasks agree. Only built-in functions are used.

Defined results: null text has no words; null is a source of its own, ordered last; rows that share
an id are drawn alike; a source without words gets no target and its documents ``floor`` copies;
an empty table gives no rows; other columns pass through, columns named as those added are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pricemill.session import materialise

from .common import documents, ordinals, word_count

SEED = 20240611
# Fixed values of the production mix: weights by the source's place in code point order, the share
# of all words that the mix takes, and the most times a source's words may be repeated.
CYCLE, SHARE, CAP = (5, 2, 1), 1.5, 2.0


def draw(doc_id: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) fixed by seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def source_targets(docs: DataFrame, cycle: tuple = CYCLE, share: float = SHARE, cap: float = CAP, floor: float = 0.0) -> DataFrame:
    """One row per source: source, source_size, target and rate.

    Every source gets ``floor`` times its size; the rest of ``share`` times all words is dealt by
    weight, a target stops at ``cap`` times its source's size, and what a stopped source leaves is
    dealt to the others until none is above. A round of dealing is one sum over the table of sources.
    """
    if not 0 <= floor <= cap:
        raise ValueError("floor must lie between 0 and cap")
    sizes = docs.groupBy("source").agg(F.sum(word_count(F.col("text"))).alias("source_size"))
    keyed = sizes.withColumn("_null", F.col("source").isNull())
    ranked = materialise(ordinals(keyed.withColumn("_all", F.lit(1)), ["_null", "source"], ["_all"], "_rank", "sources").drop("_all", "_null"), "sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (F.col("_rank") % len(cycle) + 1).cast("int"))
    room = F.col("source_size") * (cap - floor)
    open_ = ranked.select("source", "source_size", weight.alias("_w"), room.alias("_room"))
    total, weights = open_.agg(F.sum("source_size"), F.sum("_w")).first()
    budget = max(share - floor, 0.0) * (total or 0)
    level, stopped = 0.0, -1
    while total:
        left, heavy, n = (open_.agg(
            F.coalesce(F.sum(F.when(F.col("_room") <= F.col("_w") * level, F.col("_room"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(F.col("_room") <= F.col("_w") * level, F.col("_w"))), F.lit(0.0)),
            F.count(F.when(F.col("_room") <= F.col("_w") * level, 1))).first()) if stopped >= 0 else (0.0, 0.0, 0)
        if n == stopped or heavy >= weights:
            break
        level, stopped = (budget - left) / (weights - heavy), n
    extra = F.least(F.col("_room"), F.col("_w") * level)
    target = F.col("source_size") * floor + extra
    return open_.select("source", "source_size", target.alias("target"),
                        F.when(F.col("source_size") > 0, F.least(target / F.col("source_size"), F.lit(float(cap)))).otherwise(F.lit(float(floor))).alias("rate"))


def plan_copies(docs: DataFrame, targets: DataFrame, seed: int = SEED) -> DataFrame:
    """``docs`` with source_size, target and copies: how often the mix takes each document."""
    # The table of sources was stored, so Spark knows its size and sends it to the tasks only while it is small.
    side = targets.withColumnRenamed("source", "_source")
    names = [c for c in docs.columns if c not in ("source_size", "target", "rate", "copies")]
    joined = docs.select(*names).join(side, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    whole = F.floor("rate")
    copies = whole + (draw(F.col("doc_id"), seed) < F.col("rate") - whole).cast("long")
    return joined.withColumn("copies", copies.cast("long")).drop("rate")


def mix(docs: DataFrame, seed: int = SEED, **deal) -> DataFrame:
    """The mixed corpus: every document repeated as often as the mix takes it; columns of ``docs``."""
    rows = docs.select("doc_id", "source", F.struct(*docs.columns).alias("_row"))  # whole, whatever its columns are called
    planned = plan_copies(rows, materialise(source_targets(docs, **deal), "targets"), seed)
    taken = planned.filter(F.col("copies") > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return taken.select("_row.*")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the production mix takes."""
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    planned = plan_copies(docs, materialise(source_targets(docs), "targets"))
    sized = planned.select("doc_id", "copies", "source_size", F.round("target", 6).alias("target"), word_count(F.col("text")).alias("size"))
    return sized.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP1_SQL = """
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
ranked AS (SELECT source, sum(size)::BIGINT AS source_size,
    list_extract([5, 2, 1], (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w
  FROM sized GROUP BY source),
laid AS (SELECT *, source_size * 2.0::DOUBLE AS room, 1.5::DOUBLE * sum(source_size) OVER () AS budget, sum(w) OVER () AS weights,
    coalesce(sum(source_size * 2.0::DOUBLE) OVER o, 0) AS full_before, coalesce(sum(w) OVER o, 0) AS w_before
  FROM ranked WINDOW o AS (ORDER BY source_size * 2.0::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT arg_min((budget - full_before) / (weights - w_before), room / w) FILTER (room * (weights - w_before) >= w * (budget - full_before)) AS lambda_ FROM laid),
targets AS (SELECT source, source_size, least(room, coalesce(w * lambda_, room)) AS target FROM laid, level),
rates AS (SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 2.0) ELSE 0 END AS rate FROM targets)
SELECT doc_id, size, source_size, round(target, 6) AS target,
  size * (floor(rate)::BIGINT + (CASE WHEN ('0x' || substr(md5('20240611:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END)) AS taken
FROM sized JOIN rates ON sized.source IS NOT DISTINCT FROM rates.source
"""
