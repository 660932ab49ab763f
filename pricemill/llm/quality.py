"""Operator 6 — quality rules by weak supervision.

Every rule looks at one measure of a text and votes good (1), bad (-1) or abstains (0).
Expectation-maximisation on the table of vote patterns — at most 3 ** rules rows, however large the
corpus — estimates every rule's two accuracies: how often it votes bad on a bad document, and good on
a good one. An abstention says nothing. A document is kept when the posterior probability of being
good, given all its votes, is at least one half: a bad vote of a rule that often errs is overruled by good
votes, two bad votes of independent rules seldom are.
Only built-in functions are used; the text is read once, and the measures are stored.

Defined results: null counts as the empty text, which has no words and fails the base rule; repeated
rows are judged alike; an empty table gives no rows; ``judge`` replaces columns named as those it adds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pricemill.session import materialise

from .common import WORD, documents, let

# rule: (measure, bad when above, good when below); a negative sign turns the measure around. Thresholds are set where some clean texts
# are called bad too: a rule that never errs would be a filter of its own. Rules on repetition look at different texts, so that one
# fault isn't counted twice.
RULES = {
    "symbols": ("n_symbols / n_words", 0.1, 0.02),
    "long_words": ("word_chars / n_words", 7.5, 6.5),
    "short_words": ("-word_chars / n_words", -4.2, -4.6),
    "few_letters": ("n_marks / word_chars", 0.1, 0.06),
    "same_lines": ("if(n_lines < 3, null, n_dup_lines / n_lines)", 0.3, 0.1),
    "repeats": ("if(n_dup_lines > 0, null, n_repeat_words / n_words)", 0.2, 0.05),
    "shouting": ("n_shouted / n_words", 0.02, 0.005),
    "marks": ("n_mark_runs / n_words", 0.02, 0.005),
    "few_words": ("if(n_dup_lines > 0, null, -n_distinct / sqrt(n_words))", -6.0, -8.0),
    "open_lines": ("if(n_lines < 3, null, -n_closed_lines / n_lines)", -0.8, -0.95),
    "digits": ("n_digits / word_chars", 0.03, 0.01),
    "bare_marks": ("n_bare / n_words", 0.05, 0.01),
}
# Before any document is seen: how often a rule that votes calls a good and a bad document bad, the share of good
# documents, and the weight of this belief as a share of all documents (``LEAST_WEIGHT`` documents at least). It is a prior
# only: a rate may come to lie anywhere.
PRIOR_FALSE, PRIOR_CAUGHT, PRIOR_SHARE, PRIOR_WEIGHT, LEAST_WEIGHT = 0.05, 0.4, 0.85, 0.01, 20.0
ROUNDS, CLOSE = 100, 1e-6


def _left(x: Column, bits: Column) -> Column:
    return F.call_function("shiftleft", x, bits)


def _right(x: Column, bits: Column) -> Column:
    return F.call_function("shiftrightunsigned", x, bits)


def repeated_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more in the text, the first one included.

    Window hashes are sorted with their places in the low bits; neighbours of the same hash, confirmed
    word by word, are the repeats, and the gaps between their places give the words they cover.
    """
    n = F.size(words)
    windows = n - 2

    def with_bits(bits: Column) -> Column:
        place = lambda x: x.bitwiseAND(_left(F.lit(1).cast("long"), bits) - 1).cast("int")
        packed = F.sort_array(F.transform(F.sequence(F.lit(0), windows - 1), lambda i: _left(
            F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)), bits).bitwiseOR(i.cast("long"))))

        def covered(sorted_: Column) -> Column:
            def same(x: Column, y: Column) -> Column:
                at = [(place(x) + k, place(y) + k) for k in range(3)]
                words_agree = [F.get(words, a) == F.get(words, b) for a, b in at]
                return (_right(x, bits) == _right(y, bits)) & words_agree[0] & words_agree[1] & words_agree[2]

            twice = F.filter(sorted_, lambda x, i: same(x, F.get(sorted_, i - 1)) | same(x, F.get(sorted_, i + 1)))
            return let(F.sort_array(F.transform(twice, place)), lambda p: F.aggregate(
                F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3)))), F.lit(0), lambda a, b: a + b))

        return let(packed, covered)

    return F.when(n >= 3, let(F.length(F.bin(n)).cast("int"), with_bits)).otherwise(0)


def measures(text: Column) -> Column:
    """Struct of the counts that the rules read."""
    text = F.coalesce(text, F.lit(""))

    def of(t: Column) -> Column:
        words = F.regexp_extract_all(t, F.lit(WORD), F.lit(0))
        lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, " \t\x0b\f\r", "")) > 0)

        def by_words(w: Column, rows: Column) -> Column:
            long = lambda c: c.cast("long")
            return F.struct(
                long(F.size(w)).alias("n_words"), long(F.length(F.array_join(w, ""))).alias("word_chars"),
                long(F.regexp_count(t, F.lit(r"[#*$%&|<>]"))).alias("n_symbols"),
                long(F.size(rows) - F.size(F.array_distinct(rows))).alias("n_dup_lines"),
                long(repeated_words(w)).alias("n_repeat_words"), long(F.size(rows)).alias("n_lines"),
                long(F.size(F.array_distinct(w))).alias("n_distinct"),
                long(F.regexp_count(t, F.lit(r"(?<!\p{L})\p{Lu}{2,}(?!\p{L})"))).alias("n_shouted"),
                long(F.regexp_count(t, F.lit(r"[!?]{2,}"))).alias("n_mark_runs"),
                long(F.regexp_count(t, F.lit(r"[0-9]"))).alias("n_digits"),
                long(F.regexp_count(t, F.lit(r"[^\p{L}\p{M}\p{N}\s]"))).alias("n_marks"),
                long(F.size(F.filter(w, lambda x: (F.length(x) <= 3) & ~x.rlike(r"[\p{L}\p{N}]")))).alias("n_bare"),
                long(F.size(F.filter(rows, lambda x: x.rlike(r"[.!?:;\"»)…。！？]\s*$")))).alias("n_closed_lines"))

        return let(words, lambda w: let(lines, lambda rows: by_words(w, rows)))

    return let(text, of)


def votes(low_words: int = 20) -> list[Column]:
    """One vote per rule; texts of fewer than ``low_words`` words get no vote from shares."""
    return [F.when(F.col("n_words") < low_words, 0).when(F.expr(f"{m} > {bad}"), -1).when(F.expr(f"{m} < {good}"), 1)
            .otherwise(0).cast("tinyint").alias(rule) for rule, (m, bad, good) in RULES.items()]


def posterior(model: dict) -> Column:
    """Probability of a good document given its votes; ``model`` has share, and (false, caught) by rule."""
    total = F.lit(math.log(model["share"] / (1 - model["share"])))
    for rule, (false, caught) in model["rules"].items():
        total = total + F.when(F.col(rule) == 1, math.log((1 - false) / (1 - caught))).when(
            F.col(rule) == -1, math.log(false / caught)).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def fit(patterns: DataFrame, rounds: int = ROUNDS) -> dict:
    """Expectation-maximisation on (votes, documents); a round is one sum over the pattern table."""
    model = {"share": PRIOR_SHARE, "rules": {r: (PRIOR_FALSE, PRIOR_CAUGHT) for r in RULES}}
    # At most 3 ** rules rows; one ordered partition makes the sums the same in every run.
    table = materialise(patterns.coalesce(1).sortWithinPartitions(*RULES), "vote-patterns")
    for _ in range(rounds):
        p, n = posterior(model), F.col("documents")
        weighed = table.withColumn("_good", p * n).withColumn("_bad", (1 - p) * n)
        cells = [F.sum(F.when(F.col(r) == v, F.col(side)).otherwise(0.0)).alias(f"{side}:{r}:{v}")
                 for side in ("_good", "_bad") for r in RULES for v in (1, -1)]
        got = weighed.agg(F.sum("_good").alias("g"), F.sum("_bad").alias("b"), *cells).first().asDict()
        if got["g"] is None:
            return model
        weight = max(LEAST_WEIGHT, PRIOR_WEIGHT * (got["g"] + got["b"]))

        def rate(side: str, rule: str, prior: float) -> float:
            bad, good = got[f"{side}:{rule}:-1"], got[f"{side}:{rule}:1"]
            return (bad + weight * prior) / (bad + good + weight)

        new = {"share": (got["g"] + weight * PRIOR_SHARE) / (got["g"] + got["b"] + weight),
               "rules": {r: (rate("_good", r, PRIOR_FALSE), rate("_bad", r, PRIOR_CAUGHT)) for r in RULES}}
        moved = abs(new["share"] - model["share"]) + sum(
            abs(x - y) for r in RULES for x, y in zip(new["rules"][r], model["rules"][r]))
        model = new
        if moved < CLOSE:
            break
    return model


def judge(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the text, with the measures, ``base_failed``, ``quality`` and ``kept``."""
    rest = [F.col(c) for c in docs.columns if c != text]
    measured = docs.select(*rest, measures(F.col(text)).alias("_m"))
    names = [f.name for f in measured.schema["_m"].dataType.fields]
    plain = measured.select(*[F.col(c) for c in measured.columns if c not in ("_m", *names, *RULES)], *[F.col(f"_m.{n}") for n in names])
    stored = materialise(plain.select("*", *votes()), "quality-measures")
    model = fit(stored.groupBy(*RULES).agg(F.count(F.lit(1)).alias("documents")))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return stored.withColumn("base_failed", failed).withColumn("quality", posterior(model)).withColumn(
        "kept", ~failed & (F.col("quality") >= 0.5))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict of every document."""
    return judge(documents(spark, sf_dir).select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("quality", 6).alias("quality"))
