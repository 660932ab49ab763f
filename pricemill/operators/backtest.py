"""Agreement between index series and reference series, for many pairs at once.

Input is long: series (series, period, value), comparators (comparator, period, idx) and the list of
pairs to compare. Windows below run over the months of one pair, so a group is as long as the calendar.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

PAIR = ["series", "comparator"]
MIN_MONTHS = 6
MIN_OVERLAP = 3
# Metrics that may be compared with an index.
COMPATIBLE = {
    "dgca": ("average_fare", "fare", "yield", "avg_fare", "passengers", "traffic"),
    "cpi": ("cpi_air_fare", "cpi", "air_fare", "airfare", "index"),
}


def monthly(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key, F.date_trunc("month", "period").cast("date").alias("period")).agg(F.avg(value).alias(value))


def align(series: DataFrame, comparators: DataFrame, pairs: DataFrame) -> DataFrame:
    """(series, comparator, period, x, y) on the months both have."""
    x = monthly(series, "series", "value").withColumnRenamed("value", "x")
    y = monthly(comparators, "comparator", "idx").withColumnRenamed("idx", "y")
    return pairs.join(x, "series").join(y, ["comparator", "period"]).where(F.col("x").isNotNull() & F.col("y").isNotNull())


def average_rank(value: str, w: W, by: Sequence[str]) -> Column:
    ties = F.count(F.lit(1)).over(W.partitionBy(*by, value))
    return F.rank().over(w.orderBy(value)) + (ties - 1) / 2.0


def correlation(x: str, y: str) -> Column:
    """Null below three pairs or when a side does not vary."""
    n = F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1))
    return F.when((n >= 3) & (F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0), F.corr(x, y))


def changes(aligned: DataFrame) -> DataFrame:
    """Month-on-month log changes, level moves, rebased levels and average ranks of each pair."""
    w = W.partitionBy(*PAIR)
    t = w.orderBy("period")
    def log_move(c: str) -> Column:
        return F.when((F.col(c) > 0) & (F.lag(c).over(t) > 0), F.ln(c) - F.ln(F.lag(c).over(t)))
    out = aligned.withColumns({
        "dlx": log_move("x"), "dly": log_move("y"),
        "mx": F.col("x") - F.lag("x").over(t), "my": F.col("y") - F.lag("y").over(t),
        "rx": 100 * F.col("x") / F.first("x").over(t), "ry": 100 * F.col("y") / F.first("y").over(t),
        "rank_x": average_rank("x", w, PAIR), "rank_y": average_rank("y", w, PAIR),
    })
    has = F.col("dlx").isNotNull() & F.col("dly").isNotNull()
    moved = out.withColumn("_has", has)
    flag = [*PAIR, "_has"]
    wm = W.partitionBy(*flag)
    return moved.withColumns({
        "rank_dlx": F.when(F.col("_has"), average_rank("dlx", wm, flag)),
        "rank_dly": F.when(F.col("_has"), average_rank("dly", wm, flag)),
    }).drop("_has")


def statistics(aligned: DataFrame, synthetic: bool = False, level: str = "item") -> DataFrame:
    """All agreement statistics of each pair; null under the minimum overlap."""
    c = changes(aligned)
    d = F.col("rx") - F.col("ry")
    bias, sd = F.avg(d), F.stddev_samp(d)
    same = (F.signum("mx") == F.signum("my")).cast("double")
    n = F.count(F.lit(1))
    stats = {
        "pearson_r_level": correlation("x", "y"),
        "spearman_rho_level": correlation("rank_x", "rank_y"),
        "pearson_r_mom_change": correlation("dlx", "dly"),
        "spearman_rho_mom_change": correlation("rank_dlx", "rank_dly"),
        "bias": bias, "sd_diff": sd, "loa_low": bias - 1.96 * sd, "loa_high": bias + 1.96 * sd, "mean_abs_diff": F.avg(F.abs(d)),
        "directional_agreement_pct": 100 * F.avg(same),
        # OLS of y on x: mean squared residual = var(y) - cov^2 / var(x).
        "rmse_model": F.sqrt(F.greatest(F.var_pop("y") - F.coalesce(F.try_divide(
            F.covar_pop("x", "y") * F.covar_pop("x", "y"), F.nullif(F.var_pop("x"), F.lit(0.0))), F.lit(0.0)), F.lit(0.0))),
        "rmse_random_walk": F.sqrt(F.avg(F.col("my") * F.col("my"))),
    }
    out = c.groupBy(*PAIR).agg(n.alias("n_overlapping_months"), F.count("mx").alias("n_moves"), *[v.alias(k) for k, v in stats.items()])
    out = out.withColumn("reportable", F.col("n_overlapping_months") >= MIN_MONTHS)
    for k in stats:
        out = out.withColumn(k, F.when(F.col("reportable"), F.col(k)))
    caveats = F.filter(F.array(
        F.when(F.lit(level != "item"), "comparator is an aggregate, not the fare item"),
        F.when(F.lit(synthetic), "index side is synthetic"),
        F.when(~F.col("reportable"), "too few overlapping months")), lambda x: x.isNotNull())
    return out.withColumns({
        "skill_vs_rw_pct": F.when(F.col("rmse_random_walk") > 0, 100 * (1 - F.col("rmse_model") / F.col("rmse_random_walk"))),
        "caveats": caveats})


def lead_lag(aligned: DataFrame) -> DataFrame:
    """Correlation of x[t + lag] with y[t] for lags -L..L, L = min(6, max(1, n // 3)).

    A positive lag therefore means that the comparator leads; the column name says so.
    """
    w = W.partitionBy(*PAIR)
    rows = aligned.withColumn("rn", F.row_number().over(w.orderBy("period"))).withColumn("n", F.count(F.lit(1)).over(w))
    reach = F.least(F.lit(6), F.greatest(F.lit(1), F.floor(F.col("n") / 3))).cast("int")
    left = rows.select(*PAIR, "x", F.col("rn").alias("rx"), F.explode(F.sequence(-reach, reach)).alias("b_leads_a_by"))
    left = left.withColumn("rn", F.col("rx") - F.col("b_leads_a_by"))
    return (
        left.join(rows.select(*PAIR, "rn", "y"), [*PAIR, "rn"])
        .groupBy(*PAIR, "b_leads_a_by")
        .agg(correlation("x", "y").alias("corr"), F.count(F.lit(1)).alias("n"))
        .where("n >= 3")
    )


def best_lag(lags: DataFrame) -> DataFrame:
    """Largest absolute correlation; the smallest lag wins a tie."""
    score = F.struct(F.abs("corr"), -F.col("b_leads_a_by"))
    return (
        lags.where(F.col("corr").isNotNull()).groupBy(*PAIR)
        .agg(F.max_by(F.struct("b_leads_a_by", "corr", "n"), score).alias("_b")).select(*PAIR, "_b.*")
    )


def compare_run(published: DataFrame, reference: DataFrame, dataset: str) -> DataFrame:
    """The run-versioned back-test: status, Pearson r and MAPE per series.

    published (series, period, value), reference (dataset, period, metric, value).
    """
    usable = reference.where((F.col("dataset") == dataset) & F.col("metric").isin(*COMPATIBLE.get(dataset, ())) & F.col("value").isNotNull())
    official = usable.groupBy(F.date_trunc("month", "period").cast("date").alias("month")).agg(F.avg("value").alias("official"))
    rows = published.withColumn("month", F.date_trunc("month", "period").cast("date"))
    pairs = rows.join(official, "month", "left")
    both = F.col("official").isNotNull()
    any_official = official.agg(F.count(F.lit(1)).alias("n")).scalar()
    ape = F.when(F.col("official") != 0, F.abs(F.col("value") - F.col("official")) / F.abs("official"))
    stats = pairs.withColumn("_x", F.when(both, F.col("value"))).groupBy("series").agg(
        F.count_if(both).alias("overlap_months"), correlation("_x", "official").alias("correlation"), (100 * F.avg(ape)).alias("mape"))
    status = F.when(any_official == 0, "unavailable").when(F.col("overlap_months") < MIN_OVERLAP, "not_reportable").otherwise("reportable")
    out = stats.withColumn("status", status)
    for c in ("correlation", "mape"):
        out = out.withColumn(c, F.when(F.col("status") == "reportable", F.col(c)))
    return out


def long_form(stats: DataFrame, run_id: str) -> DataFrame:
    """(run, pair, statistic, value) rows for the result store."""
    names = [f.name for f in stats.schema.fields if f.dataType.typeName() == "double"]
    return stats.unpivot(PAIR, names, "statistic", "value").withColumn("run_id", F.lit(run_id))
