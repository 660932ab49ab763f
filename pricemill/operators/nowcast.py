"""Bridge regressions from index growth to year-on-year inflation, for many series at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from . import ols
from .backtest import PAIR, monthly

MIN_OBS = 24
MIN_OBS_PER_PARAM = 8


def build_design(series: DataFrame, cpi: DataFrame, pairs: DataFrame, index_lags: Sequence[int] = (0, 1), cpi_lags: Sequence[int] = (1,),
                 fuel: DataFrame | None = None) -> DataFrame:
    """Inflation target, index growth and their lags per pair, on the comparator's months."""
    x = monthly(series, "series", "value")
    y = monthly(cpi, "comparator", "idx")
    rows = pairs.join(y, "comparator").join(x, ["series", "period"], "left")
    t = W.partitionBy(*PAIR).orderBy("period")

    def log_gap(c: str, k: int):
        return F.when((F.col(c) > 0) & (F.lag(c, k).over(t) > 0), 100 * (F.ln(c) - F.ln(F.lag(c, k).over(t))))

    if fuel is not None:
        monthly_fuel = fuel.groupBy(F.date_trunc("month", "period").cast("date").alias("period")).agg(F.avg("price").alias("fuel"))
        rows = rows.join(monthly_fuel, "period", "left")
    cols = {"cpi_infl": log_gap("idx", 12), "growth": log_gap("value", 1)}
    if fuel is not None:
        cols["fuel_growth"] = log_gap("fuel", 1)
    rows = rows.withColumns(cols)
    lags = {f"growth_l{j}": F.lag("growth", j).over(t) if j else F.col("growth") for j in index_lags}
    lags |= {f"cpi_infl_l{k}": F.lag("cpi_infl", k).over(t) for k in cpi_lags}
    return rows.withColumns(lags)


def regressors(design: DataFrame) -> list[str]:
    return [c for c in design.columns if c.startswith(("growth_l", "cpi_infl_l", "fuel_growth"))]


def fit(design: DataFrame, xs: Sequence[str] | None = None, synthetic: bool = False) -> DataFrame:
    """OLS per pair with the guards that decide whether it may be read."""
    xs = list(xs or regressors(design))
    out = ols.fit(design, PAIR, "cpi_infl", xs)
    reasons = F.filter(F.array(
        F.when(F.col("n") < MIN_OBS, "fewer than 24 observations"),
        F.when(F.col("n") < MIN_OBS_PER_PARAM * F.col("k"), "fewer than 8 observations per parameter"),
        F.when(F.lit(synthetic), "index side is synthetic")), lambda r: r.isNotNull())
    names = F.array(F.lit("const"), *[F.lit(x) for x in xs])
    return out.withColumns({
        "names": names, "t": F.zip_with("beta", "se", lambda b, s: F.when(s > 0, b / s)), "reasons": reasons,
        "interpretable": F.size(reasons) == 0, "in_sample_rmse": F.sqrt(F.col("rss") / F.col("n"))})


def out_of_sample(design: DataFrame, xs: Sequence[str], min_train: int | None = None, min_oos: int = 6) -> DataFrame:
    """Expanding-window one-step errors against the no-change forecast; null where fewer than ``min_oos`` forecasts exist."""
    xs = list(xs)
    start = max(12, len(xs) + 3) if min_train is None else min_train
    usable = design
    for c in ("cpi_infl", *xs):
        usable = usable.where(F.col(c).isNotNull())
    steps = ols.expanding(usable, PAIR, "period", "cpi_infl", xs, start)
    err, naive = F.col("actual") - F.col("predicted"), F.col("actual") - F.col("naive")
    out = steps.groupBy(*PAIR).agg(
        F.count(F.lit(1)).alias("n_oos"), F.sqrt(F.avg(err * err)).alias("rmse_model"), F.sqrt(F.avg(naive * naive)).alias("rmse_no_change"))
    enough = F.col("n_oos") >= min_oos
    out = out.withColumns({c: F.when(enough, F.col(c)) for c in ("rmse_model", "rmse_no_change")})
    return out.withColumns({
        "skill_vs_benchmark_pct": F.when(F.col("rmse_no_change") > 0, 100 * (1 - F.col("rmse_model") / F.col("rmse_no_change"))),
        "beats_benchmark": F.col("rmse_model") < F.col("rmse_no_change")})


def granger(design: DataFrame, cause: str = "growth_l1", target: str = "cpi_infl", lags: int = 2) -> DataFrame:
    """F-test of the lags of ``cause`` beside the target's own; not testable on short samples."""
    t = W.partitionBy(*PAIR).orderBy("period")
    rows = design.where(F.col(target).isNotNull() & F.col(cause).isNotNull()).select(*PAIR, "period", F.col(target).alias("y"), F.col(cause).alias("x"))
    rows = rows.withColumns({f"{c}{k}": F.lag(c, k).over(t) for c in ("y", "x") for k in range(1, lags + 1)})
    own, other = [f"y{k}" for k in range(1, lags + 1)], [f"x{k}" for k in range(1, lags + 1)]
    rows = rows.where(F.col(f"y{lags}").isNotNull())
    small = ols.fit(rows, PAIR, "y", own).select(*PAIR, F.col("rss").alias("rss_r"))
    full = ols.fit(rows, PAIR, "y", [*own, *other]).select(*PAIR, "n", F.col("rss").alias("rss_u"))
    df2 = F.col("n") - (2 * lags + 1)
    testable = (F.col("n") >= 4 * (2 * lags + 1)) & (df2 > 0) & (F.col("rss_u") > 0)
    stat = ((F.col("rss_r") - F.col("rss_u")) / lags) / (F.col("rss_u") / df2)
    return (
        full.join(small, PAIR)
        .withColumns({"testable": testable, "df1": F.lit(lags), "df2": df2, "f_stat": F.when(testable, stat)})
        .withColumn("p_value", ols.f_tail_udf(F.col("f_stat"), F.col("df1").cast("double"), F.col("df2").cast("double")))
        .drop("rss_r", "rss_u")
    )
