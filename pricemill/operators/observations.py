"""Collected observations: flags, scores, dispositions, duplicate pointers, projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ordered import split_lag
from ..functions.scalars import canonical_json
from ..params import APW_WINDOWS
from ..session import materialise

# Fixed values.
CONFIDENCE = {
    "mock": 0.90, "public_api": 0.99, "structured_feed": 0.98, "static_html": 0.94, "embedded_json": 0.96,
    "playwright_network": 0.97, "playwright_dom": 0.93, "document": 0.92, "visual": 0.75,
}
DEFAULT_CONFIDENCE = 0.80
UNREALISTIC_FARE = 500_000
FRESHNESS_HOURS = 36
BUCKET_SECONDS = 60
OUTLIER_CODES = ("TUKEY_OUTLIER", "HAMPEL_OUTLIER", "UNREALISTIC_FARE")
UNKNOWN_CODES = ("UNKNOWN_AIRPORT", "UNKNOWN_CARRIER")
PARTS = ("base_fare", "taxes", "airport_fee", "udf", "convenience_fee", "other_fee")


def codes(*pairs: tuple[Column, str]) -> Column:
    """Array of the codes whose condition holds, in the given order."""
    return F.filter(F.array(*[F.when(cond, code) for cond, code in pairs]), lambda c: c.isNotNull())


def component_codes() -> Column:
    known = F.lit(True)
    for p in PARTS:
        known = known & F.col(p).isNotNull()
    total = F.col("total_fare")
    gap = F.abs(sum((F.col(p) for p in PARTS[1:]), F.col(PARTS[0])) - total)
    return codes(
        (total < F.col("base_fare"), "TOTAL_LT_BASE"),
        (known & (gap > F.lit("0.05").cast("decimal(12,2)")), "COMPONENT_MISMATCH"),
        (~known & (F.col("base_fare").isNull() | F.col("taxes").isNull()), "COMPONENTS_INCOMPLETE"),
    )


def plausibility_codes() -> Column:
    return codes((F.col("total_fare") == 0, "ZERO_FARE"), (F.col("total_fare") > UNREALISTIC_FARE, "UNREALISTIC_FARE"))


def universe_codes(df: DataFrame, airports: DataFrame, carriers: DataFrame) -> DataFrame:
    """Flag codes absent from the reference lists (airports(code), carriers(code))."""
    out = df
    for side, table in (("origin_airport", airports), ("destination_airport", airports), ("carrier", carriers)):
        known = table.select(F.upper("code").alias(f"_k_{side}")).distinct()
        out = out.join(known, F.upper(F.col(side)) == F.col(f"_k_{side}"), "left")
    missing = codes(
        (F.col("_k_origin_airport").isNull() | F.col("_k_destination_airport").isNull(), "UNKNOWN_AIRPORT"),
        (F.col("_k_carrier").isNull(), "UNKNOWN_CARRIER"))
    return out.withColumn("universe_flags", missing).drop("_k_origin_airport", "_k_destination_airport", "_k_carrier")


def validate(df: DataFrame, airports: DataFrame, carriers: DataFrame) -> DataFrame:
    """All row-level flags, in the order airports, carriers, components, plausibility."""
    return universe_codes(df, airports, carriers).withColumn(
        "flags", F.concat("universe_flags", component_codes(), plausibility_codes())).drop("universe_flags")


def validation_disposition(excluding: Sequence[str] = ()) -> Column:
    """excluded, flagged or valid from the flags of a row; no shipped code excludes by itself."""
    hit = F.exists("flags", lambda c: c.isin(list(excluding)))
    return F.when(hit, "excluded").when(F.size("flags") > 0, "flagged").otherwise("valid")


def is_stale(now: str, hours: int = FRESHNESS_HOURS) -> Column:
    """Older than the limit at an explicit moment."""
    return F.col("collected_at") < F.lit(now).cast("timestamp") - F.make_dt_interval(hours=F.lit(hours))


def publication_disposition(stale: Column | None = None, winsorised: Column | None = None,
                            excluding: Sequence[str] = ()) -> Column:
    """Precedence: excluded or unknown, sold out, stale, zero fare, outlier, accepted."""
    def has(names: Sequence[str]) -> Column:
        return F.arrays_overlap("flags", F.array(*[F.lit(n) for n in names])) if names else F.lit(False)

    return (
        F.when(has((*excluding, *UNKNOWN_CODES)), "EXCLUDED")
        .when(F.col("availability") == "sold_out", "QUARANTINED")
        .when(has(("STALE_QUOTE",)) | (stale if stale is not None else F.lit(False)), "QUARANTINED")
        .when(has(("ZERO_FARE",)), "EXCLUDED")
        .when(has(OUTLIER_CODES) | (winsorised if winsorised is not None else F.lit(False)), "WINSORISED")
        .otherwise("ACCEPTED")
    )


def quality_score() -> Column:
    base = F.coalesce(*[F.when(F.col("collector") == k, F.lit(v)) for k, v in CONFIDENCE.items()], F.lit(DEFAULT_CONFIDENCE))
    return F.greatest(F.round(base - 0.02 * F.size("flags"), 2), F.lit(0.10))


def to_quote(df: DataFrame, price: str = "total_fare", disposition: str = "disposition") -> DataFrame:
    return df.select(
        F.col("booking_date").alias("collected_date"), F.col("travel_date").alias("departure_date"),
        F.concat_ws("-", "origin_airport", "destination_airport").alias("route"), "carrier",
        F.col("lead_time_days").alias("apw_days"), "flight_number",
        F.coalesce(F.nullif(F.col("fare_brand"), F.lit("")), F.lit("UNKNOWN")).alias("fare_family"),
        F.col("cabin_class").alias("cabin"), F.lit(0).alias("stops"), F.col(price).cast("double").alias("price"),
        (F.col("availability") == "sold_out").alias("is_sold_out"), F.upper(disposition).alias("disposition"))


def duplicate_key(df: DataFrame, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """SHA-256 of the canonical identity of an observation within a time bucket."""
    seconds = F.unix_seconds("collected_at")
    named = {
        "bucket": seconds - F.pmod(seconds, F.lit(bucket_seconds)), "carrier": F.col("carrier"),
        "departure_time": F.col("departure_time") if "departure_time" in df.columns else F.lit(None).cast("string"),
        "destination": F.col("destination_airport"),
        "fare_class": F.col("fare_class") if "fare_class" in df.columns else F.lit(None).cast("string"),
        "flight_number": F.col("flight_number"), "origin": F.col("origin_airport"), "source": F.col("source"),
        "total_fare": F.col("total_fare").cast("decimal(12,2)").cast("string"), "travel_date": F.col("travel_date").cast("string"),
    }
    body = F.to_json(F.struct(*[named[k].alias(k) for k in sorted(named)]), {"ignoreNullFields": "false"})
    return df.withColumn("duplicate_key", F.sha2(body, 256))


def identity_hash(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumn("identity_hash", F.sha2(canonical_json(*columns), 256))


def duplicate_pointers(df: DataFrame, key: str = "duplicate_key", at: str = "collected_at", ident: str = "observation_id",
                       slice_seconds: int = 900) -> DataFrame:
    """First and previous observation of the same key, by collection time.

    A key may be held by very many copies: the first comes from a partial aggregate, the previous
    from a look-back evaluated one time slice after the other.
    """
    first = df.groupBy(key).agg(F.min(F.struct(F.col(at), F.col(ident))).alias("_first"))
    slices = F.floor(F.unix_seconds(F.col(at).cast("timestamp")) / slice_seconds)
    return (
        split_lag(df, [key], [at, ident], ident, "supersedes_id", slices)
        .join(first, key)
        .withColumn("duplicate_of_id", F.when(F.col("_first")[ident] != F.col(ident), F.col("_first")[ident]))
        .drop("_first")
    )


def latest_fares(df: DataFrame, identity: Sequence[str], at: str = "collected_at") -> DataFrame:
    """Rows at the newest collection time of their identity; all tied rows are kept.

    ``df`` is read twice. The newest times are written, so that the join knows their size.
    """
    newest = materialise(df.groupBy(*identity).agg(F.max(at).alias("_newest")), "newest")
    return df.join(newest, list(identity)).where(F.col(at) == F.col("_newest")).drop("_newest")


def newest(df: DataFrame, limit: int, at: str = "collected_at", tie: Sequence[str] = ()) -> DataFrame:
    """The ``limit`` newest rows, for a report of at most 200."""
    if not 1 <= int(limit) <= 200:
        raise ValueError(f"limit must lie between 1 and 200, got {limit!r}")
    return df.orderBy(F.desc(at), *tie).limit(int(limit))


def of_job(observations: DataFrame, raw: DataFrame, job_id) -> DataFrame:
    """Observations whose raw record belongs to the job."""
    return observations.join(raw.where(F.col("job_id") == job_id).select("raw_id"), "raw_id", "left_semi")


def reject_reasons(windows: Sequence[int] = APW_WINDOWS) -> Column:
    """Why a fare query is not well formed; empty when it is."""
    iata = "^[A-Z]{3}$"
    return codes(
        (~F.col("origin").rlike(iata), "BAD_ORIGIN"),
        (~F.col("destination").rlike(iata), "BAD_DESTINATION"),
        (~F.col("currency").rlike(iata), "BAD_CURRENCY"),
        (F.col("origin") == F.col("destination"), "SAME_AIRPORT"),
        (~F.col("lead_time_days").isin(list(windows)), "LEAD_NOT_ALLOWED"),
        (F.datediff("travel_date", "observation_date") != F.col("lead_time_days"), "DATES_DISAGREE"),
    )


def collection_plan(routes: DataFrame, observation_date: Column, windows: Sequence[int] = APW_WINDOWS) -> DataFrame:
    """One planned query per route row and lead window."""
    return (
        routes.withColumn("lead_time_days", F.explode(F.array(*[F.lit(w) for w in windows])))
        .withColumn("observation_date", observation_date)
        .withColumn("travel_date", F.date_add("observation_date", F.col("lead_time_days")))
    )


def both_directions(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Undirected pairs to both directed ones."""
    rest = [c for c in pairs.columns if c not in (a, b)]
    ends = F.array(F.struct(F.col(a).alias("origin"), F.col(b).alias("destination")),
                   F.struct(F.col(b).alias("origin"), F.col(a).alias("destination")))
    return pairs.select(*rest, F.explode(ends).alias("_e")).select(*rest, "_e.*").distinct()


def lineage(starts: DataFrame, edges: DataFrame, depth: int = 4) -> DataFrame:
    """Ancestors of (kind, id) rows along child-to-parent edges, one equi join per level.

    ``edges`` is (child_kind, child_id, parent_kind, parent_id); each level keeps its distance.
    """
    level = starts.select("kind", "id", F.col("kind").alias("root_kind"), F.col("id").alias("root_id"))
    out = level.withColumn("depth", F.lit(0))
    for d in range(1, depth + 1):
        level = (
            level.join(edges, (F.col("kind") == F.col("child_kind")) & (F.col("id") == F.col("child_id")))
            .select(F.col("parent_kind").alias("kind"), F.col("parent_id").alias("id"), "root_kind", "root_id")
        )
        out = out.unionByName(level.withColumn("depth", F.lit(d)))
    return out
