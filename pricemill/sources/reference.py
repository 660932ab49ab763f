"""Reference series: price-index and traffic-fare CSV files, their catalogues, the calendar."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.scalars import parse_month
from ..schemas import CPI_TIDY
from ..session import materialise
from .quotes import path_exists

# Header spellings and the depth order of the item hierarchy.
LEVELS = ("item", "sub_class", "class", "subgroup", "group", "division")
CPI_REQUIRED = {"year", "month", "state", "sector", "index"}
PERIOD_NAMES = ("period", "month", "date")
FARE_NAMES = ("average_fare", "avg_fare", "fare", "yield")
PASSENGER_NAMES = ("passengers", "pax", "traffic")


def normalised_headers(df: DataFrame) -> DataFrame:
    names = [c.replace("﻿", "").strip().lower().replace(" ", "_") for c in df.columns]
    return df.toDF(*names)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text with tidy headers; a byte-order mark is dropped."""
    return normalised_headers(spark.read.option("header", True).option("encoding", "UTF-8").csv(path))


# Columns of the widest file; names of which two make a line a header.
WIDEST = 64
CPI_NAMES = sorted({*CPI_REQUIRED, *LEVELS, "code", "inflation"})


def load_cpi(spark: SparkSession, paths: dict[str, int]) -> tuple[DataFrame, dict[str, str]]:
    """Tidy union of the usable files (path -> base year), and why the others were skipped.

    All files, or folders of them, are one scan, however many there are. A line that names two columns or more is its file's header; the table of
    headers, one row per file, tells where each column lies. A file that can't be read at all is an error.
    """
    there = {p: y for p, y in paths.items() if path_exists(spark, p)}
    skipped = {p: "unreadable: no such file" for p in paths if p not in there}
    if not there:
        return spark.createDataFrame([], CPI_TIDY), skipped
    cells = [f"_c{i}" for i in range(WIDEST)]
    lines = spark.read.schema(", ".join(f"{c} string" for c in cells)).option("encoding", "UTF-8").csv(list(there))
    named = F.transform(F.array(*cells), lambda c: F.regexp_replace(F.lower(F.trim(F.regexp_replace(c, "\ufeff", ""))), " ", "_"))
    # As Hadoop writes it; the path is escaped but for plus signs.
    at = F.regexp_replace(F.url_decode(F.regexp_replace("_metadata.file_path", r"\+", "%2B")), "^file:/+", "file:/")
    lines = lines.select(at.alias("file"), F.array(*cells).alias("values"), named.alias("names"))
    header = F.size(F.array_intersect("names", F.array(*map(F.lit, CPI_NAMES)))) >= 2
    headers = lines.where(header).groupBy("file").agg(F.first("names").alias("names"))
    given = spark.createDataFrame([(_qualified(spark, p), p, y) for p, y in there.items()], "at string, path string, base_year int")
    either = F.explode(F.array("file", F.regexp_replace("file", "/[^/]*$", "")))  # the file itself or its folder was given
    files = lines.select("file").distinct().join(headers, "file", "left").select("*", either.alias("at")).join(given, "at")
    lacking = F.array_except(F.array(*[F.lit(c) for c in sorted(CPI_REQUIRED)]), F.coalesce("names", F.array().cast("array<string>")))
    files = materialise(files.select("file", "path", "base_year", "names", lacking.alias("lacking")), "cpi-files")
    wrong = files.where(F.size("lacking") > 0).groupBy("path").agg(F.min(F.array_join("lacking", ", ")).alias("lacking"))
    skipped.update({r["path"]: f"missing columns: {r['lacking']}" for r in wrong.collect()})  # a row per skipped file
    empty = given.join(files.select("path").distinct(), "path", "left_anti")
    skipped.update({r["path"]: "missing columns: " + ", ".join(sorted(CPI_REQUIRED)) for r in empty.collect()})
    usable = files.where(F.size("lacking") == 0).select("file", F.element_at(F.split("path", "/"), -1).alias("source_file"), "base_year", F.col("names").alias("heads"))
    rows = lines.where(~header).join(usable, "file")
    wanted = ["year", "month", "state", "sector", "index", "code", "inflation", *LEVELS]
    place = lambda c: F.array_position("heads", F.lit(c)).cast("int")
    raw = rows.select("base_year", "source_file", *[F.when(place(c) > 0, F.get("values", place(c) - 1)).alias(c) for c in wanted])
    return tidy_cpi(raw, F.col("base_year"), F.col("source_file")), skipped


def _qualified(spark: SparkSession, path: str) -> str:
    """The full path, with scheme."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).getPath().toString()


def tidy_cpi(raw: DataFrame, base_year: Column, source_file: Column) -> DataFrame:
    """One row per month and series, labelled by the deepest level that is filled."""
    def text(c: str) -> Column:
        return F.nullif(F.trim(F.col(c)), F.lit(""))

    label = F.coalesce(*[text(level) for level in LEVELS])
    level = F.coalesce(*[F.when(text(level).isNotNull(), F.lit(level)) for level in LEVELS])
    year, month = text("year").try_cast("double").cast("int"), parse_month(text("month"))
    return (
        raw.select(
            base_year.alias("base_year"), F.make_date(year, month, F.lit(1)).alias("period"), year.alias("year"),
            month.alias("month"), text("state").alias("state"), text("sector").alias("sector"), level.alias("level"),
            label.alias("label"), text("code").alias("code"), text("index").try_cast("double").alias("idx"),
            text("inflation").try_cast("double").alias("inflation"), source_file.alias("source_file"))
        .where(F.col("year").isNotNull() & F.col("month").isNotNull() & F.col("label").isNotNull())
    )


def cpi_catalogue(cpi: DataFrame) -> DataFrame:
    return cpi.groupBy("base_year", "level", "label", "sector").agg(
        F.count(F.lit(1)).alias("n"), F.min("period").alias("first_period"), F.max("period").alias("last_period"))


def labels_like(cpi: DataFrame, pattern: str = "%air%") -> DataFrame:
    return cpi.select("base_year", "level", "label").where(F.lower("label").like(pattern)).distinct()


def _number(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), "[,₹]", "").try_cast("double")


def load_fares(spark: SparkSession, path: str, source_url: str | None = None) -> DataFrame:
    """Average fares per month and route with the file's SHA-256; placeholder when no source is named."""
    raw = read_csv(spark, path)
    period = next(c for c in PERIOD_NAMES if c in raw.columns)
    fare = next(c for c in FARE_NAMES if c in raw.columns)
    day = F.coalesce(F.try_to_timestamp(F.col(period)), F.try_to_timestamp(F.concat(F.col(period), F.lit("-01"))))
    sums = spark.read.format("binaryFile").load(path).select(
        F.col("path").alias("_path"), F.sha2("content", 256).alias("file_sha256"))
    return (
        raw.withColumn("_path", F.col("_metadata.file_path"))
        .select("_path", F.date_trunc("month", day).cast("date").alias("period"), F.upper(F.trim("route")).alias("route"),
                F.col(fare).try_cast("double").alias("average_fare"))
        .where((F.col("average_fare") > 0) & F.col("period").isNotNull())
        .join(sums, "_path", "left").drop("_path")
        .withColumns({"source_url": F.lit(source_url).cast("string"), "is_placeholder": F.lit(source_url is None)})
    )


def load_observations(spark: SparkSession, path: str, dataset: str, default_metric: str, source_url: str | None = None) -> DataFrame:
    """Alias-tolerant long form (dataset, period, route, metric, value) keeping the raw row."""
    raw = read_csv(spark, path)

    def first(names: Sequence[str]) -> Column:
        present = [F.nullif(F.trim(F.col(c)), F.lit("")) for c in names if c in raw.columns]
        return F.coalesce(*present) if present else F.lit(None).cast("string")

    day = F.coalesce(F.try_to_timestamp(first(PERIOD_NAMES)), F.try_to_timestamp(F.concat(first(PERIOD_NAMES), F.lit("-01"))))
    return raw.select(
        F.lit(dataset).alias("dataset"), F.date_trunc("month", day).cast("date").alias("period"),
        F.upper(first(("route", "sector_pair"))).alias("route"), F.coalesce(first(("metric",)), F.lit(default_metric)).alias("metric"),
        _number(first(("value", *FARE_NAMES, "index", *PASSENGER_NAMES))).alias("value"),
        F.to_json(F.struct(*raw.columns)).alias("raw_row"), F.sha2(F.to_json(F.struct(*raw.columns)), 256).alias("row_checksum"),
        F.lit(source_url).cast("string").alias("source_url"))


def fare_series(fares: DataFrame, route: str | None = None, include_placeholder: bool = False) -> DataFrame:
    """Monthly fares of one route, or the mean across routes."""
    rows = fares if include_placeholder else fares.where(~F.col("is_placeholder"))
    if route:
        rows = rows.where(F.col("route") == route)
    return rows.groupBy("period").agg(F.avg("average_fare").alias("average_fare"), F.count(F.lit(1)).alias("n_routes"))


def fare_provenance(fares: DataFrame) -> DataFrame:
    return fares.groupBy("source_url", "file_sha256", "is_placeholder").agg(
        F.count(F.lit(1)).alias("n"), F.min("period").alias("first_period"), F.max("period").alias("last_period"))


def calendar(span: DataFrame, holiday: Column) -> DataFrame:
    """One row per day of the one-row (first_day, last_day) span."""
    days = span.select(F.explode(F.sequence("first_day", "last_day")).alias("day"))
    dow = F.weekday("day")
    return days.select("day", dow.alias("dow"), (dow >= 5).alias("is_weekend"), holiday.alias("is_holiday"))
