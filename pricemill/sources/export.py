"""Series exports: CSV, flat rows, raw-payload CSV, SDMX-JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

FREQUENCY_CODE = {"daily": "D", "weekly": "W", "monthly": "M"}
SERIES = ["index_code", "frequency", "basis", "omega_preset"]
RUN_EXPORT = ["index_code", "period", "frequency", "basis", "omega_preset", "value", "se", "ci_low", "ci_high",
              "coverage_pct", "omega_covered"]


def write_series_csv(df: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    """Sorted, with a header; columns a caller lacks are written empty."""
    if columns:
        df = df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])
    df.orderBy("period").write.mode("overwrite").option("header", True).csv(path)


def _value_list(column, name: str):
    return F.array(F.struct(column.alias("id"), F.lit(name).alias("name")))


def sdmx_documents(index_values: DataFrame, sender: str = "PRICEMILL") -> DataFrame:
    """One SDMX-JSON data message per series; a series is as long as the calendar."""
    points = F.array_sort(F.collect_list(F.struct(F.col("period").cast("string").alias("id"), F.col("value").alias("v"))))
    rows = index_values.groupBy(*SERIES).agg(points.alias("_p"))
    freq = F.coalesce(*[F.when(F.col("frequency") == k, v) for k, v in FREQUENCY_CODE.items()])

    def dimension(ident: str, name: str, position: int, column):
        return F.struct(F.lit(ident).alias("id"), F.lit(name).alias("name"), F.lit(position).alias("keyPosition"),
                        _value_list(column, name).alias("values"))

    def attribute(ident: str, name: str, column):
        return F.struct(F.lit(ident).alias("id"), F.lit(name).alias("name"), _value_list(column, name).alias("values"))

    times = F.transform("_p", lambda p: F.struct(p["id"].alias("id"), p["id"].alias("name")))
    observations = F.map_from_entries(F.transform("_p", lambda p, i: F.struct(i.cast("string"), F.array(p["v"]))))
    structure = F.struct(
        F.struct(
            F.array(dimension("INDEX", "Index", 0, F.col("index_code")), dimension("BASIS", "Time basis", 1, F.upper("basis")),
                    dimension("OMEGA", "Lead-time weight preset", 2, F.upper("omega_preset"))).alias("series"),
            F.array(F.struct(F.lit("TIME_PERIOD").alias("id"), F.lit("Time period").alias("name"), F.lit(3).alias("keyPosition"),
                             F.lit("time").alias("role"), times.alias("values"))).alias("observation"),
        ).alias("dimensions"),
        F.struct(F.array(attribute("FREQ", "Frequency", freq), attribute("UNIT_MEASURE", "Unit of measure", F.lit("IX")),
                         attribute("BASE_PER", "Index base period", F.col("_p")[0]["id"])).alias("series")).alias("attributes"),
    )
    series = F.map_from_entries(F.array(F.struct(F.lit("0:0:0"), F.struct(
        F.array(F.lit(0), F.lit(0), F.lit(0)).alias("attributes"), observations.alias("observations")))))
    document = F.struct(
        F.struct(F.concat_ws("-", *SERIES).alias("id"), F.struct(F.lit(sender).alias("id")).alias("sender")).alias("meta"),
        F.struct(structure.alias("structure"),
                 F.array(F.struct(F.lit("Information").alias("action"), series.alias("series"))).alias("dataSets")).alias("data"))
    return rows.select(*SERIES, F.to_json(document, {"ignoreNullFields": "false"}).alias("document"))


def write_sdmx(index_values: DataFrame, path: str) -> None:
    sdmx_documents(index_values).select("document").write.mode("overwrite").text(path)


def flat_rows(observations: DataFrame) -> DataFrame:
    """Export form of observations: route label, money and dates as text, other fields unchanged."""
    out = []
    for f in observations.schema.fields:
        c = F.col(f.name)
        kind = f.dataType.simpleString()
        out.append(c.cast("string").alias(f.name) if kind.startswith("decimal") or kind in ("date", "timestamp", "double") else c)
    return observations.select(F.concat_ws("-", "origin_airport", "destination_airport").alias("route"), *out)


def payload_table(raw: DataFrame, json: str = "record_json") -> DataFrame:
    """Flatten JSON objects to columns; the header is the union of their keys.

    The key union is one distributed distinct; its result is a schema, so it may visit the driver.
    """
    entries = F.from_json(F.col(json), "map<string,string>")
    keys = sorted(r["k"] for r in raw.select(F.explode(F.map_keys(entries)).alias("k")).distinct().collect())
    keep = [c for c in raw.columns if c != json]
    return raw.select(*keep, *[entries[k].alias(k) for k in keys])


def write_payload_csv(raw: DataFrame, path: str, json: str = "record_json") -> None:
    payload_table(raw, json).write.mode("append").option("header", True).csv(path)
