"""Key lists, domains and declared schemas shared by every operator."""

from __future__ import annotations

from pyspark.sql import types as T

PRODUCT = ["route", "carrier", "apw_days", "flight_number", "fare_family", "cabin", "stops"]
CELL = ["route", "carrier", "apw_days"]
FLIGHT = ["route", "carrier", "apw_days", "flight_number"]
FARE_LINE = ["route", "carrier", "apw_days", "flight_number", "fare_family"]

PUBLISHABLE = ["ACCEPTED", "WINSORISED"]
DISPOSITIONS = ["ACCEPTED", "WINSORISED", "EXCLUDED", "QUARANTINED"]
CABINS = ["economy", "other_than_economy"]
COMPONENTS = ["base_fare", "yq_yr", "udf", "asf", "rcs_levy", "gst", "convenience_fee"]
INDEX_KEY = [
    "index_code", "period", "frequency", "basis", "omega_preset", "method_version", "weights_version",
]

QUOTE = T.StructType([
    T.StructField("collected_date", T.DateType()),
    T.StructField("departure_date", T.DateType()),
    T.StructField("route", T.StringType()),
    T.StructField("carrier", T.StringType()),
    T.StructField("apw_days", T.IntegerType()),
    T.StructField("flight_number", T.StringType()),
    T.StructField("fare_family", T.StringType()),
    T.StructField("cabin", T.StringType()),
    T.StructField("stops", T.IntegerType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("disposition", T.StringType()),
])

REQUIRED_QUOTE_COLUMNS = [f.name for f in QUOTE.fields if f.name not in ("price", "disposition")]

CHARGES = T.StructType([
    T.StructField("airport_iata", T.StringType()),
    T.StructField("udf_domestic", T.DoubleType()),
    T.StructField("asf", T.DoubleType()),
    T.StructField("effective_from", T.DateType()),
    T.StructField("effective_to", T.DateType()),
])

TAXES = T.StructType([
    T.StructField("cabin", T.StringType()),
    T.StructField("gst_rate", T.DoubleType()),
    T.StructField("effective_from", T.DateType()),
    T.StructField("effective_to", T.DateType()),
])

CPI_TIDY = T.StructType([
    T.StructField("base_year", T.IntegerType()),
    T.StructField("period", T.DateType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("month", T.IntegerType()),
    T.StructField("state", T.StringType()),
    T.StructField("sector", T.StringType()),
    T.StructField("level", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("code", T.StringType()),
    T.StructField("idx", T.DoubleType()),
    T.StructField("inflation", T.DoubleType()),
    T.StructField("source_file", T.StringType()),
])

# The ledger columns that enter the hash chain, as one ordered record.
LEDGER_FIELDS = [
    "seq", "run_id", "source", "ladder_rung", "legal_basis", "request_url_hash",
    "robots_directive_applied", "rate_limit_bucket", "http_status", "outcome", "n_quotes",
    "fetched_at", "note",
]
