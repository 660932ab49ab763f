"""Column expressions: geometry, money, dates, codes, calendar, hashing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EARTH_RADIUS_KM = 6371.0088

# Shapes accepted for dates, month abbreviations, largest plausible amount.
DATE_SHAPES = (
    (r"^\d{4}-\d{1,2}-\d{1,2}", "yyyy-M-d"),
    (r"^\d{4}/\d{1,2}/\d{1,2}", "yyyy/M/d"),
    (r"^\d{1,2}-\d{1,2}-\d{4}", "d-M-yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4}", "d/M/yyyy"),
    (r"^\d{8}", "yyyyMMdd"),
)
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
MONEY_CEILING = 10_000_000


def positive_ln(value: Column) -> Column:
    return F.when(value > 0, F.ln(value))


def geo_mean(value: Column) -> Column:
    """Aggregate: geometric mean over the finite positive values, null when there is none."""
    usable = (value > 0) & (value < F.lit(float("inf")))
    return F.exp(F.avg(F.when(usable, F.ln(value))))


def great_circle_km(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    half_lat = F.sin(F.radians(lat_b - lat_a) / 2)
    half_lon = F.sin(F.radians(lon_b - lon_a) / 2)
    inner = half_lat * half_lat + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * half_lon * half_lon
    return F.round(F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(inner)), 1)


def parse_money(text: Column) -> Column:
    """Strip currency tokens and separators; null unless 0 < amount <= the ceiling."""
    bare = F.trim(F.regexp_replace(F.lower(F.trim(text)), r"inr|rs\.|rs|₹|usd|eur|,", ""))
    amount = bare.try_cast("decimal(20,6)")
    return F.when((amount > 0) & (amount <= MONEY_CEILING), F.bround(amount, 2).cast("decimal(12,2)"))


def parse_date(text: Column) -> Column:
    """Date at the head of the text; the shape picks the format, so no format is tried in vain."""
    t = F.trim(text)
    out = None
    for shape, fmt in DATE_SHAPES:
        head = F.regexp_extract(t, shape, 0)
        # Spark's own date form needs no formatter.
        day = head.try_cast("date") if fmt == "yyyy-M-d" else F.to_date(F.try_to_timestamp(head, F.lit(fmt)))
        out = F.when(t.rlike(shape), day) if out is None else out.when(t.rlike(shape), day)
    return out


def parse_time(text: Column) -> Column:
    hours = F.regexp_extract(text, r"(\d{1,2}):(\d{2})", 1).try_cast("int")
    minutes = F.regexp_extract(text, r"(\d{1,2}):(\d{2})", 2).try_cast("int")
    return F.when((hours <= 23) & (minutes <= 59), F.format_string("%02d:%02d", hours, minutes))


def parse_airport(text: Column) -> Column:
    code = F.upper(F.trim(text))
    return F.when(code.rlike("^[A-Z]{3}$"), code)


def parse_carrier(text: Column) -> Column:
    code = F.regexp_replace(F.upper(F.trim(text)), " ", "")
    return F.when(code.rlike("^[A-Z0-9]{2,3}$"), code)


def parse_flight_number(text: Column, carrier: Column) -> Column:
    code = F.regexp_replace(F.upper(F.trim(text)), " ", "")
    full = F.when(code.rlike(r"^\d{1,4}[A-Z]?$") & carrier.isNotNull(), F.concat(carrier, code)).otherwise(code)
    return F.when(full.rlike(r"^[A-Z0-9]{2,3}\s?\d{1,4}[A-Z]?$"), full)


def parse_month(text: Column) -> Column:
    """Name, abbreviation or number to 1..12."""
    low = F.lower(F.trim(text))
    number = low.try_cast("double").cast("int")
    named = F.coalesce(*[F.when(F.substring(low, 1, 3) == m, F.lit(i + 1)) for i, m in enumerate(MONTHS)])
    return F.coalesce(F.when(number.between(1, 12), number), F.when(number.isNull(), named))


def monday_zero(day: Column) -> Column:
    return F.weekday(day)


def canonical_json(*columns: str) -> Column:
    """Sorted keys, nulls kept, no whitespace."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def row_key(*columns: str) -> Column:
    """Deterministic id of the given key columns."""
    return F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]), 256)
