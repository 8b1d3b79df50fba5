"""Dates, display texts and small conversions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tripmine import rules
from tripmine.schemas import FLIGHT_FIELDS

# The accepted shape of an RFC 2822 date.
RFC2822 = (
    r"(?iU)^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun),\s+(\d{1,2})\s+"
    r"(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+"
    r"(\d{4}\s+\d{1,2}:\d{1,2}:\d{1,2})\s*([+-]\d{2}:?\d{2}|Z)$"
)


# First and last millisecond of the years 1 to 9999.
EPOCH_RANGE = (-62_135_596_800_000, 253_402_300_799_999)


def rfc2822(date: Column) -> Column:
    """RFC 2822 date text to an instant; other text gives null."""
    day, month, time, offset = (F.regexp_extract(date, RFC2822, g) for g in (1, 2, 3, 4))
    offset = F.regexp_replace(F.replace(offset, F.lit(":"), F.lit("")), "(?i)z", "+0000")
    parts = F.concat_ws(
        " ", day, F.initcap(month), F.regexp_replace(time, r"(?U)\s+", " "), offset
    )
    return F.try_to_timestamp(parts, F.lit("d MMM yyyy H:m:s Z"))


def epoch_timestamp(ms: Column) -> Column:
    """Epoch milliseconds as text to an instant; bad text, and what lies
    outside the years 1 to 9999, gives null."""
    number = F.trim(ms).try_cast("bigint")
    return F.timestamp_millis(F.when(number.between(*EPOCH_RANGE), number))


def epoch_minute(ms: Column) -> Column:
    """``yyyy-MM-dd HH:mm`` in session time of epoch milliseconds, or null."""
    return F.date_format(epoch_timestamp(ms), "yyyy-MM-dd HH:mm")


def month_name(ms: Column) -> Column:
    """English month name of epoch milliseconds; null for 0, blank or bad text."""
    at = F.when(F.trim(ms).try_cast("bigint") != 0, epoch_timestamp(ms))
    return F.date_format(at, "MMMM")


def day_key(departure: Column) -> Column:
    """The text before the first ``T``."""
    return F.substring_index(departure, "T", 1)


def filled_fields(fields=FLIGHT_FIELDS) -> Column:
    """How many of ``fields`` are not null; empty text counts as filled."""
    return sum((F.col(f).isNotNull().cast("int") for f in fields), F.lit(0))


def flight_text() -> Column:
    """One flight as six labelled lines."""
    lines = [
        ("Flight: ", "flight_number"),
        ("Airline: ", "airline"),
        ("From: ", "departure_airport"),
        ("To: ", "arrival_airport"),
        ("Departure: ", "departure_datetime"),
        ("Confirmation: ", "confirmation_code"),
    ]
    shown = [F.concat(F.lit(label), F.coalesce(F.col(c), F.lit("None"))) for label, c in lines]
    return F.concat_ws("\n", *shown)


def cost_text(cost: Column) -> Column:
    """``$1,234.5678``; missing or negative cost reads ``n/a``."""
    return F.when(cost >= 0, F.concat(F.lit("$"), F.format_number(cost, 4))).otherwise("n/a")


def first_item(values: Column) -> Column:
    """First array element, or empty text."""
    return F.coalesce(F.get(values, F.lit(0)), F.lit(""))


def joined(values: Column) -> Column:
    return F.array_join(values, ", ")


def token_estimate(content: Column) -> Column:
    """Characters divided by four, rounded up."""
    return F.ceil(F.char_length(content) / rules.CHARS_PER_TOKEN).cast("bigint")
