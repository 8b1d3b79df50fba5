"""Booking identifiers: potential-flight test, validity rules, details."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripmine import rules
from tripmine.functions.text import contains_any, evaluated, lowered, text


def potential_flight(subject="subject", sender="sender") -> Column:
    """No excluded word in the subject, and an airline sender, a strong
    subject word or a flight number in the subject."""
    title, address = lowered(subject), lowered(sender)
    return ~contains_any(title, rules.POTENTIAL_EXCLUSIONS) & (
        contains_any(address, rules.POTENTIAL_DOMAINS)
        | contains_any(title, rules.POTENTIAL_INDICATORS)
        | text(subject).rlike(rules.POTENTIAL_SUBJECT_NUMBER)
    )


def valid_code(code: Column) -> Column:
    """Six characters, upper case, with a letter and a digit."""
    return F.coalesce(
        (F.char_length(code) == 6)
        & code.rlike(r"\p{L}")
        & code.rlike(r"(?U)\d")
        & (F.upper(code) == code)
        & (F.lower(code) != code),
        F.lit(False),
    )


def valid_number(number: Column, airline_codes=rules.BOOKING_AIRLINE_CODES) -> Column:
    """Two capital letters of a known airline and three or four digits."""
    return F.coalesce(
        F.char_length(number).between(5, 6)
        & number.rlike(r"(?Ud)^[A-Z]{2}\d{3,4}$")
        & F.substring(number, 1, 2).isin(list(airline_codes)),
        F.lit(False),
    )


def code_tokens(full_text: Column) -> Column:
    """All bounded six-character codes that hold a letter and a digit."""
    found = F.regexp_extract_all(full_text, F.lit(rules.BOOKING_CODE), F.lit(1))
    return F.filter(found, lambda c: c.rlike("[A-Z]") & c.rlike("[0-9]"))


def number_tokens(full_text: Column, airline_codes=rules.BOOKING_AIRLINE_CODES) -> Column:
    """All bounded flight numbers of known airlines, in text order."""
    found = F.regexp_extract_all(full_text, F.lit(rules.BOOKING_NUMBER), F.lit(1))
    return F.filter(found, lambda n: F.substring(n, 1, 2).isin(list(airline_codes)))


def has_flight_context(full_text: Column, numbers: Column) -> Column:
    """One of ``numbers`` stands within 50 characters of "flight" on one line.

    Instead of one pattern per number, two fixed patterns list everything of
    a flight number's shape that has the word near it, whatever its case; a
    text with many numbers is still scanned twice only.
    """
    word, reach = rules.BOOKING_CONTEXT_WORD, rules.BOOKING_CONTEXT_DISTANCE
    near = []
    for shape, size in ((r"[A-Z]{2}\d{3}", 5), (r"[A-Z]{2}\d{4}", 6)):
        pattern = (
            rf"(?idU)(?=({shape}))"
            rf"(?:(?<={word}.{{0,{reach}}})|(?=.{{{size}}}.{{0,{reach}}}{word}))"
        )
        near.append(F.regexp_extract_all(full_text, F.lit(pattern), F.lit(1)))
    return F.arrays_overlap(numbers, F.transform(F.concat(*near), F.upper))


def score(has_code: Column, has_number: Column, has_context: Column) -> Column:
    total = (
        F.lit(0.0)
        + F.when(has_code, rules.SCORE_CODE).otherwise(0.0)
        + F.when(has_number, rules.SCORE_NUMBER).otherwise(0.0)
        + F.when(has_context, rules.SCORE_CONTEXT).otherwise(0.0)
    )
    return F.least(F.lit(1.0), total)


def with_booking_details(df: DataFrame, subject="subject", body="body", keep=None) -> DataFrame:
    """Add ``booking_details``: first code or '', all numbers, confidence.
    ``keep`` names the columns to carry on, by default all.

    Null below a confidence of 0.6. As a code alone scores 0.4, texts without
    a flight number are done after one pattern.
    """
    columns = [*(df.columns if keep is None else keep), "booking_details"]
    df = df.withColumn(
        "__text", F.concat(text(subject), F.lit("\n"), text(body))
    ).withColumn("__numbers", number_tokens(F.col("__text")))
    some = F.size("__numbers") > 0
    df = df.withColumn("__codes", F.when(some, code_tokens(F.col("__text")))).withColumn(
        "__context", F.when(some, has_flight_context(F.col("__text"), F.col("__numbers")))
    )
    df = df.withColumn(
        "__confidence", score(F.size("__codes") > 0, some, F.col("__context"))
    ).withColumn(
        "booking_details",
        F.when(
            some & (F.col("__confidence") >= rules.BOOKING_MIN_CONFIDENCE),
            F.struct(
                F.coalesce(F.get("__codes", F.lit(0)), F.lit("")).alias("confirmation_code"),
                F.col("__numbers").alias("flight_numbers"),
                F.col("__confidence").alias("confidence"),
            ),
        ),
    )
    return evaluated(df, columns, [c for c in columns if c != "booking_details"])
