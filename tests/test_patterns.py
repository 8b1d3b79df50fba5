"""The Java patterns find what the same patterns find in Python."""

import re

import pytest
from pyspark.sql import functions as F

from tripmine import rules
from workload import tables

PATTERNS = {
    f"{name}[{i}]": p
    for name in (
        "VIETJET_CODE VIETJET_NUMBER VIETJET_AIRPORTS VIETJET_DATE "
        "GENERIC_NUMBER GENERIC_AIRPORTS GENERIC_CODE"
    ).split()
    for i, p in enumerate(getattr(rules, name))
} | {
    name: getattr(rules, name)
    for name in "BOOKING_CODE BOOKING_NUMBER TRACKER_CODE TRACKER_NUMBER POTENTIAL_SUBJECT_NUMBER".split()
}


def python_pattern(java: str) -> re.Pattern:
    flags, body = re.fullmatch(r"(?s)(?:\(\?([a-zA-Z]+)\))?(.*)", java).groups()
    return re.compile(body, re.IGNORECASE if "i" in (flags or "") else 0)


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    content = F.concat(F.coalesce("body", F.lit("")), F.lit(" "), F.coalesce("subject", F.lit("")))
    df = tables.mail(spark, sf_dir).select("seq", content.alias("text"))
    extra = [
        (-1, "Flight No. VJ 1234 From: sgn To: HAN"),
        (-2, "١٢٣ flight AA ١٢ VN123٤ ÉVN123"),
        (-3, "REſERVATION # ABC123, bookıng: ZZ99ZZé"),
        (-4, "x" * 30 + " VN1234 \r\n  from (JFK)\rto (LAX) JFK->LAX jfk-lax"),
    ]
    df = df.unionByName(spark.createDataFrame(extra, df.schema)).cache()
    yield df
    df.unpersist()


@pytest.mark.parametrize("name", PATTERNS)
def test_same_first_match(texts, name):
    java, python = PATTERNS[name], python_pattern(PATTERNS[name])
    groups = python.groups
    found = texts.select(
        "text", *[F.regexp_extract("text", java, g).alias(f"g{g}") for g in range(groups + 1)]
    ).collect()
    for row in found:
        match = python.search(row.text)
        expected = tuple(match.group(g) for g in range(groups + 1)) if match else ("",) * (groups + 1)
        assert tuple(row)[1:] == expected


def test_words_are_necessary(texts):
    """No pattern match without one of the words it is guarded by."""
    guards = [(p, rules.GENERIC_NUMBER_WORDS) for p in rules.GENERIC_NUMBER[:2]]
    guards += [(rules.TRACKER_CODE, rules.TRACKER_CODE_WORDS)]
    guards += [(rules.TRACKER_CONTEXT, rules.TRACKER_CONTEXT_WORDS)]
    from tripmine.functions.text import may_match

    low = texts.withColumn("low", F.lower("text"))
    for pattern, words in guards:
        missed = low.where(F.col("text").rlike(pattern) & ~F.expr(may_match("text", "low", words)))
        assert missed.count() == 0
