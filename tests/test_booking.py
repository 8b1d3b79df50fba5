"""Booking details, context and the gates."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tripmine.functions.booking import has_flight_context, valid_code, valid_number, with_booking_details
from tripmine.operators.filters import booking_gate, potential, second_gate, unprocessed
from tripmine.plans.gate import gate, gate_nested, newly_processed


@pytest.mark.parametrize(
    "body, expected",
    [
        ("ref AB12CD seat VN123", ("AB12CD", ["VN123"], 0.8)),
        ("flight VN123", ("", ["VN123"], 0.4 + 0.2)),
        ("seat VN123", None),
        ("seat VN1234", ("VN1234", ["VN1234"], 0.8)),
        ("flight VN123 ref AB12CD", ("AB12CD", ["VN123"], 1.0)),
        ("VN123\nflight", None),
        ("ref AB12CD only", None),
        ("flight ZZ123 ref AB12CD", None),
        ("flight VN123 VN123 then SQ22 SQ223", ("", ["VN123", "VN123", "SQ223"], 0.4 + 0.2)),
        ("VN123" + "." * 50 + "flight", ("", ["VN123"], 0.4 + 0.2)),
        ("VN123" + "." * 51 + "flight", None),
        ("flight" + "." * 51 + "VN123", None),
        (None, None),
    ],
)
def test_details(mails, body, expected):
    details = with_booking_details(mails(("s", "x", body))).first().booking_details
    got = details and (details.confirmation_code, details.flight_numbers, details.confidence)
    assert got == expected


PIECES = st.lists(
    st.sampled_from(
        ["flight", "FLIGHT", "VN123", "VN1234", "vn123", "SQ999", "SQ9991", "\n", "\r", ".", " ", "x" * 23, "x" * 44]
    ),
    max_size=14,
)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(PIECES, min_size=30, max_size=30))
def test_context_equals_one_pattern_per_number(spark, piles):
    numbers = ["VN123", "VN1234", "SQ999"]
    texts = ["".join(p) for p in piles]
    df = spark.createDataFrame([(t, numbers[i % 3]) for i, t in enumerate(texts)], "t string, n string")
    got = df.select("t", "n", has_flight_context(F.col("t"), F.array("n")).alias("near")).collect()
    for row in got:
        near = re.search(rf"flight.{{0,50}}{row.n}|{row.n}.{{0,50}}flight", row.t, re.IGNORECASE)
        assert row.near == bool(near), row


def test_validity(spark):
    values = ["AB12CD", "ABCDEF", "123456", "ab12cd", "AB12C", "AB12CDE", None, "VN123", "VN1234", "ZZ123", "5J123", "VN12"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    rows = df.select("v", valid_code(F.col("v")).alias("code"), valid_number(F.col("v")).alias("num")).collect()
    assert [r.v for r in rows if r.code] == ["AB12CD", "VN1234"]
    assert [r.v for r in rows if r.num] == ["VN123", "VN1234"]


def test_potential(mails):
    rows = [
        ("Hotel flight confirmation", "x@united.com", "excluded"),
        ("Receipt", "x@klm.com", ""),
        ("Your E-Ticket", "x", ""),
        ("About AA123", "x", ""),
        ("About AA12", "x", "flight confirmation"),
        (None, None, None),
    ]
    assert [r.seq for r in potential(mails(*rows)).orderBy("seq").collect()] == [1, 2, 3]


def test_gate_is_monotone_in_the_threshold(mails):
    bodies = ["flight VN123", "ref AB12CD VN123", "flight VN123 AB12CD", "nothing"]
    detailed = with_booking_details(mails(*[("s", "x", b) for b in bodies]))
    kept = [{r.seq for r in booking_gate(detailed, t).collect()} for t in (0.6, 0.8, 1.0)]
    assert kept == [{0, 1, 2}, {1, 2}, {2}]
    assert {r.seq for r in second_gate(detailed).collect()} == {0, 1, 2}


def test_processed_ids(spark, mails):
    mail = mails(*[("Boarding pass", "x", "flight VN123")] * 3)
    mail = mail.withColumn("id", F.when(F.col("seq") > 0, F.col("id")))
    with_null = spark.createDataFrame([(None,), (None,), ("m9",)], "id string")
    without = spark.createDataFrame([("m1",)], "id string")
    assert [r.id for r in unprocessed(mail, with_null).orderBy("seq").collect()] == ["m1", "m2"]
    assert [r.id for r in gate(mail, without).orderBy("seq").collect()] == [None, "m2"]
    assert {r.id for r in newly_processed(mail, without).collect()} == {None, "m2"}


def test_nested_form(mails):
    row = gate_nested(mails(("Boarding pass", "x", "flight VN123 ref AB12CD"))).first()
    assert row.message.subject == "Boarding pass"
    assert row.booking_details.confirmation_code == "AB12CD"
    assert row.confidence == 1.0
