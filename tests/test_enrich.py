"""Joins with external tables, and cost estimates."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tripmine import rules
from tripmine.functions import prompts, scalars
from tripmine.functions.airline import of_airline, with_airline
from tripmine.operators import cost, enrich
from tripmine.plans.cost import cost_plan
from tripmine.plans.history import history

DECISION = "email_id string, is_itinerary boolean, confidence double, reason string"
EXTRACTION = (
    "email_id string, flight_number string, departure_datetime string, arrival_datetime string, "
    "departure_airport string, arrival_airport string, confirmation_code string, airline string, confidence double"
)


def test_itinerary_gate(spark, mails):
    decisions = spark.createDataFrame(
        [("m0", False, 0.6, None), ("m1", False, 0.59, None), ("m2", False, None, None), ("m3", True, 1.0, None), (None, False, 1.0, None)],
        DECISION,
    )
    mail = mails(*[("s", "x", "b")] * 6).withColumn("id", F.when(F.col("seq") < 5, F.col("id")))
    assert [r.seq for r in enrich.itinerary_gate(mail, decisions).orderBy("seq").collect()] == [1, 2, 3, 4, 5]
    assert enrich.itinerary_gate(mail, decisions, 0.5).count() == 4


def test_extraction_only_where_rules_find_nothing(spark, mails):
    mail = mails(("s", "x", "Flight AA 123 from JFK to LAX"), ("s", "x", "nothing"), ("s", "x", "nothing"))
    outside = spark.createDataFrame(
        [(m, "ZZ9", "2026-01-01T10", "", "AAA", " \t", " ", " c ", 0.5) for m in ("m0", "m1")], EXTRACTION
    )
    rows = {r.id: r.flight for r in enrich.flight_or_extraction(mail, outside).collect()}
    assert rows["m0"].flight_number == "AA123" and rows["m0"].confidence is None
    assert tuple(rows["m1"]) == ("ZZ9", "2026-01-01T10", None, "AAA", None, None, " c ", 0.5)
    assert rows["m2"] is None
    assert [r.flight_number for r in history(mail, extractions=outside).collect()] == ["ZZ9"]


def test_history_keeps_the_fullest_record_in_order(mails):
    body = "Flight No. VJ 123\nFrom: SGN To: HAN\nDate: {}\n"
    mail = mails(
        ("VietJet", "x", body.format("2 May 2026")),
        ("VietJet", "x", body.format("1 May 2026")),
        ("VietJet", "x", body.format("2 May 2026")),
        ("AirAsia", "x", body.format("1 Jan 2026")),
    )
    assert [(r.seq, r.first_seq) for r in history(mail).collect()] == [(1, 1), (0, 0)]


def rule_table(spark, extra=0):
    rows = [("text", w, a) for a, keys in rules.AIRLINE_KEYWORDS for w in keys]
    rows += [("sender", d, a) for d, a in rules.AIRLINE_DOMAINS]
    rows += [("text", f"no such airline {i}", f"A{i}") for i in range(extra)]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "priority int, field string, needle string, airline string")


@pytest.mark.parametrize("limit", [10_000, 10])
def test_rule_table_of_any_size(spark, mails, limit):
    rows = [(f"{w} and iberia", "news@aa.com", "x" * 50) for _, keys in rules.AIRLINE_KEYWORDS for w in keys]
    rows += [("vjet", "x", "air"), ("Nothing", "a@O.DELTA.com", None), ("None", None, None), ("", "", "iber\nia")]
    mail = mails(*rows)
    expected = {r.seq: r.airline for r in with_airline(mail).collect()}
    found = enrich.airline_by_rules(mail, rule_table(spark, 30), inline_rules=limit)
    assert {r.seq: r.airline for r in found.collect()} == expected
    assert expected[len(rows) - 4] == "VietJet Air" and expected[len(rows) - 1] == "Unknown Airline"


def test_rules_of_one_priority_and_odd_needles(spark, mails):
    """Inline and indexed tables pick the same rule, whatever priorities and needles are."""
    table = [(1, "sender", "y.com", "Zed"), (1, "text", "needle", "Alpha"), (1, "text", "need", "Beta"), (0, "text", "vn", None),
             (0, "text", "vnx", "Gamma"), (2, "text", "", "Any"), (None, "text", "nullprio", "First"), (0, "text", None, "Never"),
             (0, "body", "o", "Never"), (3, "text", "x" * 150, "Long"), (1, "text", "😀é", "Sign"), (1, "text", "p" * 64, "Run")]
    keyword_rules = spark.createDataFrame(table, "priority int, field string, needle string, airline string")
    rng = random.Random(4)
    parts = ["needle", "need", "vn", "vnx", "nullprio", "x" * 149, "x" * 150, "😀", "é", "p" * 63, "p" * 64, " ", "nee", "dle", "\n", "q" * 61]
    rows = [("".join(rng.choice(parts) for _ in range(rng.randrange(4))), rng.choice(("a@y.com", "b@z.com", None)),
             "".join(rng.choice(parts) for _ in range(rng.randrange(5)))) for _ in range(150)]
    mail = mails(*rows, ("s", "x", "q" * 100_000 + "needle"), (None, None, None))
    none_any = keyword_rules.where("needle <> ''")
    for some in (keyword_rules, none_any, keyword_rules.where("needle = ''"), keyword_rules.limit(0)):
        inline = {r.seq: r.airline for r in enrich.airline_by_rules(mail, some).collect()}
        assert {r.seq: r.airline for r in enrich.airline_by_rules(mail, some, inline_rules=-1).collect()} == inline
    held = {r.seq: r.airline for r in enrich.airline_by_rules(mail, none_any, inline_rules=-1).collect()}
    usable = sorted((p if p is not None else -1, f, n, a) for p, f, n, a in table if f in ("text", "sender") and n)
    for i, (subject, sender, body) in enumerate(rows):
        where = {"text": f"{subject} {body}".lower(), "sender": (sender or "").lower()}
        hit = next((a for _, f, n, a in usable if n in where[f]), None)
        assert held[i] == (hit or "Unknown Airline"), rows[i]


def test_of_airline_is_a_filter_on_the_airline(mails):
    mail = mails(("vietjet", "x", None), ("latam", "x@vietjetair.com", None), ("s", "x@vietjetair.com", None), ("s", "x", "b"))
    expected = {r.seq for r in with_airline(mail).where(F.col("airline") == rules.VIETJET).collect()}
    assert {r.seq for r in of_airline(mail, rules.VIETJET).collect()} == expected == {0, 2}


def test_cost(spark, mails):
    mail = mails(("Test", "x@example.com", "abcd"), ("Test2", "y@example.com", "abcdefgh")).withColumn("date", F.lit("2024-01-01"))
    prompt = prompts.prompt(rules.COST_PROMPT_HEAD)
    texts = [r[0] for r in mail.select(prompt).collect()]
    assert texts[0].startswith("You are given an email.") and texts[0].endswith("Date: 2024-01-01\nBody:\nabcd\n")
    chars = prompts.prompt_chars()
    assert [r[0] for r in mail.select(chars).collect()] == [len(t) for t in texts]
    row = cost.estimate(mail, input_rate=1.0, output_rate=2.0, output_tokens=10, overhead_tokens=5).first()
    tokens = sum(math.ceil(len(t) / 4) for t in texts) + 10
    assert (row.email_count, row.total_input_tokens, row.total_output_tokens) == (2, tokens, 20)
    assert row.total_cost == pytest.approx(tokens / 1e6 + 40 / 1e6)
    assert row.avg_cost == pytest.approx(row.total_cost / 2) and row.tokenizer == "approx:4chars"


def test_cost_without_rates_or_mail(mails):
    mail = mails(("s", "x", "b")).withColumn("date", F.lit(None).cast("string"))
    row = cost.estimate(mail, input_rate=1.0, overhead_tokens=-3, max_body_chars=0).first()
    assert (row.input_cost, row.total_cost, row.avg_cost) == (None, None, None)
    row = cost.estimate(mail.where("false"), input_rate=1.0, output_rate=2.0).first()
    assert (row.total_input_tokens, row.total_cost, row.avg_cost, row.tokenizer) == (0, 0.0, 0.0, "approx")
    assert cost.estimate(mail.where("false")).first().avg_cost is None


def test_cost_plan_rows(mails):
    mail = mails(("s", "x", "b" * 10_000)).withColumn("date", F.lit("d"))
    rows = {r.label: r for r in cost_plan(mail, input_rate=None, output_rate=None).collect()}
    assert set(rows) == {"Classification", "Extraction"}
    assert rows["Extraction"].max_body_chars is None and rows["Classification"].total_output_tokens == 60
    capped = {r.label: r for r in cost_plan(mail, input_rate=None, output_rate=None, max_body_chars=4000).collect()}
    assert capped["Extraction"].max_body_chars == capped["Classification"].max_body_chars == 4000
    assert rows["Extraction"].total_input_tokens - capped["Extraction"].total_input_tokens == 1500


def test_requests(mails):
    mail = mails(("s", "x", "body")).withColumn("date", F.lit(None).cast("string"))
    rows = {r.task: r.prompt for r in cost.requests(mail, {"extraction": 2, "classification": None}).collect()}
    assert rows["extraction"].endswith("Subject: s\nFrom: x\nDate: None\nBody:\nbo\n")
    assert rows["classification"].endswith("Body:\nbody\n")


def test_small_scalars(spark):
    df = spark.createDataFrame([(1234.5678,), (-1.0,), (None,), (0.0,)], "c double")
    assert [r[0] for r in df.select(scalars.cost_text(F.col("c"))).collect()] == ["$1,234.5678", "n/a", "n/a", "$0.0000"]
    df = spark.createDataFrame([(" 1767225600000 ",), ("99999999999999999",), ("x",), ("0",), ("",), (None,)], "m string")
    shown = df.select(scalars.epoch_minute(F.col("m")), scalars.month_name(F.col("m"))).collect()
    assert [tuple(r) for r in shown] == [
        ("2026-01-01 00:00", "January"), (None, None), (None, None), ("1970-01-01 00:00", None), (None, None), (None, None),
    ]
    df = spark.createDataFrame([("abcd",), ("abcde",), ("",), ("é😀",)], "t string")
    assert [r[0] for r in df.select(scalars.token_estimate(F.col("t"))).collect()] == [1, 2, 0, 1]


def test_rules_of_one_needle_meet_a_mail_once(spark, mails):
    """Thousands of rules share a needle: their first wins, and the others join with nothing."""
    rows = [(5, "text", f"code{i % 40}", f"A{i:05}") for i in range(6000)] + [(9, "text", "z", "Z"), (1, "text", "code7", None), (9, "sender", "code", "S")]
    keyword_rules = spark.createDataFrame(rows, "priority int, field string, needle string, airline string")
    mail = mails(("code7", "x", None), ("Code12 code30", "x", "z"), ("z", "x", "y"), ("s", "code", "b"), ("s", "x", "b"))
    found = enrich.airline_by_rules(mail, keyword_rules)
    assert {r.seq: r.airline for r in found.collect()} == {0: "Unknown Airline", 1: "A00001", 2: "Z", 3: "S", 4: "Unknown Airline"}
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()
