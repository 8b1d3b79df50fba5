"""Duplicate removal, order and numbering against plain loops."""

import random

from pyspark.sql import functions as F

from tripmine.operators.dedup import best_record, by_departure, first_record, numbered
from tripmine.operators.stats import by_month, top_route, totals
from tripmine.schemas import FLIGHT_FIELDS

SCHEMA = "seq bigint, " + ", ".join(f"{c} string" for c in FLIGHT_FIELDS[:-1]) + ", confidence double"


def make(n, seed=1, hot=0.4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        is_hot = rng.random() < hot
        rows.append(
            (
                i,
                "VJ1" if is_hot else rng.choice(["VJ1", "VJ2", "", None]),
                "2026-01-01T10:00" if is_hot else rng.choice(["2026-01-01T09:00", "12 March 2026", "", None]),
                rng.choice(["", None]),
                "SGN" if is_hot else rng.choice(["SGN", "", None]),
                "HAN",
                rng.choice(["C", None]),
                rng.choice(["A", None]),
                rng.choice([0.5, None]),
            )
        )
    return rows


def expected(rows):
    best, first = {}, {}
    for row in rows:
        flight = dict(zip(["seq", *FLIGHT_FIELDS], row))
        if not flight["flight_number"] or not flight["departure_datetime"]:
            continue
        key = (
            flight["flight_number"],
            flight["departure_datetime"].split("T")[0],
            flight["departure_airport"],
            flight["arrival_airport"],
        )
        first.setdefault(key, flight["seq"])
        filled = sum(v is not None for v in row[1:])
        if key not in best or filled > best[key][0]:
            best[key] = (filled, row)
    found = [(*row, first[key]) for key, (_, row) in best.items()]
    return sorted(found, key=lambda r: (r[2] or "", r[-1]))


def ordered(df):
    return [tuple(r) for r in df.orderBy(*by_departure(df)).collect()]


def test_best_record_equals_a_loop(spark):
    rows = make(2000)
    assert ordered(best_record(spark.createDataFrame(rows, SCHEMA))) == expected(rows)


def test_input_order_does_not_matter(spark):
    rows = make(500, seed=2)
    mixed = rows[:]
    random.Random(3).shuffle(mixed)
    frames = [spark.createDataFrame(r, SCHEMA).repartition(n) for r, n in ((rows, 1), (mixed, 7))]
    assert ordered(best_record(frames[0])) == ordered(best_record(frames[1]))


def test_idempotent(spark):
    once = best_record(spark.createDataFrame(make(500, seed=4), SCHEMA)).drop("first_seq")
    twice = best_record(once).drop("first_seq")
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))


def test_rows_shrink_before_the_shuffle(spark):
    plan = best_record(spark.createDataFrame(make(10), SCHEMA))._jdf.queryExecution().toString()
    assert "partial_min_by" in plan


def test_first_record(spark):
    rows = [(3, "a", "t", "late"), (1, "a", "t", "early"), (2, None, "t", "n"), (4, None, "t", "m"), (5, "a", "u", "o")]
    df = spark.createDataFrame(rows, "seq bigint, id string, thread_id string, v string")
    assert {r.v for r in first_record(df).collect()} == {"early", "n", "o"}


def test_numbered_is_dense_and_sorted(spark):
    df = spark.range(10_000).select((F.hash("id") % 97).alias("k"), "id").repartition(13)
    got = numbered(df, F.col("k"), F.col("id")).orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(1, 10_001))
    assert [(r.k, r.id) for r in got] == sorted((r.k, r.id) for r in got)


def test_statistics(spark):
    rows = [
        (1, "A", "X", "Y", "1767225600000"),
        (2, None, "Z", None, "1769904000000"),
        (3, "A", "Z", None, "0"),
        (4, "B", "X", "Y", "soon"),
        (5, "", None, None, None),
    ]
    df = spark.createDataFrame(rows, "seq bigint, airline string, departure string, arrival string, internal_date string")
    assert tuple(totals(df).first()) == (5, 3)
    # X-Y and Z- both occur twice; Z- got there first.
    assert tuple(top_route(df).first()) == ("Z-", 2)
    assert {tuple(r) for r in by_month(df).collect()} == {("January", 1, 1), ("February", 1, 2)}
