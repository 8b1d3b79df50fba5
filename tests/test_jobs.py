"""Whole jobs from files to files."""

import json

from pyspark.sql import functions as F

from tripmine.operators.dedup import by_departure
from tripmine.plans import jobs
from tripmine.sinks.flights import load_statistics, load_tracked
from tripmine.sinks.seen import SeenIds
from workload import tables

BODY = "Flight No. VJ 123\nFrom: SGN To: HAN\nDate: {}\n"


def write_batch(folder, name, year, *dates):
    mails = [
        {"id": f"{name}{i}", "subject": "VietJet", "from": "x", "date": None, "body": BODY.format(d)}
        for i, d in enumerate(dates)
    ]
    data = {"metadata": {"fetch_date": "", "year": year, "email_count": len(mails)}, "emails": mails}
    (folder / f"emails_{year}_{name}.json").write_text(json.dumps(data, indent=2))


def test_history_job(spark, tmp_path):
    write_batch(tmp_path, "001", 2026, "2 May 2026", "1 May 2026")
    write_batch(tmp_path, "002", 2026, "2 May 2026", "9 May 2026")
    write_batch(tmp_path, "001", 2025, "7 May 2025")

    def run(name, **settings):
        target = str(tmp_path / name)
        meta = jobs.history_job(spark, str(tmp_path), target, **settings).first()
        flights = spark.read.parquet(f"{target}/flights")
        days = [r.departure_datetime for r in flights.orderBy(*by_departure(flights)).collect()]
        return meta.email_count, meta.flight_count, days

    assert run("year", year=2026) == (4, 3, ["1 May 2026", "2 May 2026", "9 May 2026"])
    assert run("latest", year=2026, latest_only=True) == (2, 2, ["2 May 2026", "9 May 2026"])
    assert run("all") == (5, 4, ["1 May 2026", "2 May 2026", "7 May 2025", "9 May 2026"])
    assert run("file", file="emails_2025_001.json") == (1, 1, ["7 May 2025"])


def test_history_job_equals_the_plan_on_the_table(spark, sf_dir, tmp_path):
    from tripmine.plans.history import history

    jobs.history_job(spark, tables.email_batches(spark, sf_dir), str(tmp_path / "h"))
    shown = ["flight_number", "departure_datetime", "departure_airport", "arrival_airport", "confirmation_code"]
    got = spark.read.parquet(str(tmp_path / "h/flights")).select(shown)
    expected = history(tables.mail(spark, sf_dir)).select(shown)
    assert sorted(got.collect()) == sorted(expected.collect())


def test_gate_job_remembers_ids(spark, mails, tmp_path):
    mail = mails(("Boarding pass", "x", "flight VN123"), ("Note", "x", "hello"))
    store = str(tmp_path / "store")
    none = spark.createDataFrame([], "id string")
    metadata, ids = jobs.gate_job(mail, store, "one", 2026, none)
    assert metadata.first().email_count == 1 and {r.id for r in ids.collect()} == {"m0", "m1"}
    again, more = jobs.gate_job(mail, store, "two", 2026, ids)
    assert again is None and more.count() == 0


def test_gate_job_with_remembered_ids(spark, mails, tmp_path):
    mail = mails(("Boarding pass", "x", "flight VN123"), ("Note", "x", "hello"), ("Boarding pass", "x", "flight VN124"))
    store, seen = str(tmp_path / "store"), SeenIds(spark, str(tmp_path / "seen"), buckets=4)
    _, ids = jobs.gate_job(mail.where("seq < 2"), store, "one", 2026, seen)
    assert {r.id for r in ids.collect()} == {"m0", "m1"}
    metadata, ids = jobs.gate_job(mail, store, "two", 2026, seen)
    assert metadata.first().email_count == 1 and [r.id for r in ids.collect()] == ["m2"]
    again, more = jobs.gate_job(mail, store, "three", 2026, seen)
    assert again is None and more.count() == 0


def test_tracker_job(spark, sf_dir, tmp_path):
    jobs.tracker_job(tables.raw_messages(spark, sf_dir), str(tmp_path))
    flights = spark.read.parquet(str(tmp_path / "flights"))
    statistics = load_statistics(spark, str(tmp_path))
    counts = {r.metric: r.n for r in statistics.groupBy("metric").agg(F.sum("flights").alias("n")).collect()}
    assert counts["flights"] == counts["month"] == flights.count()
    march = load_tracked(spark, str(tmp_path), "March")
    assert march.count() == statistics.where("name = 'March'").first().flights
    scan = march._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in scan
