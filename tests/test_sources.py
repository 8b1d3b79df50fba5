"""Readers on files as users have them, and writers read back."""

import base64
import json
import os

import pytest
from pyspark.sql import functions as F

from tripmine.functions.scalars import rfc2822
from tripmine.operators.filters import dated_between, look_forward
from tripmine.sinks import flights as sinks
from tripmine.sinks import envelopes, store
from tripmine.sources import batches, messages, results


@pytest.fixture
def folder(tmp_path):
    def put(name, year, *ids):
        mails = [{"id": i, "subject": "s", "from": "f", "date": "d", "body": "b"} for i in ids]
        data = {"metadata": {"fetch_date": "x", "year": year, "email_count": len(ids)}, "emails": mails}
        (tmp_path / name).write_text(json.dumps(data, indent=2), encoding="utf-8")

    put("emails_2026_002.json", 2026, "b", "c")
    put("emails_2026_001.json", 2026, "a")
    put("emails_2025_001.json", 2025, "z")
    (tmp_path / "emails_2026_003.json").write_text('{"emails": [')
    (tmp_path / "other.json").write_text("{}")
    return str(tmp_path)


def ids(df):
    return [r.id for r in df.orderBy("seq").collect()]


def test_by_year_in_file_order(spark, folder):
    assert ids(batches.load_emails(spark, folder, year=2026)) == ["a", "b", "c"]


def test_all_batches(spark, folder):
    assert ids(batches.load_emails(spark, folder)) == ["z", "a", "b", "c"]


def test_named_file(spark, folder):
    absolute = f"{folder}/emails_2025_001.json"
    assert ids(batches.load_emails(spark, folder, file=absolute)) == ["z"]
    assert ids(batches.load_emails(spark, folder, file="emails_2025_001.json")) == ["z"]
    # A name nobody knows loads the year.
    assert ids(batches.load_emails(spark, folder, year=2025, file="none.json")) == ["z"]
    # A broken one loads nothing.
    assert ids(batches.load_emails(spark, folder, file="emails_2026_003.json")) == []


def test_nothing_there(spark, folder):
    empty = batches.load_emails(spark, folder, year=1999)
    assert empty.count() == 0
    assert empty.schema.names == batches.load_emails(spark, folder).schema.names
    assert batches.latest_batch(spark, folder, 1999) is None
    assert batches.available_years(spark, f"{folder}/none").count() == 0


def test_latest_and_years(spark, folder):
    os.utime(f"{folder}/emails_2026_001.json")
    assert batches.latest_batch(spark, folder, 2026).endswith("/emails_2026_003.json")
    assert ids(batches.load_latest(spark, folder, 2025)) == ["z"]
    assert [r.year for r in batches.available_years(spark, folder).collect()] == [2025, 2026]


def test_single_mails_in_range(spark, tmp_path):
    dates = {
        "in": "Tue, 03 Feb 2026 10:00:00 +0000",
        "edge": "Thu, 1 Jan 2026 07:00:00 +0700",
        "before": "Thu, 1 Jan 2026 06:59:59 +0700",
        "bad": "soon",
    }
    for name, date in dates.items():
        mail = {"id": name, "subject": "s", "from": "f", "date": date, "body": "b"}
        (tmp_path / f"{name}.json").write_text(json.dumps(mail, indent=2))
    (tmp_path / "broken.json").write_text("{")
    found = batches.load_single_mails(spark, str(tmp_path)).where(dated_between(2026))
    assert {r.id for r in found.collect()} == {"in", "edge"}


def test_dates(spark):
    texts = ["Tue, 03 Feb 2026 10:00:00 +0000", "tue, 3 feb 2026 9:5:1 Z", "Tue, 31 Feb 2026 10:00:00 +0000", "3 Feb 2026", None]
    df = spark.createDataFrame([(t,) for t in texts], "d string")
    at = F.date_format(rfc2822(F.col("d")), "yyyy-MM-dd HH:mm:ss")
    assert [r[0] for r in df.select(at).collect()] == ["2026-02-03 10:00:00", "2026-02-03 09:05:01", None, None, None]


def test_look_forward():
    first, last = look_forward(2024, 31, "02-01")
    assert (first.isoformat(), last.isoformat()) == ("2024-02-01T00:00:00", "2024-03-03T00:00:00")
    for bad in ("13-01", "0101", "x-y", "02-30"):
        with pytest.raises(ValueError):
            look_forward(2026, 1, bad)


def encoded(text):
    return base64.urlsafe_b64encode(text.encode()).decode()


def message(number, payload, **more):
    return {"id": f"m{number}", "threadId": "t", "internalDate": "1", "snippet": "sn", "payload": payload} | more


def test_messages(spark, tmp_path):
    headers = [{"name": "SUBJECT", "value": "one"}, {"name": "subject", "value": "two"}, {"name": "From", "value": "f"}]
    body = "Grüße >>> ???   vuelo"
    payloads = [
        {"headers": headers, "mimeType": "text/plain", "body": {"data": encoded(body)}},
        {"headers": [], "mimeType": "multipart", "parts": [
            {"mimeType": "text/html", "body": {"data": encoded("<p>")}},
            {"mimeType": "text/plain", "body": {"data": encoded("plain")}},
            {"mimeType": "text/plain", "body": {"data": encoded("second")}},
        ]},
        {"headers": [], "mimeType": "multipart", "parts": [{"mimeType": "text/html", "body": {"data": encoded("h")}}]},
        {"headers": [], "mimeType": "text/plain", "body": {}},
        {"headers": [], "mimeType": "text/plain", "body": {"data": "%%%"}},
        {"headers": [], "mimeType": "text/plain", "body": {"data": base64.urlsafe_b64encode(b"\xff\xfe").decode()}},
    ]
    path = tmp_path / "raw.json"
    path.write_text("\n".join(json.dumps(message(i, p)) for i, p in enumerate(payloads)))
    from tripmine.schemas import RAW_MESSAGE

    raw = spark.read.schema(RAW_MESSAGE).json(str(path))
    rows = {r.id: (r.subject, r.sender, r.date, r.body) for r in messages.normalise(raw).collect()}
    assert rows == {
        "m0": ("one", "f", None, body),
        "m1": ("No Subject", "Unknown Sender", None, "plain"),
        "m2": ("No Subject", "Unknown Sender", None, None),
    }
    assert {r.id for r in messages.quarantined(raw).collect()} == {"m4", "m5"}
    texts = {r.id: (r.subject, r.text) for r in messages.tracker_text(raw).collect()}
    assert texts["m0"] == ("two", "two\nsn") and texts["m3"] == ("", "\nsn")


def test_store(spark, mails, tmp_path):
    path = str(tmp_path / "store")
    mail = mails(("a", "x", "b"), ("c", "y", None))
    metadata = store.save_batch(mail, path, "one", 2025)
    assert [(r.year, r.email_count) for r in metadata.collect()] == [(2025, 2)]
    store.save_batch(mail.limit(1), path, "two", F.lit(2026))
    assert store.load_store(spark, path).count() == 3
    assert [r.batch_id for r in store.load_store(spark, path, 2026).collect()] == ["two"]
    with pytest.raises(ValueError):
        store.save_batch(mail, path, "one", 2025)
    assert store.save_batch(mail.where("false"), path, "none", 2025) is None
    assert store.store_metadata(spark, path).count() == 2


def test_empty_batch_leaves_nothing(spark, mails, tmp_path):
    path = str(tmp_path / "store")
    mail = mails(("a", "x", "b"))
    assert store.save_batch(mail.where("false"), path, "one", 2025) is None
    assert store.load_store(spark, path).collect() == [] and store.load_store(spark, path, 2025).count() == 0
    assert store.store_metadata(spark, path).collect() == []
    assert store.save_batch(mail, path, "one", 2025).first().email_count == 1
    assert store.load_store(spark, path).count() == 1


def test_envelopes_are_packed_in_order(spark, tmp_path):
    rows = [(i, f"m{i}", "s" * (i % 7), None if i % 3 else "x", "d", "é\n\"" * (i % 50)) for i in range(500)]
    mail = spark.createDataFrame(rows, "seq bigint, id string, subject string, sender string, date string, body string")
    folder = str(tmp_path)
    path = envelopes.save_envelopes(mail.repartition(7), folder, 2025, "one", fetch_date="now", file_bytes=4000)
    loaded = batches.load_emails(spark, folder, year=2025).orderBy("seq").collect()
    assert [tuple(r)[2:] for r in loaded] == [r[1:] for r in rows]
    assert {r.batch_file for r in loaded} == {"emails_2025_one.json"}
    files = list((tmp_path / "emails_2025_one.json").rglob("*.json"))
    assert len(files) > 10
    for f in files:
        data = json.loads(f.read_text())
        assert data["metadata"] == {"fetch_date": "now", "year": 2025, "email_count": len(data["emails"])}
        # all but the last mail fit
        assert sum(len(json.dumps(m, ensure_ascii=False).encode()) for m in data["emails"][:-1]) < 4000 * 1.2
    with pytest.raises(ValueError):
        envelopes.save_envelopes(mail, folder, 2025, "one")
    assert envelopes.save_envelopes(mail.where("false"), folder, 2025, "two") is None
    assert batches.latest_batch(spark, folder, 2025) == path


def test_unreadable_batches(spark, tmp_path):
    good = {"metadata": {"year": 2025}, "emails": [{"id": "1"}]}
    texts = {"a": json.dumps(good), "b": json.dumps(good, indent=1)[:-9], "c": '{"metadata": {"year": 2025}}', "d": "", "e": "no json",
             "f": '{"emails": []}', "g": "[1, 2]"}
    for name, content in texts.items():
        (tmp_path / f"emails_2025_{name}.json").write_text(content)
    found = {r.batch_file[12]: r.reason for r in batches.unreadable_batches(spark, str(tmp_path), 2025).collect()}
    loaded = {r.batch_file[12] for r in batches.load_emails(spark, str(tmp_path)).collect()}
    assert loaded == {"a"} and found["b"] == found["e"] == "not json" and found["c"] == "no mails"
    assert not {"a", "f"} & set(found)
    assert batches.unreadable_batches(spark, str(tmp_path / "none")).collect() == []


def test_json_lines(spark, mails, tmp_path):
    path = store.save_json_lines(mails(("a", "x", "b")).drop("seq"), str(tmp_path), 2025, "one")
    assert batches.load_single_mails(spark, path, multi_line=False).first().sender == "x"


def test_results_and_reports(spark, tmp_path):
    old, new = tmp_path / "flights_2027.json", tmp_path / "flights_2026.json"
    flights = [
        {"id": "1", "date": "1767225600000", "flightNumber": "VN1", "airline": "VN", "confirmationCode": "C"},
        {"id": "2", "date": "soon", "flightNumber": "VN2"},
        {"id": "3"},
    ]
    old.write_text(json.dumps({"flights": []}))
    new.write_text(json.dumps({"flights": flights, "statistics": {}}, indent=2))
    os.utime(old, (1_000_000, 1_000_000))
    assert results.latest_results(spark, str(tmp_path)).endswith("/flights_2026.json")
    loaded = results.load_results(spark, str(new))
    sinks.save_listing(loaded, str(tmp_path / "listing"))
    assert [r.value for r in spark.read.text(str(tmp_path / "listing")).collect()] == [
        "- Flight: VN1 | Airline: VN | Confirmation: C | Date: 2026-01-01 00:00",
        "- Flight: VN2",
        "- ",
    ]
    sinks.save_csv(loaded, str(tmp_path / "csv"))
    lines = spark.read.text(str(tmp_path / "csv")).collect()
    assert [r.value for r in lines][:2] == [
        "flight_number,airline,departure_airport,arrival_airport,departure_datetime,arrival_datetime,duration",
        "VN1,VN,,,2026-01-01 00:00,,",
    ]


def test_no_flights_no_metadata(spark, tmp_path):
    none = spark.createDataFrame([], "seq bigint, flight_number string")
    assert sinks.save_flights(none, str(tmp_path / "none"), 5).count() == 0
    one = spark.createDataFrame([(1, "VN1")], "seq bigint, flight_number string")
    row = sinks.save_flights(one, str(tmp_path / "one"), 5, 2026).first()
    assert (row.year, row.email_count, row.flight_count) == (2026, 5, 1)
