"""Checked queries: sources, sinks, exchange formats and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tripmine.functions.text import text
from tripmine.operators.extract import tracked_flight, tracker_gate
from tripmine.plans import gate, history, report, tracker
from tripmine.operators.dedup import by_departure, numbered
from tripmine.sinks import envelopes, store
from tripmine.sinks import flights as flight_sinks
from tripmine.sources import batches, messages
from tripmine.streaming import gate as streams
from tripmine.workspace import fresh_path
from workload import tables as t
from workload.catalog import ORACLES, check
from workload.queries_flights import (
    RAW, STATISTICS, TRACKED, TRACKED_COLUMNS, TRACKED_MONTH, OWN_FLIGHTS, best_sql, statistics_rows, with_routes,
)
from workload.queries_mail import (
    DETAILS, FLAT, POTENTIAL, RFC, TEXTS, V2_OF_MAIL, _flat,
)

BATCH = f"concat('emails_', CAST(year(sent_at) AS STRING), '_', {t.HALF}, '.json')"
LOADED = f"""placed AS (SELECT *, {BATCH} AS batch_file, row_number() OVER (PARTITION BY year(sent_at), {t.HALF},
    seq // {t.CHUNK} ORDER BY seq) - 1 AS place FROM mail)"""
LOADED_COLUMNS = "batch_file, place, id, subject, sender, date, body"


def _loaded(df):
    place = F.col("seq.place").cast("bigint").alias("place")
    return df.select("batch_file", place, *batches.EMAIL_COLUMNS)


@check("src_load_year", f"WITH {LOADED} SELECT {LOADED_COLUMNS} FROM placed WHERE year(sent_at) = 1997")
def src_load_year(spark, sf_dir):
    return _loaded(batches.load_emails(spark, t.email_batches(spark, sf_dir), year=1997))


@check("src_load_all", f"WITH {LOADED} SELECT {LOADED_COLUMNS} FROM placed")
def src_load_all(spark, sf_dir):
    return _loaded(batches.load_emails(spark, t.email_batches(spark, sf_dir)))


@check("src_load_file", f"WITH {LOADED} SELECT {LOADED_COLUMNS} FROM placed WHERE batch_file = 'emails_1998_a.json'")
def src_load_file(spark, sf_dir):
    folder = t.email_batches(spark, sf_dir)
    return _loaded(batches.load_emails(spark, folder, year=1996, file="emails_1998_a.json"))


@check("src_latest_batch", f"WITH {LOADED} SELECT {LOADED_COLUMNS} FROM placed WHERE batch_file = 'emails_1999_b.json'")
def src_latest_batch(spark, sf_dir):
    return _loaded(batches.load_latest(spark, t.email_batches(spark, sf_dir), 1999))


@check("src_available_years", "SELECT DISTINCT CAST(year(sent_at) AS INT) AS year FROM mail")
def src_available_years(spark, sf_dir):
    return batches.available_years(spark, t.email_batches(spark, sf_dir))


@check("src_batch_metadata", f"SELECT {BATCH} AS batch_file, CAST(year(sent_at) AS INT) AS year, count(*) AS email_count FROM mail GROUP BY ALL")
def src_batch_metadata(spark, sf_dir):
    files = batches.batch_metadata(spark, t.email_batches(spark, sf_dir))
    return files.groupBy("batch_file", "year").agg(F.sum("email_count").alias("email_count"))


@check("src_unreadable_batches", "SELECT concat('emails_', CAST(min(year(sent_at)) AS VARCHAR), '_broken.json') AS batch_file, "
       "'not json' AS reason FROM mail")
def src_unreadable_batches(spark, sf_dir):
    return batches.unreadable_batches(spark, t.email_batches(spark, sf_dir)).select("batch_file", "reason")


@check(
    "src_sample_range",
    f"""WITH dated AS (SELECT *, CASE WHEN regexp_full_match(date, '{RFC[1:-1]}')
        THEN strptime(regexp_replace(date, '^\\w+, ', ''), '%d %b %Y %H:%M:%S %z') END AS sent FROM mail)
    SELECT id, subject, sender, date, body FROM dated WHERE epoch_ms(sent) >= epoch_ms(TIMESTAMP '1998-01-01')
      AND epoch_ms(sent) <= epoch_ms(TIMESTAMP '1998-01-01' + INTERVAL 365 DAY)""",
)
def src_sample_range(spark, sf_dir):
    def write(path):
        mail = t.mail(spark, sf_dir).withColumnRenamed("sender", "from")
        mail.select("id", "subject", "from", "date", "body").write.json(path)

    from tripmine.operators.filters import dated_between

    path = t.landed(spark, sf_dir, "single_mails", write)
    mails = batches.load_single_mails(spark, path, multi_line=False)
    return mails.where(dated_between(1998)).select(*batches.EMAIL_COLUMNS)


NORMAL = """SELECT seq, id, CASE WHEN seq % 10 = 6 THEN 'No Subject' ELSE subject END AS subject,
    CASE WHEN seq % 10 = 6 THEN 'Unknown Sender' ELSE sender END AS sender,
    CASE WHEN seq % 10 <> 6 THEN date END AS date,
    CASE seq % 10 WHEN 3 THEN NULL WHEN 8 THEN '' ELSE coalesce(body, '') END AS body
  FROM mail WHERE seq % 10 NOT IN (4, 5)"""


@check("src_normalise_messages", NORMAL)
def src_normalise_messages(spark, sf_dir):
    found = messages.normalise(t.raw_messages(spark, sf_dir))
    return found.select("seq", *batches.EMAIL_COLUMNS)


@check("src_quarantined_messages", "SELECT seq, id FROM mail WHERE seq % 10 = 5")
def src_quarantined_messages(spark, sf_dir):
    return messages.quarantined(t.raw_messages(spark, sf_dir)).select("seq", "id")


@check("src_v2_text", f"WITH {RAW} SELECT seq, id, thread_id, internal_date, subject, sender, txt AS text FROM texts")
def src_v2_text(spark, sf_dir):
    return messages.tracker_text(t.raw_messages(spark, sf_dir))


def _result_files(spark, sf_dir):
    """Result files of the tracker over all mail: mail before 1998, then the rest."""

    def write(folder):
        mail = t.mail(spark, sf_dir).select("seq", "id", "thread_id", "sent_at", "subject", "sender", "body")
        full = F.concat(text("subject"), F.lit("\n"), text("body"))
        found = tracker_gate(tracked_flight(mail, full))
        rows = found.select(
            "seq",
            "id",
            F.col("thread_id").alias("threadId"),
            F.unix_millis(F.col("sent_at").cast("timestamp")).cast("string").alias("date"),
            "subject",
            F.col("sender").alias("from"),
            "confidence",
            F.col("confirmation_code").alias("confirmationCode"),
            F.col("flight_number").alias("flightNumber"),
            "airline",
        )
        late = F.col("date").cast("bigint") >= 883612800000  # 1998-01-01
        t._envelope_files(rows.where(~late), f"{folder}/flights_old.json", "seq", "flights")
        t._envelope_files(rows.where(late), f"{folder}/flights_new.json", "seq", "flights")

    return t.landed(spark, sf_dir, "results", write)


STORED = f"""{V2_OF_MAIL}, stored AS (SELECT *, CAST(epoch_ms(sent_at) AS STRING) AS date_ms FROM v2
    WHERE confidence >= 0.4e0 AND sent_at >= TIMESTAMP '1998-01-01')"""


@check(
    "src_flight_results",
    f"""WITH {STORED} SELECT id, thread_id AS "threadId", date_ms AS date, subject, sender, confidence,
      confirmation_code AS "confirmationCode", flight_number AS "flightNumber", airline FROM stored""",
)
def src_flight_results(spark, sf_dir):
    flights = report.latest_flights(spark, _result_files(spark, sf_dir))
    return flights.withColumnRenamed("from", "sender").drop("seq", "departure_airport", "arrival_airport")


CSV = """SELECT coalesce(flight_number, '') AS flight_number, coalesce(airline, '') AS airline, '' AS departure_airport,
    '' AS arrival_airport, strftime(make_timestamp(CAST(date_ms AS BIGINT) * 1000), '%Y-%m-%d %H:%M') AS departure_datetime,
    '' AS arrival_datetime, '' AS duration FROM stored"""


def _read_csv(spark, path):
    rows = spark.read.option("header", True).csv(path)
    return rows.select(*[F.coalesce(c, F.lit("")).alias(c) for c in rows.columns])


@check("sink_csv_projection", f"WITH {STORED} {CSV}")
def sink_csv_projection(spark, sf_dir):
    path = fresh_path(spark, "csv")
    flight_sinks.save_csv(report.latest_flights(spark, _result_files(spark, sf_dir)), path)
    return _read_csv(spark, path)


LINES = """SELECT concat('- ', concat_ws(' | ', 'Flight: ' || flight_number, 'Airline: ' || airline,
    'Confirmation: ' || confirmation_code,
    'Date: ' || strftime(make_timestamp(CAST(date_ms AS BIGINT) * 1000), '%Y-%m-%d %H:%M'))) AS line FROM stored"""


@check("report_listing", f"WITH {STORED} {LINES}")
def report_listing(spark, sf_dir):
    flights = report.latest_flights(spark, _result_files(spark, sf_dir))
    return flights.select(flight_sinks.listing_line().alias("line"))


@check("report_v2", f"WITH {STORED}, report_lines AS ({LINES}), rows_csv AS ({CSV}) SELECT line FROM report_lines UNION ALL "
       "SELECT concat_ws(',', flight_number, airline, departure_datetime) FROM rows_csv")
def report_v2(spark, sf_dir):
    flights = report.latest_flights(spark, _result_files(spark, sf_dir))
    paths = report.write_report(flights, fresh_path(spark, "report"))
    lines = spark.read.text(paths["listing"]).select(F.col("value").alias("line"))
    rows = _read_csv(spark, paths["csv"])
    return lines.unionByName(
        rows.select(F.concat_ws(",", "flight_number", "airline", "departure_datetime").alias("line"))
    )


# --- sinks -------------------------------------------------------------------------

WITH_COUNT = """SELECT seq, id, subject, sender, date, body, CAST(year(sent_at) AS INT) AS year,
    count(*) OVER (PARTITION BY year(sent_at)) AS email_count"""


def _with_metadata(spark, path):
    counts = store.store_metadata(spark, path).select("year", "email_count")
    return store.load_store(spark, path).join(counts, "year")


@check("sink_email_batch", f"{WITH_COUNT} FROM mail")
def sink_email_batch(spark, sf_dir):
    path = fresh_path(spark, "store")
    mail = t.mail(spark, sf_dir)
    store.save_batch(mail.drop("labels", "thread_id"), path, "first", F.year("sent_at"))
    return _with_metadata(spark, path).drop("sent_at", "batch_id")


@check(
    "sink_gated_batch",
    f"""WITH {DETAILS} SELECT {FLAT}, CAST(year(sent_at) AS INT) AS year,
      count(*) OVER (PARTITION BY year(sent_at)) AS email_count FROM details WHERE {POTENTIAL}""",
)
def sink_gated_batch(spark, sf_dir):
    path = fresh_path(spark, "gated")
    store.save_batch(gate.gate(t.mail(spark, sf_dir)), path, "first", F.year("sent_at"))
    stored = _with_metadata(spark, path)
    details = F.col("booking_details")
    return stored.select(
        "seq", "id", details["confirmation_code"].alias("confirmation_code"),
        F.array_join(details["flight_numbers"], ", ").alias("flight_numbers"),
        details["confidence"].alias("confidence"), "year", "email_count",
    )


@check(
    "sink_flights",
    f"""WITH {OWN_FLIGHTS}, {best_sql('own')} SELECT seq, {', '.join(TEXTS)}, first_seq,
      count(*) OVER () AS flight_count, (SELECT count(*) FROM mail) AS email_count FROM best""",
)
def sink_flights(spark, sf_dir):
    path = fresh_path(spark, "flights")
    mail = t.mail(spark, sf_dir)
    metadata = flight_sinks.save_flights(history.history(mail, ordered=False), path, mail.count())
    one = metadata.select("email_count", "flight_count").first()
    written = spark.read.parquet(f"{path}/flights")
    return written.withColumns(
        {name: F.lit(one[name]).cast("bigint") for name in ("email_count", "flight_count")}
    )


@check("sink_v2", f"WITH {TRACKED} {STATISTICS}")
def sink_v2(spark, sf_dir):
    path = fresh_path(spark, "tracked")
    flight_sinks.save_tracked(with_routes(tracker.track(t.raw_messages(spark, sf_dir))), path)
    return statistics_rows(flight_sinks.load_statistics(spark, path))


def _stored_by_month(spark, sf_dir, *months):
    path = fresh_path(spark, "tracked")
    flight_sinks.save_tracked(with_routes(tracker.track(t.raw_messages(spark, sf_dir))), path)
    parts = [flight_sinks.load_tracked(spark, path, month) for month in months]
    flights = parts[0] if len(parts) == 1 else batches.union_batches(*parts)
    flights = flights.drop("departure", "arrival")
    return flights.withColumn("flight_context_count", F.col("flight_context_count").cast("bigint"))


@check("sink_v2_flights", f"WITH {TRACKED} SELECT {TRACKED_COLUMNS}, {TRACKED_MONTH} AS month FROM tracked")
def sink_v2_flights(spark, sf_dir):
    return _stored_by_month(spark, sf_dir, None)


@check("sink_v2_months", f"WITH {TRACKED}, stored AS (SELECT {TRACKED_COLUMNS}, {TRACKED_MONTH} AS month FROM tracked) "
       "SELECT * FROM stored WHERE month IN ('March', 'November')")
def sink_v2_months(spark, sf_dir):
    """Members of two months, each read from its own partition."""
    return _stored_by_month(spark, sf_dir, "March", "November")


@check("set_union_batches", f"WITH {LOADED} SELECT {LOADED_COLUMNS} FROM placed WHERE year(sent_at) IN (1996, 1998)")
def set_union_batches(spark, sf_dir):
    folder = t.email_batches(spark, sf_dir)
    parts = [batches.load_emails(spark, folder, year=year) for year in (1996, 1998)]
    return _loaded(batches.union_batches(*parts))


def _years(mail):
    return [r.year for r in mail.select(F.year("sent_at").alias("year")).distinct().orderBy("year").collect()]


def _envelopes_by_year(mail, folder):
    for year in _years(mail):
        envelopes.save_envelopes(mail.where(F.year("sent_at") == year), folder, year, "one", file_bytes=500_000)


@check("sink_json_batch", """SELECT concat('emails_', CAST(year(sent_at) AS VARCHAR), '_one.json') AS batch_file,
    row_number() OVER (PARTITION BY year(sent_at) ORDER BY seq) AS pos, id, subject, sender, date, body FROM mail""")
def sink_json_batch(spark, sf_dir):
    """Mail written as batches of envelopes, one per year, and loaded again in order."""
    folder = fresh_path(spark, "envelopes")
    _envelopes_by_year(t.mail(spark, sf_dir), folder)
    loaded = batches.load_emails(spark, folder)
    files = loaded.groupBy("seq.path").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(batches.batch_name(F.col("path"))).orderBy("path").rowsBetween(Window.unboundedPreceding, -1))
    offsets = files.select(F.col("path").alias("file"), F.coalesce(before, F.lit(0)).alias("before"))
    placed = loaded.join(offsets, F.col("seq.path") == F.col("file"))
    pos = (F.col("before") + F.col("seq.place") + 1).alias("pos")
    return placed.select("batch_file", pos, *batches.EMAIL_COLUMNS)


# --- streams -------------------------------------------------------------------------


@check("stream_gate", f"WITH {DETAILS} SELECT {FLAT} FROM details WHERE {POTENTIAL}")
def stream_gate(spark, sf_dir):
    def write(path):
        # Mail arrives twice, in other files, so that ids repeat across triggers.
        mail = t.mail(spark, sf_dir)
        mail.write.parquet(path)
        mail.repartition(8, "id").write.mode("append").parquet(path)

    landing = t.landed(spark, sf_dir, "arrivals", write)
    schema = spark.read.parquet(landing).schema
    arrivals = streams.mail_stream(spark, landing, schema, files_per_trigger=16)
    target, checkpoint = fresh_path(spark, "gated"), fresh_path(spark, "checkpoint")
    streams.start_gate(arrivals, target, checkpoint).awaitTermination()
    return _flat(spark.read.parquet(target))


#: Copies of one id fill three tenths of all rows, some mails have no id, and a third of
#: the mail comes in each of three runs, whenever it was sent.
LATE_ID = "CASE WHEN seq % 10 < 3 THEN 'one' WHEN seq % 41 = 0 THEN NULL ELSE id END"


@check(
    "stream_gate_late",
    f"""WITH named AS (SELECT * REPLACE ({LATE_ID} AS id) FROM mail),
    firsts AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq % 3, seq) AS rn FROM named)
      WHERE rn = 1), {DETAILS.replace("FROM mail)", "FROM firsts)")} SELECT {FLAT} FROM details WHERE {POTENTIAL}""",
)
def stream_gate_late(spark, sf_dir):
    folder, target, checkpoint = (fresh_path(spark, n) for n in ("late", "gated", "checkpoint"))
    mail = t.mail(spark, sf_dir).withColumn("id", F.expr(LATE_ID))
    for run in range(3):
        mail.where(F.col("seq") % 3 == run).write.mode("append").parquet(folder)
        arrivals = streams.mail_stream(spark, folder, mail.schema)
        streams.start_gate(arrivals, target, checkpoint).awaitTermination()
    return _flat(spark.read.parquet(target))


@check("stream_funnel", ORACLES["agg_funnel"], "")
def stream_funnel(spark, sf_dir):
    mail = t.mail(spark, sf_dir)
    target, checkpoint = fresh_path(spark, "gated"), fresh_path(spark, "checkpoint")
    arrivals = streams.mail_stream(spark, t.mail_folder(spark, sf_dir), mail.schema, files_per_trigger=16)
    streams.start_gate(arrivals, target, checkpoint).awaitTermination()
    return streams.stream_funnel(spark, target)


LETTERED = "translate(id, '0123456789', 'abcdefghij')"


@check(
    "two_step_history",
    f"""WITH ordered AS (SELECT * REPLACE (row_number() OVER (ORDER BY year(sent_at), seq) AS seq) FROM mail),
    {OWN_FLIGHTS.replace("FROM mail", "FROM ordered")}, {best_sql('own')} SELECT {', '.join(TEXTS)},
      row_number() OVER (ORDER BY departure_datetime, first_seq) AS pos FROM best""",
)
def two_step_history(spark, sf_dir):
    """Fetch step: stream batch files into the store. Process step: history, numbered in its order.

    Ids hold no digits, so the order can come from files and places alone.
    """

    def write(folder):
        _envelopes_by_year(t.mail(spark, sf_dir).withColumn("id", F.expr(LETTERED)), folder)

    folder = t.landed(spark, sf_dir, "lettered_batches", write)
    target, checkpoint = fresh_path(spark, "bronze"), fresh_path(spark, "checkpoint")
    streams.start_ingest(streams.batch_stream(spark, folder), target, checkpoint).awaitTermination()
    unique = history.history(streams.load_ingested(spark, target), ordered=False)
    return numbered(unique, *by_departure(unique)).drop("seq", "first_seq")


