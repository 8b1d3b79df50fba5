"""Checked queries: flights, statistics and whole jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripmine.operators import dedup, stats
from tripmine.plans import history, tracker
from workload import tables as t
from workload.catalog import check
from workload.queries_mail import (
    FALLBACK, KEPT, MONTH, TEXTS, TRUTHS, V2_COLUMNS, V2_SEARCH, IN_1996, v2_sql,
)

FIELDS = ", ".join([*TEXTS, "confidence"])


def best_sql(source: str) -> str:
    """One row per flight key of ``source``: most filled, then earliest."""
    filled = " + ".join(f"CAST({c} IS NOT NULL AS INT)" for c in [*TEXTS, "confidence"])
    return f"""ranked AS (SELECT *, row_number() OVER w AS rn, min(seq) OVER (PARTITION BY flight_number,
      split_part(departure_datetime, 'T', 1), departure_airport, arrival_airport) AS first_seq
    FROM {source} WHERE flight_number <> '' AND departure_datetime <> ''
    WINDOW w AS (PARTITION BY flight_number, split_part(departure_datetime, 'T', 1), departure_airport, arrival_airport
      ORDER BY {filled} DESC, seq)),
  best AS (SELECT seq, {FIELDS}, first_seq FROM ranked WHERE rn = 1)"""


@check("agg_dedup_best", f"WITH {best_sql('flights')} SELECT * FROM best", "flights")
def agg_dedup_best(spark, sf_dir):
    flights = t.flights(spark, sf_dir).drop("id", "thread_id", "internal_date")
    return dedup.best_record(flights)


@check(
    "agg_dedup_first",
    """SELECT seq, id, thread_id, flight_number FROM (SELECT *, row_number() OVER (PARTITION BY id, thread_id ORDER BY seq) AS rn
    FROM flights) WHERE rn = 1""",
    "flights",
)
def agg_dedup_first(spark, sf_dir):
    flights = t.flights(spark, sf_dir).select("seq", "id", "thread_id", "flight_number")
    return dedup.first_record(flights)


@check(
    "sort_flights",
    f"""WITH {best_sql('flights')} SELECT *, row_number() OVER (ORDER BY coalesce(departure_datetime, ''), first_seq) AS pos
    FROM best""",
    "flights",
)
def sort_flights(spark, sf_dir):
    flights = t.flights(spark, sf_dir).drop("id", "thread_id", "internal_date")
    unique = dedup.best_record(flights)
    return dedup.numbered(unique, *dedup.by_departure(unique))


@check(
    "agg_totals",
    """SELECT count(*) AS total_flights, count(DISTINCT coalesce(airline, '')) AS unique_airlines
    FROM (SELECT flight_number AS airline FROM flights)""",
    "flights",
)
def agg_totals(spark, sf_dir):
    return stats.totals(t.flights(spark, sf_dir).select(F.col("flight_number").alias("airline")))


@check(
    "agg_by_month",
    f"""SELECT month, count(*) AS flights, min(seq) AS first_seq FROM (SELECT seq, {MONTH} AS month FROM flights)
    WHERE month IS NOT NULL GROUP BY month""",
    "flights",
)
def agg_by_month(spark, sf_dir):
    return stats.by_month(t.flights(spark, sf_dir))


@check(
    "agg_top_route",
    """SELECT route, count(*) AS flights FROM (SELECT seq, concat(coalesce(departure_airport, ''), '-',
      coalesce(arrival_airport, '')) AS route FROM flights) GROUP BY route ORDER BY count(*) DESC, max(seq) LIMIT 1""",
    "flights",
)
def agg_top_route(spark, sf_dir):
    return stats.top_route(t.flights(spark, sf_dir), "departure_airport", "arrival_airport")


# --- travel history ----------------------------------------------------------------

OWN = ", ".join(f"{tr} AS {c}" for tr, c in zip(TRUTHS, TEXTS))
OWN_FLIGHTS = f"own AS (SELECT seq, id, {OWN}, CAST(NULL AS DOUBLE) AS confidence FROM mail WHERE t_number IS NOT NULL)"


@check("history_v1", f"WITH {OWN_FLIGHTS}, {best_sql('own')} SELECT seq, {', '.join(TEXTS)}, first_seq FROM best")
def history_v1(spark, sf_dir):
    return history.history(t.mail(spark, sf_dir))


@check(
    "history_with_external",
    f"WITH {FALLBACK}, kept AS (SELECT * FROM full_flights mail WHERE {KEPT}), {best_sql('kept')} SELECT * FROM best",
    "mail decisions extractions",
)
def history_with_external(spark, sf_dir):
    return history.history(
        t.mail(spark, sf_dir), t.decisions(spark, sf_dir), t.extractions(spark, sf_dir)
    )


# --- tracker ---------------------------------------------------------------------

#: Raw messages: variant 6 has no subject or sender header, 7 a second subject.
RAW = """raw AS (SELECT *, CASE seq % 10 WHEN 6 THEN NULL WHEN 7 THEN 'Second subject' ELSE coalesce(subject, '') END AS last_subject,
    CASE WHEN seq % 10 <> 6 THEN coalesce(sender, '') END AS from_header FROM mail),
texts AS (SELECT seq, id, thread_id, CAST(epoch_ms(sent_at) AS STRING) AS internal_date,
    coalesce(last_subject, '') AS subject, coalesce(from_header, '') AS sender,
    concat(coalesce(last_subject, ''), chr(10), coalesce(body, '')) AS txt FROM raw)"""
TRACKED = f"{RAW}, {v2_sql('texts')}, tracked AS (SELECT * FROM v2 WHERE confidence >= 0.4e0)"
TRACKED_COLUMNS = f"seq, id, thread_id, internal_date, subject, sender, {V2_COLUMNS}"


def _track(spark, sf_dir):
    flights = tracker.track(t.raw_messages(spark, sf_dir))
    return flights.withColumn("flight_context_count", F.col("flight_context_count").cast("bigint"))


@check("tracker_v2", f"WITH {TRACKED} SELECT {TRACKED_COLUMNS} FROM tracked")
def tracker_v2(spark, sf_dir):
    return _track(spark, sf_dir)


TRACKED_MONTH = "strftime(make_timestamp(CAST(internal_date AS BIGINT) * 1000), '%B')"
STATISTICS = f"""SELECT 'flights' AS metric, 'all' AS name, count(*) AS n FROM tracked
  UNION ALL SELECT 'airlines', 'all', count(DISTINCT coalesce(airline, '')) FROM tracked
  UNION ALL SELECT 'month', {TRACKED_MONTH} AS m, count(*) FROM tracked GROUP BY m
  UNION ALL SELECT 'route', '-', count(*) FROM tracked"""


def statistics_rows(statistics):
    return statistics.select("metric", F.coalesce("name", F.lit("all")).alias("name"), F.col("flights").alias("n"))


def with_routes(flights):
    """Tracked flights carry no airports, so every route is ``-``."""
    none = F.lit(None).cast("string")
    return flights.withColumns({"departure": none, "arrival": none})


@check("tracker_statistics_v2", f"WITH {TRACKED} {STATISTICS}")
def tracker_statistics_v2(spark, sf_dir):
    flights = with_routes(_track(spark, sf_dir))
    return statistics_rows(tracker.statistics(flights))


@check(
    "agg_all_statistics",
    f"""WITH rows AS (SELECT seq, coalesce(airline, '') AS airline, {MONTH} AS month,
      concat(coalesce(departure_airport, ''), '-', coalesce(arrival_airport, '')) AS route FROM flights)
    SELECT 'flights' AS metric, NULL AS name, count(*) AS flights, min(seq) AS first_seq FROM rows
    UNION ALL SELECT 'airlines', NULL, count(DISTINCT airline), min(seq) FROM rows
    UNION ALL SELECT 'month', month, count(*), min(seq) FROM rows WHERE month IS NOT NULL GROUP BY month
    UNION ALL (SELECT 'route', route, count(*), min(seq) FROM rows GROUP BY route ORDER BY count(*) DESC, max(seq) LIMIT 1)""",
    "flights",
)
def agg_all_statistics(spark, sf_dir):
    return stats.all_statistics(t.flights(spark, sf_dir), "departure_airport", "arrival_airport")


@check(
    "tracker_search_v2",
    f"""WITH hits AS (SELECT seq, id, thread_id, concat(coalesce(subject, ''), chr(10), coalesce(body, '')) AS txt
      FROM mail WHERE {IN_1996} AND {V2_SEARCH}), {v2_sql('hits')}
    SELECT seq, id, thread_id, {V2_COLUMNS} FROM v2 WHERE confidence >= 0.4e0""",
)
def tracker_search_v2(spark, sf_dir):
    mail = t.mail(spark, sf_dir).drop("labels", "date")
    found = tracker.track_mail(mail, 1996)
    found = found.withColumn("flight_context_count", F.col("flight_context_count").cast("bigint"))
    return found.drop("sent_at", "subject", "sender")
