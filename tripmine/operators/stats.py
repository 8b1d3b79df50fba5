"""Counts and statistics over flights and mail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripmine.functions.booking import potential_flight, with_booking_details
from tripmine.functions.scalars import month_name
from tripmine.functions.text import text
from tripmine.rules import BOOKING_MIN_CONFIDENCE


def totals(flights: DataFrame) -> DataFrame:
    """Number of flights and of distinct airlines; a missing airline is one value."""
    return flights.agg(
        F.count("*").alias("total_flights"),
        F.count_distinct(text("airline")).alias("unique_airlines"),
    )


def with_month(flights: DataFrame, date: str = "internal_date") -> DataFrame:
    """Add the month name; its rows are the members of that month's group."""
    return flights.withColumn("month", month_name(F.col(date)))


def by_month(flights: DataFrame, date: str = "internal_date", seq: str = "seq") -> DataFrame:
    """Flights per month name over all years, and where each month came first.

    Twelve keys at most, counted inside each task before the shuffle.
    """
    return (
        with_month(flights, date)
        .where(F.col("month").isNotNull())
        .groupBy("month")
        .agg(F.count("*").alias("flights"), F.min(seq).alias("first_seq"))
    )


def top_route(
    flights: DataFrame, origin="departure", destination="arrival", seq: str = "seq"
) -> DataFrame:
    """The most frequent route; of several, the one that got there first."""
    route = F.concat(text(origin), F.lit("-"), text(destination))
    return (
        flights.groupBy(route.alias("route"))
        .agg(F.count("*").alias("flights"), F.max(seq).alias("__reached"))
        .orderBy(F.desc("flights"), "__reached")
        .limit(1)
        .drop("__reached")
    )


def all_statistics(
    flights: DataFrame, origin="departure", destination="arrival", date="internal_date", seq: str = "seq"
) -> DataFrame:
    """Totals, months and top route in one pass over the flights.

    Rows ``metric, name, flights, first_seq``: ``flights`` and ``airlines`` (number of
    flights, of distinct airlines), one ``month`` each and the ``route``. Every flight
    counts under its airline, month and route, three narrow rows that each task
    reduces before the one shuffle; all the rest works on those counts. Of several top
    routes the one that got to its count first wins.
    """
    route = F.concat(text(origin), F.lit("-"), text(destination))
    narrow = flights.select(
        text("airline").alias("airline"), month_name(F.col(date)).alias("month"), route.alias("route"), F.col(seq).alias("seq")
    )
    sets = [["airline"], ["month"], ["route"]]
    counted = narrow.groupingSets([[F.col(c) for c in s] for s in sets], "airline", "month", "route").agg(
        F.grouping_id().alias("__set"),
        F.count("*").alias("n"),
        F.min("seq").alias("first"),
        F.max("seq").alias("reached"),
    )
    # grouping ids: a bit is set for each column that is not grouped by
    metric = F.when(F.col("__set") == 3, "airline").when(F.col("__set") == 5, "month").otherwise("route")
    counted = counted.withColumn("metric", metric).where("metric <> 'month' OR month IS NOT NULL")
    name = F.when(F.col("metric") == "month", F.col("month"))
    best = F.min(F.struct((-F.col("n")).alias("n"), "reached", "route", "first")).alias("best")
    whole = counted.groupBy("metric", name.alias("name")).agg(
        F.sum("n").alias("n"), F.count("*").alias("kinds"), F.min("first").alias("first"), best
    )
    none = F.lit(None)
    row = lambda metric, name, n, first: F.struct(
        F.lit(metric).alias("metric"), name.cast("string").alias("name"), n.alias("flights"), first.alias("first_seq")
    )
    first = F.col("first")
    rows = (
        F.when(F.col("metric") == "airline", F.array(
            row("flights", none, F.col("n"), first), row("airlines", none, F.col("kinds"), first)))
        .when(F.col("metric") == "month", F.array(row("month", F.col("name"), F.col("n"), first)))
        .otherwise(F.array(row("route", F.col("best.route"), -F.col("best.n"), F.col("best.first"))))
    )
    return whole.select(F.inline(rows))


def funnel(mail: DataFrame) -> DataFrame:
    """Mails, potential flight mails and confirmed bookings in one pass."""
    flagged = mail.select(potential_flight().alias("potential"), "subject", "body")
    only = {c: F.when(F.col("potential"), F.col(c)) for c in ("subject", "body")}
    detailed = with_booking_details(flagged.withColumns(only), keep=["potential"])
    confirmed = F.col("booking_details.confidence") >= BOOKING_MIN_CONFIDENCE
    return detailed.agg(
        F.count("*").alias("total"),
        F.count_if("potential").alias("potential"),
        F.count_if(confirmed).alias("confirmed"),
    )


def batch_counts(mail: DataFrame, *batch: Column | str) -> DataFrame:
    """Mails per batch, the count its metadata carries."""
    return mail.groupBy(*batch).agg(F.count("*").alias("email_count"))
