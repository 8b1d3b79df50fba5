"""Travel history from stored mail (first generation)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripmine import rules
from tripmine.functions.airline import of_airline
from tripmine.operators.dedup import best_record, by_departure
from tripmine.operators.enrich import datable_extractions, itinerary_gate, or_extraction, with_confidence
from tripmine.operators.extract import flight, flights_only, vietjet_flight
from tripmine.workspace import as_table

#: What goes on from a mail once its flight is extracted.
SLIM = ("seq", "id")


def found_flights(
    mail: DataFrame,
    decisions: DataFrame | None = None,
    extractions: DataFrame | None = None,
    threshold: float = rules.ITINERARY_SKIP_THRESHOLD,
) -> DataFrame:
    """All flights found in mail, before duplicates are removed.

    Extraction runs where the mail is read. Decisions and extractions then
    meet rows of two columns and a flight; no body is ever shuffled, and both
    joins use the same split by id.
    """
    found = flight(mail, keep=SLIM)
    if decisions is not None:
        found = itinerary_gate(found, decisions, threshold)
    if extractions is not None:
        found = or_extraction(found, extractions)
    return flights_only(found).drop("id")


def datable_flights(
    mail: DataFrame,
    decisions: DataFrame | None = None,
    threshold: float = rules.ITINERARY_SKIP_THRESHOLD,
) -> DataFrame:
    """The part of :func:`found_flights` that can enter a history.

    Only the VietJet rules find a departure, and a flight without one is never
    listed. So mail of other airlines needs no pattern at all: a few
    substring tests send it away.
    """
    mail = of_airline(mail.select("seq", "id", "subject", "sender", "body"), rules.VIETJET)
    found = flights_only(vietjet_flight(mail, keep=SLIM))
    if decisions is not None:
        found = itinerary_gate(found, decisions, threshold)
    return found.drop("id")


def datable_with_external(
    mail: DataFrame,
    decisions: DataFrame | None,
    extractions: DataFrame,
    threshold: float = rules.ITINERARY_SKIP_THRESHOLD,
) -> DataFrame:
    """The part of :func:`found_flights` that can enter a history, with external records.

    A mail's own flight decides its way before anything is joined: with a departure it is
    listed as it is; without one it never is, and takes no external record either;
    only mail without own flight meets the records, in an inner join, so that few records
    shorten the mail side and the other way round. What rules find is written once,
    as both ways read it.
    """
    own = F.col("flight.departure_datetime")
    found = flight(mail, keep=SLIM).where(F.col("flight").isNull() | (own != ""))
    found = as_table(found, "found")
    listed = found.where(F.col("flight").isNotNull()).withColumn("flight", with_confidence(F.col("flight")))
    open_ = found.where(F.col("flight").isNull())
    both = listed.unionByName(datable_extractions(open_, extractions))
    if decisions is not None:
        both = itinerary_gate(both, decisions, threshold)
    return flights_only(both).drop("id")


def history(
    mail: DataFrame,
    decisions: DataFrame | None = None,
    extractions: DataFrame | None = None,
    threshold: float = rules.ITINERARY_SKIP_THRESHOLD,
    ordered: bool = True,
) -> DataFrame:
    """Unique flights in departure order.

    ``decisions`` and ``extractions`` are tables of externally computed
    results, one row per mail id; both are optional.
    """
    if extractions is None:
        found = datable_flights(mail, decisions, threshold)
    else:
        found = datable_with_external(mail, decisions, extractions, threshold)
    unique = best_record(found)
    return unique.orderBy(*by_departure(unique)) if ordered else unique
