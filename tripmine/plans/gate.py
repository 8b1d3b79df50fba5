"""Booking gate over fetched mail (first generation)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripmine.functions.booking import with_booking_details
from tripmine.operators.filters import booking_gate, potential, second_gate, unprocessed, unremembered
from tripmine.sinks.seen import SeenIds


def gate(mail: DataFrame, processed: DataFrame | SeenIds | None = None) -> DataFrame:
    """New mails that carry a booking, with ``booking_details``.

    Skipping processed ids, a table of them or the ids remembered between runs, comes
    last: it does not depend on the gate, and so only the few mails that pass are
    joined with the processed ids.
    """
    passed = booking_gate(with_booking_details(potential(mail)))
    if isinstance(processed, SeenIds):
        return unremembered(passed, processed)
    return passed if processed is None else unprocessed(passed, processed)


def newly_processed(mail: DataFrame, processed: DataFrame | SeenIds) -> DataFrame:
    """Ids to remember after a gate run: every id of the call, booking or not."""
    ids = mail.select("id").distinct()
    return unremembered(ids, processed) if isinstance(processed, SeenIds) else unprocessed(ids, processed)


def gate_nested(mail: DataFrame) -> DataFrame:
    """Second form of the gate: message, details and confidence side by side."""
    detailed = with_booking_details(potential(mail))
    details = F.col("booking_details")
    return second_gate(detailed).select(
        F.struct(*mail.columns).alias("message"),
        F.struct(
            details["confirmation_code"].alias("confirmation_code"),
            details["flight_numbers"].alias("flight_numbers"),
        ).alias("booking_details"),
        details["confidence"].alias("confidence"),
    )
