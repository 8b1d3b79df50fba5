"""Second-generation tracker: messages to flights and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripmine.functions.text import text
from tripmine.operators.dedup import first_record
from tripmine.operators.extract import tracked_flight, tracker_gate
from tripmine.operators.filters import search_tracker
from tripmine.operators.stats import all_statistics
from tripmine.sources.messages import tracker_text


def track(messages: DataFrame) -> DataFrame:
    """Unique flights of raw messages, which carry a ``seq`` for their order."""
    read = tracker_text(messages)
    keep = [c for c in read.columns if c != "text"]
    return first_record(tracker_gate(tracked_flight(read, keep=keep)))


def track_mail(mail: DataFrame, year: int, days: int = 365, limit: int | None = None) -> DataFrame:
    """The same for stored mail: search, extract, gate, first of each id."""
    hits = search_tracker(mail, year, days, limit)
    searched = F.concat(text("subject"), F.lit("\n"), text("body"))
    keep = [c for c in hits.columns if c != "body"]
    return first_record(tracker_gate(tracked_flight(hits, searched, keep)))


def statistics(flights: DataFrame, **names) -> DataFrame:
    """Totals, months and top route of a flight table, from one pass over it."""
    return all_statistics(flights, **names)
