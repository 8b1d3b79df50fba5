"""Row filters over the mail table."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripmine import rules
from tripmine.functions.booking import potential_flight, valid_code, valid_number
from tripmine.functions.scalars import rfc2822
from tripmine.functions.text import contains_any, lowered
from tripmine.sinks.seen import SeenIds, id_key


def look_forward(year: int, days: int = 365, start: str = "01-01") -> tuple[datetime, datetime]:
    """First and last instant of a range that starts on ``MM-DD`` of ``year``."""
    month, sep, day = start.partition("-")
    if not sep:
        raise ValueError(f"start date must be MM-DD, got {start!r}")
    first = datetime(year, int(month), int(day))
    return first, first + timedelta(days=days)


def sent_between(year: int, days: int = 365, start: str = "01-01", sent_at="sent_at") -> Column:
    """Sent inside the range, both ends excluded. Reaches the Parquet scan."""
    first, last = look_forward(year, days, start)
    first, last = (F.lit(str(t)).cast("timestamp_ntz") for t in (first, last))
    return (F.col(sent_at) > first) & (F.col(sent_at) < last)


def dated_between(year: int, days: int = 365, start: str = "01-01", date="date") -> Column:
    """The RFC 2822 date lies in the range, ends included; bad dates drop out."""
    first, last = look_forward(year, days, start)
    first, last = (F.lit(str(t)).cast("timestamp") for t in (first, last))
    return rfc2822(F.col(date)).between(first, last)


def search_strict() -> Column:
    """Travel word in the subject, or mail from one of four booking domains."""
    return contains_any(lowered("subject"), rules.SEARCH_STRICT_SUBJECT) | contains_any(
        lowered("sender"), rules.SEARCH_STRICT_SENDER
    )


def search_relaxed(mail: DataFrame) -> Column:
    """In the inbox; mail without a column of labels is an error."""
    if "labels" not in mail.columns:
        raise ValueError("the inbox search needs labels")
    return F.array_contains("labels", "INBOX")


def search_tracker(
    mail: DataFrame, year: int, days: int = 365, limit: int | None = None
) -> DataFrame:
    """Mails of the range with a travel sender or subject; the first ``limit`` of them if one is given."""
    hit = contains_any(lowered("sender"), rules.SEARCH_V2_SENDER) | contains_any(
        lowered("subject"), rules.SEARCH_V2_SUBJECT
    )
    found = mail.where(sent_between(year, days) & hit)
    return found if limit is None else found.orderBy("seq").limit(limit)


def potential(mail: DataFrame) -> DataFrame:
    return mail.where(potential_flight())


def booking_gate(detailed: DataFrame, threshold: float = rules.BOOKING_MIN_CONFIDENCE) -> DataFrame:
    """Details exist and reach the threshold."""
    return detailed.where(F.col("booking_details.confidence") >= threshold)


def second_gate(detailed: DataFrame) -> DataFrame:
    """Details exist and hold an empty or valid code, or any valid number."""
    details = F.col("booking_details")
    code = details["confirmation_code"]
    return detailed.where(
        details.isNotNull()
        & (
            (code == "")
            | valid_code(code)
            | F.exists(details["flight_numbers"], lambda n: valid_number(n))
        )
    )


def unprocessed(mail: DataFrame, processed: DataFrame, key: str = "id") -> DataFrame:
    """Mails whose id is not among the processed ids; a null id equals a null id.

    Ids are made distinct before they meet the mail, so one id that fills the
    processed table arrives as one row. Many copies of one mail id are split
    over tasks by adaptive execution, which may split the left side of an
    anti join.
    """
    seen = processed.select(F.col(key).alias("__seen")).distinct()
    return mail.join(seen, F.col(key).eqNullSafe(F.col("__seen")), "left_anti")


def unremembered(mail: DataFrame, seen: SeenIds, key: str = "id") -> DataFrame:
    """The same against a table of remembered ids, which is read as it lies and not shuffled."""
    return seen.unseen(mail.withColumn("__key", id_key(key)), "__key").drop("__key")
