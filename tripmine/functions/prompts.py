"""Texts sent to external extraction and classification jobs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tripmine import rules
from tripmine.functions.text import text


def body_within(body, max_chars: int | None) -> Column:
    """The body, cut to ``max_chars`` where a positive cap is given."""
    if max_chars is not None and max_chars > 0:
        return F.substring(text(body), 1, max_chars)
    return text(body)


def prompt(head: str, max_body_chars: int | None = None) -> Column:
    """Request text of one mail. A missing date reads ``None``."""
    subject, sender, date, body = rules.PROMPT_LABELS
    return F.concat(
        F.lit(head + subject), text("subject"),
        F.lit("\n" + sender), text("sender"),
        F.lit("\n" + date), F.coalesce(F.col("date"), F.lit("None")),
        F.lit("\n" + body + "\n"), body_within("body", max_body_chars),
        F.lit("\n"),
    )


def prompt_chars(head: str = rules.COST_PROMPT_HEAD, max_body_chars: int | None = None) -> Column:
    """Length of :func:`prompt` without building the text."""
    fixed = len(head) + sum(len(label) + 1 for label in rules.PROMPT_LABELS) + 1
    size = F.char_length(text("body"))
    if max_body_chars is not None and max_body_chars > 0:
        size = F.least(size, F.lit(max_body_chars))
    return (
        F.lit(fixed)
        + F.char_length(text("subject"))
        + F.char_length(text("sender"))
        + F.char_length(F.coalesce(F.col("date"), F.lit("None")))
        + size
    )
