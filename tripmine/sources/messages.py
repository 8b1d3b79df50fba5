"""Mail-service messages to mail rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripmine import rules
from tripmine.functions.text import evaluated


def _named(name: str) -> Column:
    return F.filter("payload.headers", lambda h: F.lower(h["name"]) == name)


def first_header(name: str) -> Column:
    """Value of the first header of that name, in any case; else null."""
    return F.get(_named(name), F.lit(0))["value"]


def last_header(name: str) -> Column:
    """Value of the last header of that name, in any case; else null."""
    return F.try_element_at(_named(name), F.lit(-1))["value"]


def decoded(data: Column) -> Column:
    """URL-safe base64 of UTF-8 text; null if it is neither."""
    standard = F.translate(data, "-_", "+/")
    return F.try_validate_utf8(F.try_to_binary(standard, F.lit("base64")).cast("string"))


def _with_body(messages: DataFrame) -> DataFrame:
    """Add ``body``, and ``__kept`` / ``__bad`` for how its data was found.

    With parts, the first ``text/plain`` part counts, and there may be none;
    without parts, the message's own data, and without that the row goes.
    """
    parts, own = F.col("payload.parts"), F.col("payload.body.data")
    plain = F.get(F.filter(parts, lambda p: p["mimeType"] == "text/plain"), F.lit(0))
    data = F.when(parts.isNotNull(), plain["body"]["data"]).otherwise(own)
    wanted = F.when(parts.isNotNull(), plain.isNotNull()).otherwise(own.isNotNull())
    df = messages.withColumn("__kept", parts.isNotNull() | own.isNotNull())
    df = df.withColumn("__wanted", wanted).withColumn("body", decoded(data))
    df = df.withColumn("__bad", F.col("__wanted") & F.col("body").isNull())
    own = [c for c in messages.columns if c != "body"]
    return evaluated(df, [*own, "body", "__kept", "__bad"], own)


def normalise(messages: DataFrame) -> DataFrame:
    """Messages as mail rows with header defaults; undecodable ones are left
    to :func:`quarantined`."""
    others = [c for c in messages.columns if c not in ("id", "payload", "body")]
    return (
        _with_body(messages)
        .where(F.col("__kept") & ~F.col("__bad"))
        .select(
            "id",
            F.coalesce(first_header("subject"), F.lit(rules.NO_SUBJECT)).alias("subject"),
            F.coalesce(first_header("from"), F.lit(rules.UNKNOWN_SENDER)).alias("sender"),
            first_header("date").alias("date"),
            "body",
            *others,
        )
    )


def quarantined(messages: DataFrame) -> DataFrame:
    """Messages whose text part cannot be decoded."""
    return _with_body(messages).where(F.col("__bad")).select(*messages.columns)


def tracker_text(messages: DataFrame) -> DataFrame:
    """Second-generation view of a message: headers by lower-cased name, the
    last of several wins, and the text that is searched."""
    subject = F.coalesce(last_header("subject"), F.lit(""))
    others = [c for c in messages.columns if c not in ("id", "threadId", "internalDate", "payload", "snippet")]
    return messages.select(
        "id",
        F.col("threadId").alias("thread_id"),
        F.col("internalDate").alias("internal_date"),
        subject.alias("subject"),
        F.coalesce(last_header("from"), F.lit("")).alias("sender"),
        F.concat(subject, F.lit("\n"), F.coalesce("snippet", F.lit(""))).alias("text"),
        *others,
    )
