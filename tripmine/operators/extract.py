"""Flight extraction: one mail row in, the mail's flight fields out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripmine import rules
from tripmine.functions.airline import airline, is_airline, with_haystacks
from tripmine.functions.text import evaluated, first_by_pattern, literal, may_match, text
from tripmine.schemas import FLIGHT_TEXT_FIELDS

LETTER = r"\p{L}"


def _flight(number, departure, origin, destination, code, carrier) -> Column:
    values = (number, departure, F.lit(""), origin, destination, code, carrier)
    return F.struct(*[v.alias(n) for v, n in zip(values, FLIGHT_TEXT_FIELDS)])


def _g(name: str, group: int = 1) -> Column:
    return F.col(name)[f"g{group}"]


def _no_spaces(column: Column) -> Column:
    return F.replace(column, F.lit(" "), F.lit(""))


def _with_vietjet(df: DataFrame, name: str, where: Column | None = None) -> DataFrame:
    """Add ``name``: the VietJet flight struct, or null."""
    keep = [*df.columns, name]
    body, both = text("body"), F.concat(text("subject"), F.lit(" "), text("body"))
    if where is not None:
        body, both = F.when(where, body), F.when(where, both)
    df = df.withColumns({"__body": body, "__both": both})
    df = first_by_pattern(df, "__number", "__body", rules.VIETJET_NUMBER)
    df = df.withColumn("__rest", F.when(F.col("__number").isNotNull(), F.col("__body")))
    df = first_by_pattern(df, "__airports", "__rest", rules.VIETJET_AIRPORTS, groups=2)
    done = F.col("__airports").isNotNull()
    df = df.withColumns(
        {"__rest": F.when(done, F.col("__rest")), "__both": F.when(done, F.col("__both"))}
    )
    df = first_by_pattern(df, "__date", "__rest", rules.VIETJET_DATE)
    df = first_by_pattern(df, "__code", "__both", rules.VIETJET_CODE)
    flight = _flight(
        _no_spaces(_g("__number")),
        F.coalesce(_g("__date"), F.lit("")),
        _g("__airports", 1),
        _g("__airports", 2),
        F.coalesce(_g("__code"), F.lit("")),
        F.lit(rules.VIETJET),
    )
    return df.withColumn(name, F.when(done, flight)).select(*keep)


def _with_generic(df: DataFrame, name: str, where: Column | None = None) -> DataFrame:
    """Add ``name``: the generic flight struct, or null. Expects the columns of
    :func:`with_haystacks`; the airline is looked up for found flights only."""
    keep = [*df.columns, name]
    both = F.concat(text("body"), F.lit(" "), text("subject"))
    df = df.withColumn("__both", both if where is None else F.when(where, both))
    # The first two patterns need one of these words; the third starts with the number.
    named = may_match("__both", "__words", rules.GENERIC_NUMBER_WORDS)
    df = first_by_pattern(
        df, "__number", "__both", rules.GENERIC_NUMBER,
        accept=lambda g: f"{g[0]} RLIKE {literal(LETTER)}", possible=[named, named],
    )
    df = df.withColumn("__rest", F.when(F.col("__number").isNotNull(), F.col("__both")))
    df = first_by_pattern(
        df, "__airports", "__rest", rules.GENERIC_AIRPORTS, groups=2,
        accept=lambda g: f"{g[0]} <> {g[1]}",
    )
    done = F.col("__airports").isNotNull()
    df = df.withColumn("__rest", F.when(done, F.col("__rest")))
    df = first_by_pattern(df, "__code", "__rest", rules.GENERIC_CODE)
    flight = _flight(
        _no_spaces(_g("__number")),
        F.lit(""),
        _g("__airports", 1),
        _g("__airports", 2),
        F.coalesce(_g("__code"), F.lit("")),
        airline(),
    )
    return df.withColumn(name, F.when(done, flight)).select(*keep)


def vietjet_flight(mail: DataFrame, name: str = "flight", keep=None) -> DataFrame:
    """VietJet rules on every mail; ``flight`` is null where they do not apply.

    ``keep`` names the mail columns to carry on; by default all, but jobs that
    go on to shuffle should leave the body behind.
    """
    return evaluated(_with_vietjet(mail, name), _kept(mail, keep, name), _untouched(mail, name))


def generic_flight(mail: DataFrame, name: str = "flight", keep=None) -> DataFrame:
    """Four-language rules on every mail; they never find a departure time."""
    return evaluated(_with_generic(with_haystacks(mail), name), _kept(mail, keep, name), _untouched(mail, name))


def flight(mail: DataFrame, name: str = "flight", keep=None) -> DataFrame:
    """VietJet rules for VietJet mail, generic rules for all the rest."""
    df = with_haystacks(mail).withColumn("__is_own", is_airline(rules.VIETJET))
    df = _with_vietjet(df, "__own", F.col("__is_own"))
    df = _with_generic(df, "__generic", F.col("__own").isNull())
    df = df.withColumn(name, F.coalesce("__own", "__generic"))
    return evaluated(df, _kept(mail, keep, name), _untouched(mail, name))


def _untouched(mail: DataFrame, name: str) -> list[str]:
    return [c for c in mail.columns if c != name]


def _kept(mail: DataFrame, keep, name: str) -> list[str]:
    return [*(mail.columns if keep is None else keep), name]


def flights_only(df: DataFrame, name: str = "flight") -> DataFrame:
    """Keep mails with a flight and spread its fields into columns."""
    others = [c for c in df.columns if c != name]
    return df.where(F.col(name).isNotNull()).select(*others, f"{name}.*")


def tracked_flight(
    messages: DataFrame, full_text: Column | str = "text", keep=None
) -> DataFrame:
    """Second-generation record: adds code, number, two-letter airline,
    confidence and the counts it rests on. All rows are kept, and of the
    message the columns in ``keep``, by default all."""
    columns = list(messages.columns if keep is None else keep)
    full_text = F.col(full_text) if isinstance(full_text, str) else full_text
    df = messages.withColumn("__text", full_text).withColumn("__low", F.lower("__text"))
    df = first_by_pattern(
        df, "__code", "__text", [rules.TRACKER_CODE],
        possible=[may_match("__text", "__low", rules.TRACKER_CODE_WORDS)],
    )
    df = first_by_pattern(df, "__number", "__text", [rules.TRACKER_NUMBER], groups=2)
    in_context = F.expr(may_match("__text", "__low", rules.TRACKER_CONTEXT_WORDS))
    count = F.regexp_count("__text", F.lit(rules.TRACKER_CONTEXT))
    df = df.withColumn("flight_context_count", F.when(in_context, count).otherwise(0))
    has_code, has_number = F.col("__code").isNotNull(), F.col("__number").isNotNull()
    confidence = (
        F.when(has_code, rules.SCORE_CODE).otherwise(0.0)
        + F.when(has_number, rules.SCORE_NUMBER).otherwise(0.0)
        + F.least(
            F.col("flight_context_count") * F.lit(rules.TRACKER_CONTEXT_STEP),
            F.lit(rules.TRACKER_CONTEXT_MAX),
        )
    )
    df = df.withColumns(
        {
            "confirmation_code": _g("__code"),
            "flight_number": F.concat(_g("__number", 1), _g("__number", 2)),
            "airline": _g("__number", 1),
            "confidence": confidence,
            "has_confirmation_code": has_code,
            "has_flight_number": has_number,
        }
    )
    added = [
        "confirmation_code",
        "flight_number",
        "airline",
        "confidence",
        "has_confirmation_code",
        "has_flight_number",
        "flight_context_count",
    ]
    return evaluated(df, columns + added, [c for c in columns if c not in added])


def tracker_gate(tracked: DataFrame, threshold: float = rules.TRACKER_MIN_CONFIDENCE) -> DataFrame:
    """Keep records with at least one of the two identifiers."""
    return tracked.where(F.col("confidence") >= threshold)
