"""Airline detection by ordered keyword and domain rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripmine import rules
from tripmine.functions.text import any_of, evaluated, literal, lowered

#: Lower-case text and sender the rules look at, each computed once per mail.
WORDS = "lower(concat(coalesce(subject, ''), ' ', coalesce(body, '')))"


def with_haystacks(mail: DataFrame) -> DataFrame:
    return mail.withColumns({"__words": F.expr(WORDS), "__address": F.expr(lowered("sender"))})


def _rules(keywords, domains) -> str:
    arms = [f"WHEN {any_of('__words', keys)} THEN {literal(name)}" for name, keys in keywords]
    arms += [
        f"WHEN {any_of('__address', [domain])} THEN {literal(name)}" for domain, name in domains
    ]
    return f"CASE {' '.join(arms)} ELSE {literal(rules.UNKNOWN_AIRLINE)} END"


def airline(keywords=rules.AIRLINE_KEYWORDS, domains=rules.AIRLINE_DOMAINS) -> Column:
    """Name of the first airline whose keyword is in the text, else of the
    first whose domain is in the sender, else ``Unknown Airline``.

    Reads the columns of :func:`with_haystacks`.
    """
    return F.expr(_rules(keywords, domains))


def is_airline(
    name: str, keywords=rules.AIRLINE_KEYWORDS, domains=rules.AIRLINE_DOMAINS
) -> Column:
    """``airline(...) == name``, but the full rule list is tried only on mails
    that pass one of the airline's own rules.

    Reads the columns of :func:`with_haystacks`.
    """
    own_words = [key for rule, keys in keywords if rule == name for key in keys]
    own_domains = [domain for domain, rule in domains if rule == name]
    own = [any_of("__words", own_words)] if own_words else []
    own += [any_of("__address", own_domains)] if own_domains else []
    return F.expr(f"({' OR '.join(own) or 'false'}) AND {_rules(keywords, domains)} = {literal(name)}")


def with_airline(mail: DataFrame, name: str = "airline", **tables) -> DataFrame:
    """Add the airline of every mail."""
    return with_haystacks(mail).withColumn(name, airline(**tables)).drop("__words", "__address")


def of_airline(mail: DataFrame, name: str, **tables) -> DataFrame:
    """Mails of one airline."""
    found = evaluated(with_haystacks(mail), [*mail.columns, "__words", "__address"], mail.columns)
    return found.where(is_airline(name, **tables)).drop("__words", "__address")
