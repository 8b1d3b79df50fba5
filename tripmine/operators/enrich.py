"""Joins with tables other jobs provide: decisions, extractions, rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripmine import rules
from tripmine.functions.airline import with_haystacks
from tripmine.functions.text import blank_to_null
from tripmine.operators.dedup import valid_flight
from tripmine.operators.extract import flight
from tripmine.schemas import FLIGHT_FIELDS, FLIGHT_TEXT_FIELDS
from tripmine.workspace import as_table

#: Rule tables up to this many rows and bytes travel as one value.
INLINE_RULES = 5_000
INLINE_CHARS = 500_000
#: Needles of a length class up to this many, and their bytes, that are searched one by one.
FEW_NEEDLES, FEW_CHARS = 32, 4_000
#: Size of the filter over starts of needles, half a megabyte.
FILTER_BITS = 1 << 22


def itinerary_gate(
    mail: DataFrame, decisions: DataFrame, threshold: float = rules.ITINERARY_SKIP_THRESHOLD
) -> DataFrame:
    """Drop mails a decision calls no itinerary with enough confidence.

    ``mail`` is any table with the mail's ``id``; rows without bodies are
    cheaper to join, so plans gate what was extracted, not what was read.

    Only rejecting decisions can drop a mail, so just those enter the join, as
    an anti join on the mail id; mails without a decision stay.
    """
    rejected = decisions.where(
        ~F.coalesce("is_itinerary", F.lit(False))
        & (F.coalesce("confidence", F.lit(0.0)) >= threshold)
    ).select(F.col("email_id").alias("__rejected"))
    return mail.join(rejected, F.col("id") == F.col("__rejected"), "left_anti")


def normalised_extractions(extractions: DataFrame) -> DataFrame:
    """External flight records with blank text as null."""
    cleaned = {c: blank_to_null(c) for c in FLIGHT_TEXT_FIELDS}
    return extractions.withColumns(cleaned)


def with_confidence(own: Column) -> Column:
    """A flight the rules found in the shape of an external record."""
    return F.struct(*[own[f].alias(f) for f in FLIGHT_TEXT_FIELDS], F.lit(None).cast("double").alias("confidence"))


def or_extraction(found: DataFrame, extractions: DataFrame) -> DataFrame:
    """Fill ``flight`` with the external record of the mail where the rules
    found none. The table holds one row per mail id."""
    fields = [F.col(f).alias(f) for f in FLIGHT_FIELDS]
    external = normalised_extractions(extractions).select(
        F.col("email_id").alias("__email"), F.struct(*fields).alias("__external")
    )
    either = F.when(F.col("flight").isNotNull(), with_confidence(F.col("flight"))).otherwise(F.col("__external"))
    return (
        found.join(external, F.col("id") == F.col("__email"), "left")
        .withColumn("flight", either)
        .drop("__email", "__external")
    )


def datable_extractions(found: DataFrame, extractions: DataFrame) -> DataFrame:
    """Of mails without a flight (``flight`` is null) those whose external record has a
    number and a departure, with that record as ``flight``; the others can enter no history."""
    usable = normalised_extractions(extractions).where(valid_flight())
    fields = [F.col(f).alias(f) for f in FLIGHT_FIELDS]
    external = usable.select(F.col("email_id").alias("__email"), F.struct(*fields).alias("flight"))
    return found.drop("flight").join(external, F.col("id") == F.col("__email")).drop("__email")


def flight_or_extraction(mail: DataFrame, extractions: DataFrame, keep=("seq", "id")) -> DataFrame:
    """The flight the rules find in each mail, else its external record.

    ``keep`` has to hold the id; bodies stay out of the join unless kept.
    """
    return or_extraction(flight(mail, keep=keep), extractions)


def airline_by_rules(
    mail: DataFrame, keyword_rules: DataFrame, key: str = "seq", inline_rules: int = INLINE_RULES
) -> DataFrame:
    """Airline by a rule table ``(priority, field, needle, airline)``.

    ``field`` is ``text`` or ``sender``. Of the rules whose needle is in the mail's field
    the first by priority, field, needle, airline wins (a null comes first). An empty
    needle is in every mail, a null one or another field in none. A small table is
    carried as one sorted array and searched in the row, without any join; a larger one
    is an index of needle starts, see :func:`_airline_by_index`. Both give the same.
    """
    keyword_rules = keyword_rules.where("field IN ('text', 'sender') AND needle IS NOT NULL")
    keyword_rules = keyword_rules.select("priority", "field", "needle", "airline")
    size = F.coalesce(F.sum(F.octet_length("needle") + F.coalesce(F.octet_length("airline"), F.lit(0))), F.lit(0))
    rows, total = keyword_rules.agg(F.count("*"), size).first()
    if rows > inline_rules or total > INLINE_CHARS:
        return _airline_by_index(mail, keyword_rules, key, min(FEW_NEEDLES, inline_rules))
    rule = F.struct("priority", "field", "needle", "airline")
    haystacks = with_haystacks(mail).withColumn("__rules", _rule_list(keyword_rules, rule))
    return haystacks.withColumn(
        "airline", F.coalesce(_first_rule()["airline"], F.lit(rules.UNKNOWN_AIRLINE))
    ).drop("__words", "__address", "__rules")


def _rule_list(keyword_rules: DataFrame, rule: Column) -> Column:
    """A small table of rules as one array, in the order of ``rule``."""
    return keyword_rules.agg(F.sort_array(F.collect_list(rule)).alias("rules")).scalar()


def _first_rule() -> Column:
    """The first of ``__rules`` whose needle is in the mail, null without one."""

    def applies(r: Column) -> Column:
        return F.when(r["field"] == "text", F.col("__words").contains(r["needle"])).otherwise(
            F.col("__address").contains(r["needle"])
        )

    return F.get(F.filter("__rules", applies), F.lit(0))


def needle_classes(keyword_rules: DataFrame) -> DataFrame:
    """Rules with ``cut``, the greatest power of two their needle is as long as, and
    ``piece``, that many of its first characters."""
    size = F.char_length("needle")
    cut = F.pow(F.lit(2), F.floor(F.log2(size + F.lit(0.5)))).cast("int")
    return keyword_rules.where(size > 0).withColumn("cut", cut).withColumn("piece", F.expr("substring(needle, 1, cut)"))


def _place(field: Column | str, piece: Column | str) -> Column:
    """Which bit of the filter a piece has."""
    return F.xxhash64(field, piece).bitwiseAND(F.lit(FILTER_BITS - 1))


def _piece_filter(lookup: DataFrame) -> Column:
    """One bit per possible hash of a piece, as an array of 64-bit words: its size is
    fixed, however many rules there are."""
    place = _place("field", "piece")
    word = lookup.select(F.shiftright(place, 6).alias("word"), place.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
    word = word.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    every = lookup.sparkSession.range(FILTER_BITS // 64).join(word, F.col("id") == F.col("word"), "left")
    listed = F.sort_array(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits"))))
    return every.agg(F.transform(listed, lambda w: w["bits"])).scalar()


def _pieces(source: str, cut: int) -> Column:
    """A text in pieces, as finding a character takes a walk to it. Each has what follows
    it as well, so that any ``2 * cut - 1`` characters lie in one."""
    step = max(64, 2 * cut)
    return F.regexp_extract_all(source, F.lit(rf"(?s)(?=(.{{1,{step + 2 * cut - 2}}})).{{1,{step}}}"), F.lit(1))


def _met(mail: DataFrame, key: str, field: str, cut: int, known: Column) -> DataFrame:
    """``key, field, cut, piece, run``: the places of a mail's field where the filter holds the next ``cut`` characters."""
    step = max(64, 2 * cut)
    starts = F.least(F.lit(step), F.char_length("part") - (cut - 1))
    parts = mail.select(key, F.explode(_pieces({"text": "__words", "sender": "__address"}[field], cut)).alias("part"))
    places = parts.where(starts >= 1).select(key, "part", F.explode(F.sequence(F.lit(1), starts)).alias("at"))
    rows = places.select(key, "part", "at", F.substring("part", F.col("at"), F.lit(cut)).alias("piece"))
    place = _place(F.lit(field), "piece")
    word = F.get(known, F.shiftright(place, 6).cast("int"))
    rows = rows.where(F.getbit(word, place.bitwiseAND(F.lit(63)).cast("int")) == 1)
    run = F.substring("part", F.col("at"), F.lit(2 * cut - 1)).alias("run")
    return rows.select(key, F.lit(field).alias("field"), F.lit(cut).alias("cut"), "piece", run)


def _airline_by_index(mail: DataFrame, keyword_rules: DataFrame, key: str, few: int) -> DataFrame:
    """The same answer for rule tables of any size.

    Of the rules of one field and needle only the first can win, so the others leave before
    anything is searched. Needles are in length classes, by their first 1, 2, 4, 8 ...
    characters. Those of a class of ``few`` at most are searched one by one in the row. For
    any other class, the places of a text where none of its needles starts are dropped by a
    bit filter of fixed size; what is left is a few rows per mail. They meet the index
    on equal pieces, are checked for the whole needle, and reduce to one rule per mail with
    a partial step. ``key`` has to be unique.
    """
    first = F.min(F.struct("priority", "airline")).alias("first")
    needles = keyword_rules.groupBy("field", "needle").agg(first).select("first.priority", "field", "needle", "first.airline")
    # numbered in the order in which they win
    needles = needles.orderBy("priority", "field", "needle").withColumn("number", F.monotonically_increasing_id())
    needles = as_table(needles.drop("priority"), "needles")
    lookup = needle_classes(needles)
    # one row per field and power of two
    classes = lookup.groupBy("field", "cut").agg(F.count("*").alias("n"), F.sum(F.octet_length("needle")).alias("size"))
    cuts = [(r.field, r.cut) for r in classes.orderBy("field", "cut").collect() if r.n > few or r.size > FEW_CHARS]
    large = F.lit(False)
    for field, cut in cuts:
        large |= (F.col("field") == field) & (F.col("cut") == cut)
    haystacks = with_haystacks(mail)
    listed = needles.where("needle = ''").unionByName(lookup.where(~large).drop("cut", "piece"))
    searched = haystacks.withColumn("__rules", _rule_list(listed, F.struct("number", "field", "needle", "airline")))
    if not cuts:
        found = F.coalesce(_first_rule()["airline"], F.lit(rules.UNKNOWN_AIRLINE))
        return searched.withColumn("airline", found).drop("__words", "__address", "__rules")
    lookup = lookup.where(large)
    known = _piece_filter(lookup)
    hits = searched.select(key, _first_rule()["number"].alias("number")).where("number IS NOT NULL")
    for field, cut in cuts:
        met = _met(haystacks, key, field, cut, known).join(lookup, ["field", "cut", "piece"])
        hits = hits.unionByName(met.where(F.col("run").startswith(F.col("needle"))).select(key, "number"))
    hits = hits.groupBy(key).agg(F.min("number").alias("number"))
    hits = hits.join(needles.select("number", F.col("airline").alias("__airline")), "number").select(key, "__airline")
    return (
        mail.join(hits, key, "left")
        .withColumn("airline", F.coalesce("__airline", F.lit(rules.UNKNOWN_AIRLINE)))
        .drop("__airline")
    )
