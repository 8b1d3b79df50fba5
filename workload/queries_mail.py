"""Checked queries: filters, extraction, scalars and counts over mail."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripmine import rules
from tripmine.functions import scalars
from tripmine.functions.airline import of_airline, with_airline
from tripmine.functions.booking import (
    has_flight_context,
    number_tokens,
    valid_code,
    valid_number,
    with_booking_details,
)
from tripmine.functions.prompts import prompt_chars
from tripmine.functions.text import evaluated, text
from tripmine.operators import cost, enrich, extract, filters, stats
from tripmine.plans import cost as cost_plans
from tripmine.plans import gate as gates
from tripmine.sinks.seen import SeenIds, id_key
from tripmine.workspace import fresh_path
from workload import tables as t
from workload.catalog import check


def _any(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


SUBJECT, SENDER, BODY = (f"lower(coalesce({c}, ''))" for c in ("subject", "sender", "body"))

# --- filters ---------------------------------------------------------------------


@check(
    "flt_date_range",
    """SELECT seq, id FROM mail
    WHERE sent_at > TIMESTAMP '1997-03-15' AND sent_at < TIMESTAMP '1997-03-15' + INTERVAL 200 DAY""",
)
def flt_date_range(spark, sf_dir):
    return t.mail(spark, sf_dir).where(filters.sent_between(1997, 200, "03-15")).select("seq", "id")


RFC = r"^(Mon|Tue|Wed|Thu|Fri|Sat|Sun), \d+ [A-Z][a-z]+ \d{4} \d+:\d+:\d+ [+-]\d{4}$"


@check(
    "flt_sample_range",
    f"""WITH dated AS (SELECT seq, id,
      CASE WHEN regexp_full_match(date, '{RFC[1:-1]}')
        THEN strptime(regexp_replace(date, '^\\w+, ', ''), '%d %b %Y %H:%M:%S %z') END AS sent FROM mail)
    SELECT seq, id FROM dated WHERE epoch_ms(sent) >= epoch_ms(TIMESTAMP '1998-02-01')
      AND epoch_ms(sent) <= epoch_ms(TIMESTAMP '1998-02-01' + INTERVAL 100 DAY)""",
)
def flt_sample_range(spark, sf_dir):
    return t.mail(spark, sf_dir).where(filters.dated_between(1998, 100, "02-01")).select("seq", "id")


STRICT = f"""({_any(SUBJECT, rules.SEARCH_STRICT_SUBJECT)} OR {_any(SENDER, rules.SEARCH_STRICT_SENDER)})"""
IN_1996 = "sent_at > TIMESTAMP '1996-01-01' AND sent_at < TIMESTAMP '1996-01-01' + INTERVAL 365 DAY"


@check("flt_search_strict", f"SELECT seq, id FROM mail WHERE {IN_1996} AND {STRICT}")
def flt_search_strict(spark, sf_dir):
    hits = filters.sent_between(1996) & filters.search_strict()
    return t.mail(spark, sf_dir).where(hits).select("seq", "id")


@check("flt_search_relaxed", f"SELECT seq, id FROM mail WHERE {IN_1996} AND label = 'INBOX'")
def flt_search_relaxed(spark, sf_dir):
    mail = t.mail(spark, sf_dir)
    return mail.where(filters.sent_between(1996) & filters.search_relaxed(mail)).select("seq", "id")


V2_SEARCH = f"""({_any(SENDER, rules.SEARCH_V2_SENDER)} OR {_any(SUBJECT, rules.SEARCH_V2_SUBJECT)})"""


@check(
    "flt_search_v2",
    f"SELECT seq, id FROM mail WHERE {IN_1996} AND {V2_SEARCH}",
)
def flt_search_v2(spark, sf_dir):
    return filters.search_tracker(t.mail(spark, sf_dir), 1996).select("seq", "id")


@check("flt_search_v2_first", f"SELECT seq, id FROM mail WHERE {IN_1996} AND {V2_SEARCH} ORDER BY seq LIMIT 100")
def flt_search_v2_first(spark, sf_dir):
    return filters.search_tracker(t.mail(spark, sf_dir), 1996, limit=100).select("seq", "id")


POTENTIAL = f"""(NOT {_any(SUBJECT, rules.POTENTIAL_EXCLUSIONS)} AND ({_any(SENDER, rules.POTENTIAL_DOMAINS)}
  OR {_any(SUBJECT, rules.POTENTIAL_INDICATORS)} OR regexp_matches(coalesce(subject, ''), '\\b[A-Z]{{2}}\\d{{3,4}}\\b')))"""


@check("flt_potential", f"SELECT seq, id FROM mail WHERE {POTENTIAL}")
def flt_potential(spark, sf_dir):
    return filters.potential(t.mail(spark, sf_dir)).select("seq", "id")


AIRLINES = ", ".join(f"'{c}'" for c in rules.BOOKING_AIRLINE_CODES)
#: Booking details in SQL: maximal runs of capitals and digits are the bounded tokens.
DETAILS = f"""tokens AS (
  SELECT *, concat(coalesce(subject, ''), chr(10), coalesce(body, '')) AS txt FROM mail),
runs AS (SELECT *, regexp_extract_all(txt, '[A-Z0-9]+') AS run FROM tokens),
found AS (SELECT *,
    list_filter(run, lambda x: length(x) = 6 AND regexp_matches(x, '[A-Z]') AND regexp_matches(x, '[0-9]')) AS codes,
    list_filter(run, lambda x: regexp_full_match(x, '[A-Z]{{2}}[0-9]{{3,4}}') AND substr(x, 1, 2) IN ({AIRLINES})) AS nums
  FROM runs),
judged AS (SELECT *, coalesce(len(list_filter(list_distinct(nums), lambda n: regexp_matches(txt,
      concat('(?i)(flight.{{0,50}}', n, '|', n, '.{{0,50}}flight)')))) > 0, FALSE) AS ctx FROM found),
scored AS (SELECT *, CAST(0 AS DOUBLE) + CASE WHEN len(codes) > 0 THEN 0.4e0 ELSE 0e0 END
    + CASE WHEN len(nums) > 0 THEN 0.4e0 ELSE 0e0 END + CASE WHEN ctx THEN 0.2e0 ELSE 0e0 END AS score FROM judged),
details AS (SELECT *, coalesce(codes[1], '') AS confirmation_code,
    array_to_string(nums, ', ') AS flight_numbers, least(1e0, score) AS confidence
  FROM scored WHERE score >= 0.6e0)"""


def _flat(df):
    d = F.col("booking_details")
    return df.select(
        "seq",
        "id",
        d["confirmation_code"].alias("confirmation_code"),
        scalars.joined(d["flight_numbers"]).alias("flight_numbers"),
        d["confidence"].alias("confidence"),
    )


FLAT = "seq, id, confirmation_code, flight_numbers, confidence"


@check("ext_booking_details", f"WITH {DETAILS} SELECT {FLAT} FROM details")
def ext_booking_details(spark, sf_dir):
    detailed = with_booking_details(t.mail(spark, sf_dir))
    return _flat(detailed.where(F.col("booking_details").isNotNull()))


@check("flt_booking_gate", f"WITH {DETAILS} SELECT {FLAT} FROM details WHERE confidence >= 0.8e0")
def flt_booking_gate(spark, sf_dir):
    return _flat(filters.booking_gate(with_booking_details(t.mail(spark, sf_dir)), 0.8))


@check("flt_second_gate", f"WITH {DETAILS} SELECT {FLAT} FROM details")
def flt_second_gate(spark, sf_dir):
    return _flat(filters.second_gate(with_booking_details(t.mail(spark, sf_dir))))


@check("ext_flight_context", f"WITH {DETAILS} SELECT seq, ctx AS has_context FROM judged")
def ext_flight_context(spark, sf_dir):
    full = t.mail(spark, sf_dir).select(
        "seq", F.concat(text("subject"), F.lit("\n"), text("body")).alias("txt")
    )
    numbers = full.withColumn("nums", number_tokens(F.col("txt")))
    return numbers.select(
        "seq",
        (
            (F.size("nums") > 0)
            & F.coalesce(has_flight_context(F.col("txt"), F.col("nums")), F.lit(False))
        ).alias("has_context"),
    )


@check("gate_v1", f"WITH {DETAILS} SELECT {FLAT} FROM details WHERE {POTENTIAL} AND id NOT IN (SELECT email_id FROM decisions)", "mail decisions")
def gate_v1(spark, sf_dir):
    processed = t.decisions(spark, sf_dir).select(F.col("email_id").alias("id"))
    return _flat(gates.gate(t.mail(spark, sf_dir), processed))


@check("gate_nested_v1", f"WITH {DETAILS} SELECT {FLAT} FROM details WHERE {POTENTIAL}")
def gate_nested_v1(spark, sf_dir):
    nested = gates.gate_nested(t.mail(spark, sf_dir).drop("labels"))
    return nested.select(
        "message.seq",
        "message.id",
        "booking_details.confirmation_code",
        scalars.joined(F.col("booking_details.flight_numbers")).alias("flight_numbers"),
        "confidence",
    )


@check(
    "flt_unprocessed",
    "SELECT seq, id FROM mail WHERE id NOT IN (SELECT email_id FROM decisions)",
    "mail decisions",
)
def flt_unprocessed(spark, sf_dir):
    processed = t.decisions(spark, sf_dir).select(F.col("email_id").alias("id"))
    return filters.unprocessed(t.mail(spark, sf_dir), processed).select("seq", "id")


KEPT = """NOT EXISTS (SELECT 1 FROM decisions x WHERE x.email_id = mail.id AND NOT x.is_itinerary
  AND coalesce(x.confidence, 0) >= 0.6e0)"""


@check("flt_remembered", "SELECT seq, id FROM mail WHERE id NOT IN (SELECT id FROM mail WHERE year(sent_at) < 1996)")
def flt_remembered(spark, sf_dir):
    """Two calls that share a table of remembered ids: what the second finds new."""
    mail = t.mail(spark, sf_dir)
    seen = SeenIds(spark, fresh_path(spark, "seen"))
    seen.add(mail.where("year(sent_at) < 1996").select(id_key("id")))
    return filters.unremembered(mail, seen).select("seq", "id")


@check("flt_itinerary_gate", f"SELECT seq, id FROM mail WHERE {KEPT}", "mail decisions")
def flt_itinerary_gate(spark, sf_dir):
    return enrich.itinerary_gate(t.mail(spark, sf_dir), t.decisions(spark, sf_dir)).select("seq", "id")


WORDS = """words AS (SELECT DISTINCT unnest(regexp_extract_all(concat(coalesce(subject, ''), ' ', coalesce(body, '')),
  '[^\\s,.;:()]+')) AS word FROM mail)"""


def _words(spark, sf_dir):
    content = F.concat(text("subject"), F.lit(" "), text("body"))
    words = F.regexp_extract_all(content, F.lit(r"[^\s,.;:()]+"), F.lit(0))
    return t.mail(spark, sf_dir).select(F.explode(words).alias("word")).distinct()


@check(
    "val_code",
    f"""WITH {WORDS} SELECT word, length(word) = 6 AND regexp_matches(word, '\\p{{L}}')
    AND regexp_matches(word, '\\p{{Nd}}') AND upper(word) = word AND lower(word) <> word AS is_valid FROM words""",
)
def val_code(spark, sf_dir):
    return _words(spark, sf_dir).withColumn("is_valid", valid_code(F.col("word")))


@check(
    "val_flight_number",
    f"""WITH {WORDS} SELECT word, regexp_full_match(word, '[A-Z]{{2}}\\d{{3,4}}')
    AND substr(word, 1, 2) IN ({AIRLINES}) AS is_valid FROM words""",
)
def val_flight_number(spark, sf_dir):
    return _words(spark, sf_dir).withColumn("is_valid", valid_number(F.col("word")))


# --- extraction --------------------------------------------------------------------

WORDS_OF_MAIL = "lower(concat(coalesce(subject, ''), ' ', coalesce(body, '')))"
AIRLINE = "CASE " + " ".join(
    [f"WHEN {_any(WORDS_OF_MAIL, keys)} THEN '{name}'" for name, keys in rules.AIRLINE_KEYWORDS]
    + [f"WHEN contains({SENDER}, '{d}') THEN '{name}'" for d, name in rules.AIRLINE_DOMAINS]
) + f" ELSE '{rules.UNKNOWN_AIRLINE}' END"


@check("ext_airline", f"SELECT seq, {AIRLINE} AS airline FROM mail")
def ext_airline(spark, sf_dir):
    return with_airline(t.mail(spark, sf_dir)).select("seq", "airline")


def _airline_rules(spark):
    words = [("text", w, a) for a, keys in rules.AIRLINE_KEYWORDS for w in keys]
    domains = [("sender", d, a) for d, a in rules.AIRLINE_DOMAINS]
    rows = [(i, *r) for i, r in enumerate(words + domains)]
    return spark.createDataFrame(rows, "priority int, field string, needle string, airline string")


@check("join_airline_rules", f"SELECT seq, {AIRLINE} AS airline FROM mail")
def join_airline_rules(spark, sf_dir):
    found = enrich.airline_by_rules(t.mail(spark, sf_dir), _airline_rules(spark))
    return found.select("seq", "airline")


@check(
    "join_airline_rules_large",
    f"""WITH words AS (SELECT seq, {WORDS_OF_MAIL} AS words, {SENDER} AS address FROM mail),
    hits AS (SELECT seq, priority, field, needle, airline FROM words JOIN airline_rules
      ON (field = 'text' AND contains(words, needle)) OR (field = 'sender' AND contains(address, needle))),
    first AS (SELECT seq, airline, row_number() OVER (PARTITION BY seq
      ORDER BY priority, field, needle, airline NULLS FIRST) AS rn FROM hits)
    SELECT mail.seq, coalesce(first.airline, '{rules.UNKNOWN_AIRLINE}') AS airline
    FROM mail LEFT JOIN first ON mail.seq = first.seq AND rn = 1""",
    "mail airline_rules",
)
def join_airline_rules_large(spark, sf_dir):
    found = enrich.airline_by_rules(t.mail(spark, sf_dir), t.airline_rules(spark, sf_dir))
    return found.select("seq", "airline")


TRUTH = """seq, t_number AS flight_number, t_date AS departure_datetime, '' AS arrival_datetime, t_dep AS departure_airport,
  t_arr AS arrival_airport, t_code AS confirmation_code, t_airline AS airline"""


@check(
    "ext_vietjet",
    f"SELECT {TRUTH} FROM mail WHERE kind IN (0, 8, 9, 10)",
)
def ext_vietjet(spark, sf_dir):
    mail = t.mail(spark, sf_dir).select("seq", "subject", "sender", "body")
    ours = of_airline(mail, rules.VIETJET)
    return extract.flights_only(extract.vietjet_flight(ours, keep=["seq"]))


@check(
    "ext_generic",
    f"SELECT {TRUTH} FROM mail WHERE t_number IS NOT NULL AND kind NOT IN (0, 8, 9, 10)",
)
def ext_generic(spark, sf_dir):
    mail = t.mail(spark, sf_dir)
    no_vietjet = ~text("subject").rlike("(?i)viet ?jet|vjet") | text("subject").contains("partner")
    others = mail.where(no_vietjet).select("seq", "subject", "sender", "body")
    return extract.flights_only(extract.generic_flight(others, keep=["seq"]))


@check("ext_flight", f"SELECT {TRUTH} FROM mail WHERE t_number IS NOT NULL")
def ext_flight(spark, sf_dir):
    mail = t.mail(spark, sf_dir).select("seq", "subject", "sender", "body")
    return extract.flights_only(extract.flight(mail, keep=["seq"]))


def _blank(column: str) -> str:
    return f"CASE WHEN regexp_full_match({column}, '[\\s\\x{{00a0}}]*') THEN NULL ELSE {column} END"


TEXTS = [
    "flight_number", "departure_datetime", "arrival_datetime", "departure_airport",
    "arrival_airport", "confirmation_code", "airline",
]
TRUTHS = ["t_number", "t_date", "''", "t_dep", "t_arr", "t_code", "t_airline"]
FALLBACK = f"""full_flights AS (SELECT mail.seq, mail.id,
  {", ".join(f"CASE WHEN t_number IS NOT NULL THEN {tr} ELSE {_blank('x.' + c)} END AS {c}" for tr, c in zip(TRUTHS, TEXTS))},
  CASE WHEN t_number IS NULL THEN x.confidence END AS confidence
  FROM mail LEFT JOIN extractions x ON x.email_id = mail.id
  WHERE t_number IS NOT NULL OR x.email_id IS NOT NULL)"""


@check(
    "ext_with_fallback",
    f"WITH {FALLBACK} SELECT seq, {', '.join(TEXTS)}, confidence FROM full_flights",
    "mail extractions",
)
def ext_with_fallback(spark, sf_dir):
    mail = t.mail(spark, sf_dir).select("seq", "id", "subject", "sender", "body")
    found = enrich.flight_or_extraction(mail, t.extractions(spark, sf_dir))
    return extract.flights_only(found).drop("id")


@check(
    "ext_blank_to_null",
    f"SELECT email_id, {', '.join(f'{_blank(c)} AS {c}' for c in TEXTS)}, confidence FROM extractions",
    "mail extractions",
)
def ext_blank_to_null(spark, sf_dir):
    return enrich.normalised_extractions(t.extractions(spark, sf_dir))


V2_CODE = r"(?i)(?:(?:confirmation|booking|reference|pnr|reservation)(?:\s+(?:code|number|#|no|id))?\s*[:# ]*)([A-Z0-9]{6})(?:[^\pL\pN_]|$)"
V2_NUMBER = r"(?:flight(?:\s+(?:number|#|no))?\s*[:# ]*)?([A-Z]{2})[\s\x{00a0}]*(\d{1,4})(?:\D|$)"


def v2_sql(source: str) -> str:
    """Tracker record over a relation with ``seq, id, thread_id, txt``."""
    return f"""v2a AS (SELECT *, nullif(regexp_extract(txt, '{V2_CODE}', 1), '') AS confirmation_code,
    nullif(regexp_extract(txt, '{V2_NUMBER}', 1), '') AS airline,
    nullif(concat(regexp_extract(txt, '{V2_NUMBER}', 1), regexp_extract(txt, '{V2_NUMBER}', 2)), '') AS flight_number,
    CAST(len(regexp_extract_all(txt, '(?i)flight|boarding|departure|arrival')) AS BIGINT) AS flight_context_count
  FROM {source}),
v2 AS (SELECT *, CASE WHEN confirmation_code IS NULL THEN 0e0 ELSE 0.4e0 END
    + CASE WHEN flight_number IS NULL THEN 0e0 ELSE 0.4e0 END
    + least(0.1e0 * flight_context_count, 0.2e0) AS confidence,
    confirmation_code IS NOT NULL AS has_confirmation_code, flight_number IS NOT NULL AS has_flight_number FROM v2a)"""


V2_OF_MAIL = (
    "src AS (SELECT *, concat(coalesce(subject, ''), chr(10), coalesce(body, '')) AS txt FROM mail), "
    + v2_sql("src")
)
V2_COLUMNS = """confirmation_code, flight_number, airline, confidence, has_confirmation_code,
  has_flight_number, flight_context_count"""


def _tracked(spark, sf_dir):
    mail = t.mail(spark, sf_dir).select("seq", "id", "subject", "body")
    full = F.concat(text("subject"), F.lit("\n"), text("body"))
    tracked = extract.tracked_flight(mail, full, ["seq", "id"])
    return tracked.withColumn("flight_context_count", F.col("flight_context_count").cast("bigint"))


@check("ext_v2", f"WITH {V2_OF_MAIL} SELECT seq, id, {V2_COLUMNS} FROM v2")
def ext_v2(spark, sf_dir):
    return _tracked(spark, sf_dir)


@check("flt_v2_gate", f"WITH {V2_OF_MAIL} SELECT seq, id, {V2_COLUMNS} FROM v2 WHERE confidence >= 0.4e0")
def flt_v2_gate(spark, sf_dir):
    return extract.tracker_gate(_tracked(spark, sf_dir))


def chars_sql(head: str, cap: int | None = None) -> str:
    body = f"least(length(coalesce(body, '')), {cap})" if cap else "length(coalesce(body, ''))"
    return f"""({len(head)} + length('Subject: From: Date: Body:') + 5 + length(coalesce(subject, ''))
      + length(coalesce(sender, '')) + length(coalesce(date, 'None')) + {body})"""


@check("ext_prompt_chars", f"SELECT seq, CAST({chars_sql(rules.COST_PROMPT_HEAD, 4000)} AS BIGINT) AS chars FROM mail")
def ext_prompt_chars(spark, sf_dir):
    chars = prompt_chars(max_body_chars=4000).cast("bigint")
    return t.mail(spark, sf_dir).select("seq", chars.alias("chars"))


@check("ext_token_estimate", "SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM documents", "")
def ext_token_estimate(spark, sf_dir):
    docs = t.given(spark, sf_dir, "documents")
    return docs.select("doc_id", scalars.token_estimate(F.col("text")).alias("tokens"))


def _prompt_sql(head: str, cap: int | None) -> str:
    body = f"substr(coalesce(body, ''), 1, {cap})" if cap else "coalesce(body, '')"
    head = head.replace("'", "''").replace("\n\n", "")
    return f"""concat('{head}', chr(10), chr(10), 'Subject: ', coalesce(subject, ''), chr(10), 'From: ',
      coalesce(sender, ''), chr(10), 'Date: ', coalesce(date, 'None'), chr(10), 'Body:', chr(10), {body}, chr(10))"""


@check(
    "ext_request_text",
    f"""SELECT id AS email_id, 'extraction' AS task, {_prompt_sql(rules.EXTRACTION_PROMPT_HEAD, None)} AS prompt FROM mail
    UNION ALL SELECT id, 'classification', {_prompt_sql(rules.CLASSIFICATION_PROMPT_HEAD, 4000)} FROM mail""",
)
def ext_request_text(spark, sf_dir):
    return cost.requests(t.mail(spark, sf_dir), {"extraction": None, "classification": 4000})


# --- scalars --------------------------------------------------------------------------


@check(
    "sc_rfc2822",
    f"""SELECT seq, CASE WHEN regexp_full_match(date, '{RFC[1:-1]}')
      THEN strftime(make_timestamp(epoch_us(strptime(regexp_replace(date, '^\\w+, ', ''), '%d %b %Y %H:%M:%S %z'))),
        '%Y-%m-%d %H:%M:%S') END AS sent FROM mail""",
)
def sc_rfc2822(spark, sf_dir):
    at = scalars.rfc2822(F.col("date"))
    return t.mail(spark, sf_dir).select("seq", F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("sent"))


EPOCH = "make_timestamp(try_cast(nullif(internal_date, '') AS BIGINT) * 1000)"


@check("sc_epoch_minute", f"SELECT seq, strftime({EPOCH}, '%Y-%m-%d %H:%M') AS minute FROM flights", "flights")
def sc_epoch_minute(spark, sf_dir):
    minute = scalars.epoch_minute(F.col("internal_date"))
    return t.flights(spark, sf_dir).select("seq", minute.alias("minute"))


MONTH = f"CASE WHEN try_cast(nullif(internal_date, '') AS BIGINT) <> 0 THEN strftime({EPOCH}, '%B') END"


@check("sc_month_name", f"SELECT seq, {MONTH} AS month FROM flights", "flights")
def sc_month_name(spark, sf_dir):
    month = scalars.month_name(F.col("internal_date"))
    return t.flights(spark, sf_dir).select("seq", month.alias("month"))


FILLED = " + ".join(f"CAST({c} IS NOT NULL AS INT)" for c in [*TEXTS, "confidence"])


@check("sc_filled_fields", f"SELECT seq, CAST({FILLED} AS BIGINT) AS filled FROM flights", "flights")
def sc_filled_fields(spark, sf_dir):
    filled = scalars.filled_fields().cast("bigint")
    return t.flights(spark, sf_dir).select("seq", filled.alias("filled"))


SHOWN = ", chr(10), ".join(
    f"'{label}: ', coalesce({c}, 'None')"
    for label, c in [
        ("Flight", "flight_number"), ("Airline", "airline"), ("From", "departure_airport"),
        ("To", "arrival_airport"), ("Departure", "departure_datetime"),
        ("Confirmation", "confirmation_code"),
    ]
)


@check("sc_flight_text", f"SELECT seq, concat({SHOWN}) AS shown FROM flights", "flights")
def sc_flight_text(spark, sf_dir):
    return t.flights(spark, sf_dir).select("seq", scalars.flight_text().alias("shown"))


COST = "CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 10 = 0 THEN -1e0 ELSE o_totalprice END"


@check(
    "sc_cost_text",
    f"""SELECT o_orderkey, CASE WHEN {COST} >= 0 THEN concat('$', format('{{:,.4f}}', {COST})) ELSE 'n/a' END AS cost
    FROM orders""",
    "",
)
def sc_cost_text(spark, sf_dir):
    return t.given(spark, sf_dir, "orders").select(
        "o_orderkey", scalars.cost_text(F.expr(COST)).alias("cost")
    )


@check(
    "sc_array_ops",
    """WITH runs AS (SELECT seq, regexp_extract_all(coalesce(body, ''), '[A-Z0-9]{3,}') AS run FROM mail)
    SELECT seq, coalesce(run[1], '') AS first_item, array_to_string(run, ', ') AS all_items FROM runs""",
)
def sc_array_ops(spark, sf_dir):
    run = F.regexp_extract_all(text("body"), F.lit("[A-Z0-9]{3,}"), F.lit(0))
    runs = evaluated(t.mail(spark, sf_dir).select("seq", run.alias("run")), ["seq", "run"])
    return runs.select(
        "seq",
        scalars.first_item(F.col("run")).alias("first_item"),
        scalars.joined(F.col("run")).alias("all_items"),
    )


# --- counts over mail ---------------------------------------------------------------


@check(
    "agg_funnel",
    f"""WITH {DETAILS} SELECT (SELECT count(*) FROM mail) AS total,
    (SELECT count(*) FROM mail WHERE {POTENTIAL}) AS potential,
    (SELECT count(*) FROM details WHERE {POTENTIAL}) AS confirmed""",
)
def agg_funnel(spark, sf_dir):
    return stats.funnel(t.mail(spark, sf_dir))


def cost_sql(label: str, cap: int | None, output: int, overhead: int, rates=(1.25, 10.0)) -> str:
    tokens = f"CAST(ceil({chars_sql(rules.COST_PROMPT_HEAD, cap)} / 4.0) AS BIGINT) + {overhead}"
    inp, out = rates
    return f"""SELECT '{label}' AS label, n AS email_count, i AS total_input_tokens, n * {output} AS total_output_tokens,
      i / 1e6 * {inp}e0 AS input_cost, n * {output} / 1e6 * {out}e0 AS output_cost,
      i / 1e6 * {inp}e0 + n * {output} / 1e6 * {out}e0 AS total_cost,
      CAST(i AS DOUBLE) / n AS avg_input_tokens, CAST(n * {output} AS DOUBLE) / n AS avg_output_tokens,
      (i / 1e6 * {inp}e0 + n * {output} / 1e6 * {out}e0) / n AS avg_cost, 'approx:4chars' AS tokenizer,
      CAST({cap or "NULL"} AS BIGINT) AS max_body_chars
    FROM (SELECT count(*) AS n, CAST(sum({tokens}) AS BIGINT) AS i FROM mail)"""


@check("agg_cost", f"SELECT * EXCLUDE (label) FROM ({cost_sql('', 2500, 10, 5)})")
def agg_cost(spark, sf_dir):
    return cost.estimate(
        t.mail(spark, sf_dir),
        input_rate=1.25,
        output_rate=10.0,
        output_tokens=10,
        overhead_tokens=5,
        max_body_chars=2500,
    )


BOTH = f"{cost_sql('Classification', 1000, 60, 200)} UNION ALL {cost_sql('Extraction', 4000, 300, 200)}"


@check("set_cost_by_task", BOTH)
def set_cost_by_task(spark, sf_dir):
    rates = {"input_rate": 1.25, "output_rate": 10.0}
    return cost.estimate_by_task(
        t.mail(spark, sf_dir),
        {
            "Classification": rates | {"max_body_chars": 1000, "output_tokens": 60},
            "Extraction": rates | {"max_body_chars": 4000, "output_tokens": 300},
        },
    )


WHOLE = f"{cost_sql('Classification', None, 60, 200)} UNION ALL {cost_sql('Extraction', None, 300, 200)}"


@check("cost_plan", f"SELECT * EXCLUDE (max_body_chars) FROM ({WHOLE})")
def cost_plan(spark, sf_dir):
    plan = cost_plans.cost_plan(t.mail(spark, sf_dir), input_rate=1.25, output_rate=10.0)
    return plan.drop("max_body_chars")  # null: whole bodies


@check(
    "agg_batch_meta",
    f"""SELECT CAST(year(sent_at) AS INT) AS year, {t.HALF} AS half, count(*) AS email_count
    FROM mail GROUP BY ALL""",
)
def agg_batch_meta(spark, sf_dir):
    mail = t.mail(spark, sf_dir)
    return stats.batch_counts(mail, F.year("sent_at").alias("year"), F.expr(t.HALF).alias("half"))
