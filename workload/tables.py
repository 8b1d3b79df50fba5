"""Mail, message and flight tables derived from the given tables.

The given tables hold no travel mail, so mail is derived: one mail per order,
in 32 forms that cover every rule, and one per document and conversation turn
as long free text. The same SQL runs in Spark and in DuckDB; columns after
``label`` are the expected extraction results and are never landed for Spark.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripmine.workspace import fresh_path

NBSP = "\u00a0"


@dataclass(frozen=True)
class Form:
    """Templates of one mail form and of the flight it should yield."""

    subject: str
    sender: str
    body: str | None
    airline: str | None = None
    number: str | None = None
    code: str = ""
    date: str = ""
    pair: tuple[str, str] = ("{dep}", "{arr}")


X = "x@example.com"
TRIP = "Trip notice"

FORMS = [
    Form("VietJet reservation {code} received", "tickets@vietjetair.com",
         "Reservation {code}\nFlight Number VJ {num}\nDeparture: {dep} Arrival: {arr}\nDate: {dtext}\n",
         "VietJet Air", "VJ{num}", "{code}", "{dtext}"),
    Form("Flight booked", "desk@example.com",
         "Flight: AA {num}\nDeparture: {dep} Arrival: {arr}\nBooking code: {code}\n",
         "Unknown Airline", "AA{num}", "{code}"),
    Form("LATAM: vuelo reservado", "ventas@latam.com",
         "Vuelo LA {num}\nSalida: Ciudad ({dep}) Llegada: Puerto ({arr})\nReserva: {code}\n",
         "LATAM Airlines", "LA{num}", "{code}"),
    Form("GOL: bilhete emitido", "avisos@voegol.com.br",
         "Numero do voo: G3 {num}\nDesde Porto ({dep}) para Cidade ({arr})\nReferencia: {code}\n",
         "GOL", "G3{num}", "{code}"),
    Form("Your hotel booking confirmation", "stay@booking.com", "Two nights, ref {code}\n"),
    Form("Weekly offers", "news@example.com", "Save on bags this week\n"),
    Form("Check-in open VN{num}", "info@vietnamairlines.com",
         "Your flight VN{num} is open. Code {code}\n"),
    Form("Booking confirmation", "desk@example.com", "Itinerary {code}\n"),
    Form("VietJet Air trip", "noreply@vietjetair.com",
         "Booking number {code}\nSeat VJ {num}\n{dep} -> {arr}\nOn {dtext}\n",
         "VietJet Air", "VJ{num}", "{code}", "{dtext}"),
    Form("vjet air notice", X, "Ref {code}\nVJ{num} {dep} 10:00 {arr}\n{dslash}\n",
         "VietJet Air", "VJ{num}", "", "{dslash}"),
    Form("VietJet update", X,
         "Reservation {code}\nFlight Number VJ {num}\nFrom: {depl} To: {arrl}\nDeparture: {dtext}\n",
         "VietJet Air", "VJ{num}", "{code}", "{dtext}", ("{depl}", "{arrl}")),
    Form("VietJet partner", X,
         "Flight: 5J {num2}\nFrom: {dep} To: {arr}\nConfirmation Code: {code}\n",
         "VietJet Air", "5J{num2}", "{code}"),
    Form(TRIP, X, "Flight 12 345\nSeat AZ {num} to gate\nFrom: {dep} To: {arr}\n",
         "Unknown Airline", "AZ{num}"),
    Form(TRIP, X, "Flight # BA {num}\n({dep}) hasta ({arr})\nPNR: {code}\n",
         "Unknown Airline", "BA{num}", "{code}"),
    Form(TRIP, X, "Flight KL {num}\nFrom: {dep} To: {dep}\n{dep} - {arr}\n",
         "Unknown Airline", "KL{num}"),
    Form(TRIP, X, "Flight KL {num}\nFrom: {dep} To: {dep}\n"),
    Form("Bilhete", X, "Voo: G3 {num}\nOrigem: Cidade ({dep}) Destino: Porto ({arr})\nRef # {code}\n",
         "Unknown Airline", "G3{num}", "{code}"),
    Form("Flight change", X,
         f"Flight:{NBSP}AA{NBSP}{{num}}\nFrom: {{dep}} To: {{arr}}\nReference: {{code}}\n",
         "Unknown Airline", f"AA{NBSP}{{num}}", "{code}"),
    Form("Boarding pass", X, "Seat VN1{num}\n"),
    Form("Boarding pass", X, "Seat VN{num}\n"),
    Form("Your e-ticket", X, "Flight VN{num}\n"),
    Form("Booking confirmation", X, "Ref {code} seat VJ{num}\n"),
    Form("Boarding pass", X, "Seat VN{num}\nThe flight desk\n"),
    Form("Flight receipt", X, "Your flight VN{num} then SQ{num}, ref {code}, also ZZ{num}\n"),
    Form("Flight AA {num} from {dep} to {arr}", "x@aa.com", None,
         "American Airlines", "AA{num}"),
    Form("Check-in reminder", X,
         "VN{num} is ready. " + "x" * 60 + " flight\nAsk for vn{num} on this flight\nCode {code}\n"),
    Form("Hotel near the airport", "x@united.com", "Your flight VN{num}, ref {code}\n"),
    Form("Receipt", "x@delta.com", "Your flight MH{num}, ref {code}\n"),
    Form("AA{num} update", X, "ref {code}\n"),
    Form("Gate change", X, "AB 12345 then CD 12 ref\nbooking {code} departure\n"),
    Form("LATAM AIRLINES vuelo", X,
         "VUELO LA {num}\nDESDE {dep} HASTA {arr}\nLOCALIZADOR {code}\n",
         "LATAM Airlines", "LA{num}", "{code}"),
    Form("Aviso", "x@o.delta.com",
         "Vuelo DL {num}\nSalida: {dep} llegada: {arr}\nReservacion # {code}\n",
         "Delta Air Lines", "DL{num}", "{code}"),
]


def _concat(template: str | None) -> str:
    """A template as an SQL concatenation both engines run."""
    if template is None:
        return "CAST(NULL AS STRING)"
    pieces = []
    for piece in re.split(rf"(\{{\w+\}}|\n|{NBSP})", template):
        if piece == "\n":
            pieces.append("chr(10)")
        elif piece == NBSP:
            pieces.append("chr(160)")
        elif piece.startswith("{"):
            pieces.append(piece[1:-1])
        elif piece:
            pieces.append("'" + piece.replace("'", "''") + "'")
    return f"concat({', '.join(pieces)})" if pieces else "''"


def _case(values: list[str]) -> str:
    arms = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))
    return f"CASE kind {arms} END"


def _names(column: str, names: str) -> str:
    arms = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names.split(), 1))
    return f"CASE {column} {arms} END"


MONTHS = "January February March April May June July August September October November December"
DAYS = "Mon Tue Wed Thu Fri Sat Sun"


def mail_sql(dialect: str) -> str:
    """The mail table as one query, for ``spark`` or ``duckdb``."""
    if dialect == "spark":
        day = "CAST(date_add(DATE '1995-01-01', CAST({} % 2400 AS INT)) AS TIMESTAMP_NTZ)"
    else:
        day = "CAST(DATE '1995-01-01' + CAST({} % 2400 AS INT) AS TIMESTAMP)"
    truth = {
        "t_airline": [f"'{f.airline}'" if f.airline else "NULL" for f in FORMS],
        "t_number": [_concat(f.number) for f in FORMS],
        "t_dep": [_concat(f.pair[0] if f.number else None) for f in FORMS],
        "t_arr": [_concat(f.pair[1] if f.number else None) for f in FORMS],
        "t_code": [_concat(f.code if f.number else None) for f in FORMS],
        "t_date": [_concat(f.date if f.number else None) for f in FORMS],
    }
    expected = ",\n  ".join(f"{_case(v)} AS {name}" for name, v in truth.items())
    nothing = ", ".join(f"NULL AS {name}" for name in truth)
    return f"""
SELECT k AS seq, concat('m', CAST(k AS STRING)) AS id, concat('t', CAST(c AS STRING)) AS thread_id,
  d AS sent_at,
  {_case([_concat(f.subject) for f in FORMS])} AS subject,
  {_case([_concat(f.sender) for f in FORMS])} AS sender,
  CASE WHEN k % 13 = 0 THEN NULL WHEN k % 11 = 0 THEN 'last week' ELSE concat(
    {_names("k % 7 + 1", DAYS)}, ', ', CAST(day(d) AS STRING), ' ', substr(month_name, 1, 3), ' ',
    CAST(year(d) AS STRING), ' ', lpad(CAST(k % 24 AS STRING), 2, '0'), ':',
    lpad(CAST(k % 60 AS STRING), 2, '0'), ':', lpad(CAST(k % 59 AS STRING), 2, '0'), ' ',
    CASE k % 3 WHEN 0 THEN '+0000' WHEN 1 THEN '+0700' ELSE '-0530' END) END AS date,
  {_case([_concat(f.body) for f in FORMS])} AS body,
  CASE WHEN k % 5 = 0 THEN 'SENT' ELSE 'INBOX' END AS label,
  kind, code,
  {expected}
FROM (
  SELECT *, concat(CAST(day(d) AS STRING), ' ', month_name, ' ', CAST(year(d) AS STRING)) AS dtext,
    lower(dep) AS depl, lower(arr) AS arrl, substr(num, 1, 2) AS num2
  FROM (
    SELECT o_orderkey AS k, o_custkey AS c, o_orderdate AS d, CAST(o_orderkey % {len(FORMS)} AS INT) AS kind,
      concat(substr('BCDFGHJKLM', CAST(o_orderkey % 10 AS INT) + 1, 1),
        lpad(CAST(o_orderkey % 100000 AS STRING), 5, '0')) AS code,
      CAST(100 + o_custkey % 900 AS STRING) AS num,
      substr('SGNHANJFKLAXGRUFORGIGSSA', CAST(o_custkey % 8 AS INT) * 3 + 1, 3) AS dep,
      substr('SGNHANJFKLAXGRUFORGIGSSA', CAST((o_custkey + 1 + o_orderkey % 3) % 8 AS INT) * 3 + 1, 3) AS arr,
      {_names("month(o_orderdate)", MONTHS)} AS month_name,
      concat(lpad(CAST(day(o_orderdate) AS STRING), 2, '0'), '/',
        lpad(CAST(month(o_orderdate) AS STRING), 2, '0'), '/', CAST(year(o_orderdate) AS STRING)) AS dslash
    FROM orders) b0) b
UNION ALL
SELECT 1000000000000 + doc_id, concat('d', CAST(doc_id AS STRING)), concat('d', lang),
  {day.format("doc_id")}, concat('Note from ', source), concat(source, '@example.com'), NULL, text, 'INBOX',
  -1, NULL, {nothing}
FROM documents
UNION ALL
SELECT 2000000000000 + conv_id * 100 + turn, concat('c', CAST(conv_id * 100 + turn AS STRING)),
  concat('c', CAST(conv_id AS STRING)), {day.format("conv_id")}, concat('Re: chat ', role),
  concat(role, '@example.com'), NULL, text, 'INBOX', -2, NULL, {nothing}
FROM conversations"""


MAIL_COLUMNS = [
    "seq", "id", "thread_id", "sent_at", "subject", "sender", "date", "body", "label",
]

#: Flights with few distinct keys: duplicates, ties, nulls and blanks all occur.
FLIGHTS_SQL = """
SELECT o_orderkey AS seq,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE concat('VJ', CAST(100 + o_custkey % 5 AS STRING)) END AS flight_number,
  CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE concat(substr(CAST(o_orderdate AS STRING), 1, 7), '-01T',
    lpad(CAST(o_orderkey % 24 AS STRING), 2, '0'), ':00') END AS departure_datetime,
  CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE '' END AS arrival_datetime,
  CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE substr('SGNHANJFK', CAST(o_custkey % 3 AS INT) * 3 + 1, 3) END AS departure_airport,
  CASE WHEN o_custkey % 12 = 0 THEN '' ELSE 'LAX' END AS arrival_airport,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat('C', lpad(CAST(o_orderkey % 100000 AS STRING), 5, '0')) END AS confirmation_code,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'VietJet Air' END AS airline,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderkey % 10 AS DOUBLE) / CAST(10 AS DOUBLE) END AS confidence,
  CASE WHEN o_custkey % 19 = 0 THEN NULL ELSE concat('m', CAST(o_custkey AS STRING)) END AS id,
  concat('t', CAST(o_orderkey % 3 AS STRING)) AS thread_id,
  CASE o_orderkey % 23 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '0' WHEN 3 THEN 'soon'
    ELSE CAST(788918400000 + o_orderkey * 60000 * 300 + o_custkey AS STRING) END AS internal_date
FROM orders"""

DECISIONS_SQL = """
SELECT id AS email_id, seq % 2 = 0 AS is_itinerary,
  CASE seq % 5 WHEN 0 THEN NULL WHEN 1 THEN 0.3e0 WHEN 2 THEN 0.6e0 WHEN 3 THEN 0.9e0 ELSE 0.59e0 END AS confidence,
  CASE WHEN seq % 4 = 0 THEN ' ' ELSE 'by content' END AS reason
FROM mail WHERE seq % 3 <> 0"""

EXTRACTIONS_SQL = """
SELECT id AS email_id,
  CASE seq % 7 WHEN 0 THEN '  ' WHEN 1 THEN NULL ELSE concat('XX', CAST(seq % 1000 AS STRING)) END AS flight_number,
  CASE WHEN seq % 9 = 0 THEN '' ELSE concat('2024-0', CAST(1 + seq % 9 AS STRING), '-10T10:00') END AS departure_datetime,
  '' AS arrival_datetime,
  CASE WHEN seq % 5 = 0 THEN chr(9) ELSE 'MEX' END AS departure_airport,
  CASE WHEN seq % 6 = 0 THEN NULL ELSE 'BOG' END AS arrival_airport,
  concat(' P', CAST(seq % 10 AS STRING), ' ') AS confirmation_code,
  CASE WHEN seq % 2 = 0 THEN chr(160) ELSE 'Avianca' END AS airline,
  CASE WHEN seq % 3 = 0 THEN NULL ELSE 0.7e0 END AS confidence
FROM mail WHERE seq % 4 <> 0"""

#: A rule per booking code, many of one priority, and needles of two letters to a phrase.
AIRLINE_RULES_SQL = """
SELECT CAST(o_orderkey % 3 AS INT) AS priority, 'text' AS field,
  lower(concat(substr('BCDFGHJKLM', CAST(o_orderkey % 10 AS INT) + 1, 1), lpad(CAST(o_orderkey % 100000 AS STRING), 5, '0'))) AS needle,
  concat('Carrier ', CAST(o_custkey % 50 AS STRING)) AS airline FROM orders
UNION ALL SELECT 1, 'text', 'vn', 'Two Letters'
UNION ALL SELECT 1, 'sender', 'united.com', 'By Domain'
UNION ALL SELECT 1, 'sender', 'a', NULL
UNION ALL SELECT 2, 'text', 'your flight ', 'By Phrase'
UNION ALL SELECT 2, 'text', 'z', 'One Letter'
UNION ALL SELECT 3, 'sender', 'united.com', 'Later'
UNION ALL SELECT 0, 'body', 'e', 'No Field'
UNION ALL SELECT 0, 'text', NULL, 'No Needle'"""

HALF = "CASE WHEN month(sent_at) <= 6 THEN 'a' ELSE 'b' END"
CHUNK = 10_000

_landed: dict[tuple[str, str, str], str] = {}


def landed(spark: SparkSession, sf_dir: str, name: str, write) -> str:
    """Path of a derived input, written once per application and data set."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _landed:
        path = fresh_path(spark, name)
        write(path)
        _landed[key] = path
    return _landed[key]


def _spread(spark: SparkSession) -> int:
    return 4 * spark.sparkContext.defaultParallelism


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread_out(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """``rows`` as they are read where tasks share them evenly, else spread over all cores.

    Rows are counted from the files' footers. A table of one small file, or of one row
    group, is a single task's; larger ones are not shuffled.
    """
    per_task = rows.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"))
    most, total = per_task.agg(F.max("n"), F.sum("n")).first()
    if most is None or most * spark.sparkContext.defaultParallelism <= 2 * total:
        return rows
    return rows.repartition(_spread(spark))


def _derived(spark: SparkSession, sf_dir: str, query: str, **views: DataFrame) -> DataFrame:
    """Run a query with the given tables it names as sub-queries."""
    frames = dict(views)
    for name in ("orders", "documents", "conversations"):
        if re.search(rf"FROM {name}\b", query):
            frames[name] = _spread_out(spark, given(spark, sf_dir, name))
    query = re.sub(r"FROM (\w+)\b", lambda m: f"FROM {{{m[1]}}}" if m[1] in frames else m[0], query)
    return spark.sql(query, **frames)


def mail_folder(spark: SparkSession, sf_dir: str) -> str:
    """Folder of landed mail, written as it is derived: no mail is shuffled or sorted."""

    def write(path: str) -> None:
        df = _derived(spark, sf_dir, mail_sql("spark")).select(*MAIL_COLUMNS)
        df.withColumn("labels", F.array("label", F.lit("TRAVEL"))).drop("label").write.parquet(path)

    return landed(spark, sf_dir, "mail", write)


def mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(mail_folder(spark, sf_dir))


def airline_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, AIRLINE_RULES_SQL)


def flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    def write(path: str) -> None:
        _derived(spark, sf_dir, FLIGHTS_SQL).repartition(_spread(spark)).write.parquet(path)

    return spark.read.parquet(landed(spark, sf_dir, "flights", write))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from_mail(spark, sf_dir, "decisions", DECISIONS_SQL)


def extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from_mail(spark, sf_dir, "extractions", EXTRACTIONS_SQL)


def _from_mail(spark: SparkSession, sf_dir: str, name: str, query: str) -> DataFrame:
    def write(path: str) -> None:
        _derived(spark, sf_dir, query, mail=mail(spark, sf_dir)).write.parquet(path)

    return spark.read.parquet(landed(spark, sf_dir, name, write))


def _encoded(content: Column) -> Column:
    return F.translate(F.base64(F.encode(content, "UTF-8")), "+/", "-_")


def raw_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mail in the shape the mail service delivers, ten variants by ``seq``."""

    def write(path: str) -> None:
        form = F.col("seq") % 10
        subject, sender = F.coalesce("subject", F.lit("")), F.coalesce("sender", F.lit(""))
        content = F.coalesce("body", F.lit(""))

        def header(name: str, value: Column) -> Column:
            return F.struct(F.lit(name).alias("name"), value.alias("value"))

        def part(kind: str, data: Column) -> Column:
            body = F.struct(data.alias("data"))
            return F.struct(F.lit(kind).alias("mimeType"), body.alias("body"))

        normal = [header("Subject", subject), header("FROM", sender), header("Date", F.col("date"))]
        headers = (
            F.when(form == 6, F.array(header("To", sender)))
            .when(form == 7, F.array(*normal, header("SUBJECT", F.lit("Second subject"))))
            .otherwise(F.array(*normal))
        )
        html = part("text/html", _encoded(F.concat(F.lit("<p>"), content)))
        plain = part("text/plain", _encoded(content))
        parts = (
            F.when(form == 1, F.array(html, plain))
            .when(form == 2, F.array(plain, part("text/plain", _encoded(F.lit("other")))))
            .when(form == 3, F.array(html))
        )
        data = F.when(form == 5, F.lit("%%%%")).when(form == 8, "").when(
            ~form.isin(1, 2, 3, 4), _encoded(content)
        )
        mail(spark, sf_dir).select(
            "seq",
            "id",
            F.col("thread_id").alias("threadId"),
            F.unix_millis(F.col("sent_at").cast("timestamp")).cast("string").alias("internalDate"),
            content.alias("snippet"),
            F.struct(
                headers.alias("headers"),
                F.when(parts.isNull(), "text/plain").otherwise("multipart/mixed").alias("mimeType"),
                F.struct(data.alias("data")).alias("body"),
                parts.alias("parts"),
            ).alias("payload"),
        ).write.parquet(path)

    return spark.read.parquet(landed(spark, sf_dir, "raw_messages", write))


def _envelope_files(rows: DataFrame, path: str, order: str, items: str, *extra: Column) -> None:
    """Write envelopes of at most ``CHUNK`` neighbours in ``seq``, one per file."""
    chunk = F.lpad(F.floor(F.col("seq") / CHUNK).cast("string"), 12, "0")
    fields = [c for c in rows.columns if c != order]
    item = F.struct(order, F.struct(*fields).alias("item"))
    listed = F.transform(F.sort_array(F.collect_list(item)), lambda r: r["item"])
    (
        rows.groupBy(chunk.alias("chunk"))
        .agg(*extra, listed.alias(items))
        .write.partitionBy("chunk")
        .option("maxRecordsPerFile", 1)
        .json(path)
    )


def email_batches(spark: SparkSession, sf_dir: str) -> str:
    """Folder of batch files: two per year, and a broken one."""

    def write(folder: str) -> None:
        rows = mail(spark, sf_dir).withColumns({"year": F.year("sent_at"), "half": F.expr(HALF)})
        batches = rows.select("year", "half").distinct().orderBy("year", "half").collect()
        for year, half in batches:
            batch = rows.where((F.col("year") == year) & (F.col("half") == half)).select(
                "seq", "id", "subject", F.col("sender").alias("from"), "date", "body"
            )
            metadata = F.struct(
                F.lit(f"{year + 1}-01-01T00:00:00").alias("fetch_date"),
                F.lit(year).alias("year"),
                F.count("*").alias("email_count"),
            )
            _envelope_files(
                batch, f"{folder}/emails_{year}_{half}.json", "seq", "emails",
                metadata.alias("metadata"),
            )
        broken = spark.range(1).select(F.lit('{"metadata": {"year": 1990}, "emails": [{').alias("value"))
        broken.write.text(f"{folder}/emails_{batches[0]['year']}_broken.json")

    return landed(spark, sf_dir, "batches", write)
