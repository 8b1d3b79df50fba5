"""Row shapes of the tables and files the engine reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

STRING, LONG, DOUBLE = T.StringType(), T.LongType(), T.DoubleType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


#: One mail as it is stored. ``sender`` is called ``from`` in JSON files.
EMAIL_JSON = T.StructType(
    [T.StructField(name, STRING) for name in ("id", "subject", "from", "date", "body")]
)

#: One landed batch file: an envelope around an array of mails.
EMAIL_BATCH = _struct(
    metadata=_struct(fetch_date=STRING, year=T.IntegerType(), email_count=LONG),
    emails=T.ArrayType(EMAIL_JSON),
)

BODY = _struct(data=STRING)
HEADERS = T.ArrayType(_struct(name=STRING, value=STRING))

#: One message as the mail service delivers it.
RAW_MESSAGE = _struct(
    id=STRING,
    threadId=STRING,
    internalDate=STRING,
    snippet=STRING,
    payload=_struct(
        headers=HEADERS,
        mimeType=STRING,
        body=BODY,
        parts=T.ArrayType(_struct(mimeType=STRING, body=BODY)),
    ),
)

FLIGHT_TEXT_FIELDS = [
    "flight_number",
    "departure_datetime",
    "arrival_datetime",
    "departure_airport",
    "arrival_airport",
    "confirmation_code",
    "airline",
]

#: Flight record; ``confidence`` is set by external extraction only.
FLIGHT_FIELDS = FLIGHT_TEXT_FIELDS + ["confidence"]

DECISION = _struct(
    email_id=STRING, is_itinerary=T.BooleanType(), confidence=DOUBLE, reason=STRING
)

#: Second-generation flight record as stored in result files.
TRACKED_FLIGHT = T.StructType(
    [
        T.StructField("id", STRING),
        T.StructField("threadId", STRING),
        T.StructField("date", STRING),
        T.StructField("subject", STRING),
        T.StructField("from", STRING),
        T.StructField("confidence", DOUBLE),
        T.StructField("confirmationCode", STRING),
        T.StructField("flightNumber", STRING),
        T.StructField("airline", STRING),
        T.StructField("departure_airport", STRING),
        T.StructField("arrival_airport", STRING),
    ]
)
RESULT_FILE = _struct(flights=T.ArrayType(TRACKED_FLIGHT))

CSV_COLUMNS = [
    "flight_number",
    "airline",
    "departure_airport",
    "arrival_airport",
    "departure_datetime",
    "arrival_datetime",
    "duration",
]
