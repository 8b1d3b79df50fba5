"""Writers for flight results and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripmine.functions.scalars import epoch_minute
from tripmine.operators.stats import all_statistics, with_month
from tripmine.schemas import CSV_COLUMNS


def save_flights(
    flights: DataFrame, path: str, email_count: int, year: int | None = None
) -> DataFrame:
    """Write flights and a one-row metadata table; returns the metadata.

    The flight count is read from the written files, so the flights are
    computed once. Without any flight no metadata row is written, and readers
    of the metadata see no result.
    """
    spark = flights.sparkSession
    flights.write.parquet(f"{path}/flights")
    written = spark.read.schema(flights.schema).parquet(f"{path}/flights")
    metadata = written.agg(F.count("*").alias("flight_count")).select(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("process_date"),
        F.lit(year).cast("int").alias("year"),
        F.lit(email_count).cast("bigint").alias("email_count"),
        "flight_count",
    )
    metadata.where("flight_count > 0").write.parquet(f"{path}/metadata")
    return spark.read.schema(metadata.schema).parquet(f"{path}/metadata")


def save_tracked(flights: DataFrame, path: str, seq: str = "seq") -> None:
    """Write second-generation flights with the month each belongs to, one partition
    per month, then their statistics in one pass over the files."""
    placed = with_month(flights)
    # a month's rows are merged or split to files of the advisory size
    placed.hint("rebalance", F.col("month")).write.partitionBy("month").parquet(f"{path}/flights")
    written = flights.sparkSession.read.schema(placed.schema).parquet(f"{path}/flights")
    all_statistics(written, seq=seq).coalesce(1).write.parquet(f"{path}/statistics")


def load_tracked(spark: SparkSession, path: str, month: str | None = None) -> DataFrame:
    """Stored flights of all months, or the members of one: other months are not read."""
    flights = spark.read.parquet(f"{path}/flights")
    return flights if month is None else flights.where(F.col("month") == month)


def load_statistics(spark: SparkSession, path: str) -> DataFrame:
    """The statistics stored with flights; see :func:`tripmine.operators.stats.all_statistics`."""
    return spark.read.parquet(f"{path}/statistics")


def csv_rows(flights: DataFrame) -> DataFrame:
    """The seven export columns; what a flight lacks is empty text."""
    given = {"flight_number": "flightNumber", "airline": "airline"}
    given |= {c: c for c in ("departure_airport", "arrival_airport")}
    values = {c: F.col(s) for c, s in given.items() if s in flights.columns}
    values["departure_datetime"] = epoch_minute(F.col("date"))
    return flights.select(
        *[F.coalesce(values.get(c, F.lit("")), F.lit("")).alias(c) for c in CSV_COLUMNS]
    )


def save_csv(flights: DataFrame, path: str) -> None:
    csv_rows(flights).write.option("header", True).option("emptyValue", "").csv(path)


def listing_line() -> Column:
    """One list item with the fields a flight has."""
    fields = [
        ("Flight: ", F.col("flightNumber")),
        ("Airline: ", F.col("airline")),
        ("Confirmation: ", F.col("confirmationCode")),
        ("Date: ", epoch_minute(F.col("date"))),
    ]
    # concat is null for a null field, and concat_ws leaves nulls out.
    shown = [F.concat(F.lit(label), value) for label, value in fields]
    return F.concat(F.lit("- "), F.concat_ws(" | ", *shown))


def save_listing(flights: DataFrame, path: str) -> None:
    """Write the list items in flight order; headings are the reader's."""
    flights.orderBy("seq").select(listing_line().alias("value")).write.text(path)
