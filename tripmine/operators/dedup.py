"""Duplicate removal and ordering of flights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tripmine.functions.scalars import day_key, filled_fields
from tripmine.schemas import FLIGHT_FIELDS
from tripmine.workspace import as_table


def valid_flight() -> Column:
    """Flight number and departure are both filled. For use in a filter, where
    null drops a row like false does, and where it can reach the scan."""
    return (F.col("flight_number") != "") & (F.col("departure_datetime") != "")


def best_record(flights: DataFrame, seq: str = "seq") -> DataFrame:
    """One flight per number, departure day and airports: the one with the most
    filled fields, the earliest among equals. Adds ``first_seq``, where the
    key was seen first.

    An arg-min aggregate: every task reduces its rows to one per key before
    the shuffle, so a key that holds a third of all rows costs one row per task.
    """
    key = ["flight_number", "departure_airport", "arrival_airport"]
    by_day = flights.where(valid_flight()).withColumn("__day", day_key(F.col("departure_datetime")))
    fields = [c for c in FLIGHT_FIELDS if c in flights.columns]
    rank = F.struct(-filled_fields(fields), F.col(seq))
    best = _arg_min(by_day, [*key, "__day"], rank, F.min(seq).alias("first_seq"))
    return best.drop("__day")


def first_record(flights: DataFrame, keys=("id", "thread_id"), seq: str = "seq") -> DataFrame:
    """The earliest row of every (id, thread) pair."""
    return _arg_min(flights, list(keys), F.col(seq))


def _arg_min(df: DataFrame, key: list[str], rank: Column, *extra: Column) -> DataFrame:
    """The row of least ``rank`` per key. Key columns are not carried twice."""
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.min_by(F.struct(*rest), rank).alias("__best"), *extra)
    fields = [F.col(c) if c in key else F.col("__best")[c].alias(c) for c in df.columns]
    return best.select(*fields, *[c for c in best.columns if c not in (*key, "__best")])


def by_departure(flights: DataFrame) -> list[Column]:
    """Sort order of a travel history: departure text, then first appearance."""
    return [F.coalesce("departure_datetime", F.lit("")), F.col("first_seq")]


def numbered(df: DataFrame, *order: Column, name: str = "pos") -> DataFrame:
    """Sort ``df`` and number its rows from 1, without one task seeing all rows.

    The range sort numbers rows inside each partition; the row counts of the
    partitions (one small row each) then give every partition its offset. The
    sorted rows are written once in between, so both uses see the same split.
    """
    sorted_ = as_table(
        df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), "sorted"
    )
    part = F.shiftrightunsigned("__at", 33)
    sizes = sorted_.groupBy(part.alias("__part")).agg(F.count("*").alias("__rows"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "__part", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__offset")
    )
    inside = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    # One row per sort partition: bounded by the shuffle width.
    return (
        sorted_.withColumn("__part", part)
        .join(F.broadcast(offsets), "__part")
        .withColumn(name, F.col("__offset") + inside + 1)
        .drop("__part", "__offset", "__at")
    )
