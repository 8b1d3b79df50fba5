"""Rows of given ids, without moving large rows where the ids are few."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tables up to this many rows and bytes are broadcast; larger ones are joined by a shuffle.
BROADCAST_IDS, BROADCAST_BYTES = 1_000_000, 16_000_000


def sized(ids: DataFrame, row_bytes: Column | int = 16) -> DataFrame:
    """``ids`` (already written, so measuring is cheap) marked for broadcast if they are small.

    ``row_bytes`` is what a row takes: a number where rows are ids, else an expression.
    """
    size = row_bytes if isinstance(row_bytes, Column) else F.lit(row_bytes)
    rows, total = ids.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(ids) if rows <= BROADCAST_IDS and total <= BROADCAST_BYTES else ids
