"""Batches of JSON envelopes, the form the batch readers load."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tripmine.schemas import EMAIL_JSON
from tripmine.sinks.store import exists
from tripmine.workspace import as_table

#: Size of one envelope. A reader takes each as a whole.
FILE_BYTES = 32_000_000


def packed(rows: DataFrame, size: Column, most: int, *order: Column | str) -> DataFrame:
    """``rows`` with ``__file``, the number of the file they go to, and ``__at``, their order.

    Files take rows in order and hold ``most`` units of ``size`` each, beyond which
    goes its last row at most. File numbers come from a running sum that no task takes over
    all rows: each range of the sorted rows has its own, and the ranges' totals (one row
    each) give what lies before.
    """
    sorted_ = as_table(
        rows.withColumn("__size", size).orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), "sorted"
    )
    part = F.shiftrightunsigned("__at", 33).alias("__part")
    totals = sorted_.groupBy(part).agg(F.sum("__size").alias("__sum"))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__part", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    summed = sorted_.select("*", part).withColumn("__before", F.coalesce(F.sum("__size").over(inside), F.lit(0)))
    # one row per sort partition: bounded by the shuffle width
    placed = summed.join(F.broadcast(offsets), "__part")
    number = F.floor((F.col("__offset") + F.col("__before")) / most).cast("bigint")
    return placed.withColumn("__file", number).drop("__part", "__before", "__offset", "__size")


def save_envelopes(
    emails: DataFrame,
    folder: str,
    year: int,
    batch_id: str,
    order: str = "seq",
    fetch_date: str | None = None,
    file_bytes: int = FILE_BYTES,
) -> str | None:
    """Write mails as the batch ``emails_{year}_{batch_id}.json``; returns its path, None without mails.

    The batch is a folder of envelopes of about ``file_bytes``, whose names keep the
    order of the mails by ``order``; readers take it for one batch. An existing batch is
    never overwritten.
    """
    path = f"{folder}/emails_{year}_{batch_id}.json"
    if exists(emails.sparkSession, path):
        raise ValueError(f"batch {path!r} exists already")
    item = F.struct(*(F.col("sender" if f == "from" else f).cast("string").alias(f) for f in EMAIL_JSON.fieldNames()))
    rows = emails.select(item.alias("item"), F.col(order).alias("__order"))
    rows = packed(rows, F.octet_length(F.to_json("item")) + 1, file_bytes, "__order")
    if rows.isEmpty():
        return None
    date = F.lit(fetch_date) if fetch_date else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    # a file's mails are bounded by its size
    listed = F.transform(F.array_sort(F.collect_list(F.struct("__at", "item"))), lambda r: r["item"])
    metadata = F.struct(date.alias("fetch_date"), F.lit(year).alias("year"), F.count("*").alias("email_count"))
    files = rows.groupBy(F.lpad(F.col("__file").cast("string"), 12, "0").alias("file")).agg(
        metadata.alias("metadata"), listed.alias("emails")
    )
    writer = files.write.partitionBy("file").option("maxRecordsPerFile", 1).option("ignoreNullFields", False)
    writer.json(path)
    return path
