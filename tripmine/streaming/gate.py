"""Incremental booking gate: every mail id is judged once, over all runs."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tripmine.functions.booking import potential_flight, with_booking_details
from tripmine.rules import BOOKING_MIN_CONFIDENCE
from tripmine.schemas import EMAIL_BATCH
from tripmine.sinks.seen import SeenIds, id_key
from tripmine.sources.batches import BATCH_COLUMNS, batch_name

COUNTS = ("total", "potential", "confirmed")


def batch_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """New batch files of a folder as a stream of mails.

    Rows carry their batch, their year and, as ``seq``, file and place in it, so
    the order of the files survives whatever order they are read in.
    """
    files = (
        spark.readStream.schema(EMAIL_BATCH)
        .option("multiLine", True)
        .option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", files_per_trigger)
        .json(folder)
    )
    path = F.col("_metadata.file_path").alias("path")
    mails = files.select(path, "metadata.year", F.posexplode("emails").alias("place", "email"))
    name = batch_name(F.col("path"))
    named_year = F.regexp_extract(name, r"^emails_(\d{4})_", 1).try_cast("int")
    return (
        mails.select(
            name.alias("batch_file"),
            F.struct("path", "place").alias("seq"),
            "email.*",
            F.coalesce("year", named_year).alias("year"),
        )
        .withColumnRenamed("from", "sender")
        .select(*BATCH_COLUMNS, "year")
    )


def mail_stream(
    spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 1000
) -> DataFrame:
    """New Parquet files of a folder of mail as a stream."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def judged(mail: DataFrame, threshold: float = BOOKING_MIN_CONFIDENCE) -> DataFrame:
    """``mail`` with flags ``__potential`` and ``__confirmed``; where it is no booking
    the texts are gone, so mail that fails the gate moves on without its body."""
    flagged = mail.withColumn("__potential", potential_flight())
    only = {c: F.when(F.col("__potential"), F.col(c)) for c in ("subject", "body")}
    detailed = with_booking_details(flagged.withColumns(only))
    confirmed = F.coalesce(F.col("booking_details.confidence") >= threshold, F.lit(False))
    return detailed.withColumn("__confirmed", confirmed)


def _order(mail: DataFrame) -> Column:
    """Which of several mails of one id counts: the first by ``seq``, else one chosen by content."""
    return F.col("seq") if "seq" in mail.columns else F.xxhash64(*mail.columns)


def first_copies(rows: DataFrame, order: Column) -> DataFrame:
    """One row ``key, mail`` per id of judged ``rows``; ``mail`` is null where the first is no booking.

    An arg-min with a partial step: each task sends one row per id, and mails that
    fail the gate go as a bare id, so an id that fills a third of a batch costs a row
    per task.
    """
    carried = [c for c in rows.columns if not c.startswith("__")]
    mail = F.when(F.col("__confirmed"), F.struct(*carried))
    keyed = rows.select(id_key("id").alias("key"), order.alias("__order"), mail.alias("mail"))
    return keyed.groupBy("key").agg(F.min_by("mail", "__order").alias("mail"))


def start_gate(
    mail: DataFrame,
    target: str,
    checkpoint: str,
    available_now: bool = True,
    threshold: float = BOOKING_MIN_CONFIDENCE,
    ids: str | None = None,
    buckets: int = 64,
) -> StreamingQuery:
    """Append gated mail to ``target``, one mail per id over all batches and runs.

    An id counts as seen even if its mail is no booking; a null id is one id. Ids are
    remembered in a :class:`SeenIds` table (``ids``, by default beside the target), for
    good and outside of the session's state: late mail is judged like any other. Each
    batch writes its mails and its row of counts to places of its own number, so a batch
    that is repeated after a failure replaces what it wrote, and appears exactly once.
    """
    target = target.rstrip("/")
    seen = SeenIds(mail.sparkSession, ids or f"{target}_ids", buckets)

    def append(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        writer = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint
        place = f"query_id={writer}/batch_id={number}"
        counts = Observation()
        rows = judged(batch, threshold).observe(
            counts,
            F.count("*").alias("total"),
            F.count_if("__potential").alias("potential"),
            F.count_if("__confirmed").alias("confirmed"),
        )
        new = seen.unseen(first_copies(rows, _order(batch)), writer=writer, before=number)
        new = new.persist(StorageLevel.DISK_ONLY)
        try:
            passed = new.where(F.col("mail").isNotNull()).select("mail.*")
            passed.write.mode("overwrite").parquet(f"{target}/{place}")
            seen.add(new.select("key"), writer, number)
        finally:
            new.unpersist()
        row = spark.range(1, numPartitions=1).select(
            *(F.lit(counts.get[c]).cast("bigint").alias(c) for c in COUNTS)
        )
        row.write.mode("overwrite").parquet(f"{target}_counts/{place}")

    writer = mail.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stream_funnel(spark: SparkSession, target: str) -> DataFrame:
    """Mails, potential flight mails and confirmed bookings a gate has seen over all its
    batches, copies included; a row of the same columns as the batch form gives."""
    counts = spark.read.parquet(f"{target.rstrip('/')}_counts")
    return counts.agg(*(F.sum(c).alias(c) for c in COUNTS))


def start_ingest(mail: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """First of two steps: append the mails of :func:`batch_stream` as they are, in
    partitions by year, to be processed later."""
    return (
        mail.writeStream.format("parquet")
        .partitionBy("year")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def load_ingested(spark: SparkSession, target: str, year: int | None = None) -> DataFrame:
    """Ingested mail of all years, or of one: other years are not read. ``seq`` orders it."""
    mail = spark.read.parquet(target)
    return mail if year is None else mail.where(F.col("year") == year)
