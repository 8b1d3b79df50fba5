"""The mail store: append-only Parquet, one partition per year and batch."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tripmine.operators.stats import batch_counts
from tripmine.workspace import as_table

STORED = "seq bigint, id string, subject string, sender string, date string, body string, batch_id string, year int"
METADATA = "batch_id string, fetch_date string, year int, email_count bigint"


def save_batch(
    emails: DataFrame, store: str, batch_id: str, year: int | Column
) -> DataFrame | None:
    """Append ``emails`` as a new batch; returns its metadata, None if empty.

    ``year`` is a number, or a column where one fetch spans years. The batch
    id has to be new, so a batch is never overwritten and a run repeated by
    mistake is refused. The data is written before its metadata. A batch without
    mail leaves nothing behind, and its id can be used again.
    """
    spark = emails.sparkSession
    target = f"{store}/mail/batch_id={batch_id}"
    if exists(spark, target):
        raise ValueError(f"batch {batch_id!r} exists already")
    year = year if isinstance(year, Column) else F.lit(year)
    # computed once, whether it turns out empty or not
    rows = as_table(emails.withColumn("year", year.cast("int")), "batch")
    if rows.isEmpty():
        return None
    # partitions of a year are merged or split to the advisory size: no file per task and year
    rows.hint("rebalance", F.col("year")).write.partitionBy("year").parquet(target)
    metadata = batch_counts(rows, "year").select(
        F.lit(batch_id).alias("batch_id"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("fetch_date"),
        "year",
        "email_count",
    )
    # At most one row per year.
    metadata.coalesce(1).write.mode("append").parquet(f"{store}/metadata")
    return store_metadata(spark, store).where(F.col("batch_id") == batch_id)


def load_store(
    spark: SparkSession, store: str, year: int | None = None, schema: StructType | str = STORED
) -> DataFrame:
    """Mail of all batches, or of one year: other years are not read.

    A store without any batch is an empty table of ``schema``.
    """
    if not exists(spark, f"{store}/mail"):
        return spark.createDataFrame([], schema)
    mail = spark.read.parquet(f"{store}/mail")
    return mail if year is None else mail.where(F.col("year") == year)


def store_metadata(spark: SparkSession, store: str) -> DataFrame:
    if not exists(spark, f"{store}/metadata"):
        return spark.createDataFrame([], METADATA)
    return spark.read.schema(METADATA).parquet(f"{store}/metadata")


def save_json_lines(emails: DataFrame, folder: str, year: int, batch_id: str) -> str:
    """Exchange form of a batch: one mail per line, splittable on reading.

    Read it with ``load_single_mails(..., multi_line=False)``; its name is none
    that ``load_emails`` takes for a batch of envelopes.
    """
    path = f"{folder}/mails_{year}_{batch_id}.jsonl"
    emails.withColumnRenamed("sender", "from").write.json(path)
    return path


def exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        return True
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
