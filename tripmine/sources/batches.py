"""Landed mail: JSON batch files, single-mail files and the Parquet store.

A batch is a file, or a folder of files, called ``emails_{year}_{stamp}.json``;
each file holds one envelope ``{"metadata": ..., "emails": [...]}``. An
envelope cannot be split, so one file is one task: keep files small, or move
mail into the Parquet store of :mod:`tripmine.sinks.store`.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripmine.schemas import EMAIL_BATCH, EMAIL_JSON

EMAIL_COLUMNS = ["id", "subject", "sender", "date", "body"]
BATCH_COLUMNS = ["batch_file", "seq", *EMAIL_COLUMNS]


def _found(read) -> DataFrame | None:
    """The frame ``read`` makes, or None where the path holds no file."""
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _envelopes(spark: SparkSession, path: str) -> DataFrame | None:
    reader = spark.read.schema(EMAIL_BATCH).option("multiLine", True)
    reader = reader.option("recursiveFileLookup", True)
    return _found(lambda: reader.json(path))


def batch_name(path: Column) -> Column:
    """The batch a file belongs to: the first path part that ends in ``.json``."""
    return F.regexp_extract(path, r"([^/]*\.json)(?:/|$)", 1)


def _emails(envelopes: DataFrame) -> DataFrame:
    """One row per mail; a broken file yields none.

    ``seq`` orders mails by file name, then by place in the file.
    """
    path = F.col("_metadata.file_path")
    return (
        envelopes.select(
            path.alias("path"), F.posexplode("emails").alias("place", "email")
        )
        .select(
            batch_name(F.col("path")).alias("batch_file"),
            F.struct("path", "place").alias("seq"),
            "email.*",
        )
        .withColumnRenamed("from", "sender")
    )


def no_emails(spark: SparkSession) -> DataFrame:
    """The empty mail table."""
    row = "struct<path:string,place:int>"
    texts = ", ".join(f"{c} string" for c in EMAIL_COLUMNS)
    return spark.createDataFrame([], f"batch_file string, seq {row}, {texts}")


def _pattern(folder: str, year: int | None) -> str:
    return f"{folder}/*.json" if year is None else f"{folder}/emails_{year}_*.json"


def load_emails(
    spark: SparkSession, folder: str, year: int | None = None, file: str | None = None
) -> DataFrame:
    """Mails of a named batch, of a year, or of all batches in ``folder``.

    A named batch is looked up as given, then inside ``folder``. If neither
    exists, the year (or everything) is loaded instead.
    """
    candidates = [file, f"{folder}/{file}"] if file else []
    for path in [*candidates, _pattern(folder, year)]:
        found = _envelopes(spark, path)
        if found is not None:
            return _emails(found)
    return no_emails(spark)


def latest_batch(spark: SparkSession, folder: str, year: int) -> str | None:
    """Path of the year's batch with the greatest name. Only the file listing
    is read, no content."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    files = _found(lambda: reader.load(_pattern(folder, year)))
    name = files.agg(F.max(batch_name(F.col("path")))).first()[0] if files is not None else None
    return f"{folder}/{name}" if name else None


def load_latest(spark: SparkSession, folder: str, year: int) -> DataFrame:
    path = latest_batch(spark, folder, year)
    return load_emails(spark, folder, file=path) if path else no_emails(spark)


def available_years(spark: SparkSession, folder: str) -> DataFrame:
    """Sorted distinct years of the readable batches."""
    found = _envelopes(spark, _pattern(folder, None))
    if found is None:
        return spark.createDataFrame([], "year int")
    years = found.select(F.col("metadata.year").alias("year"))
    return years.where(F.col("year").isNotNull()).distinct().orderBy("year")


def batch_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """What the envelopes say about themselves, one row per file."""
    found = _envelopes(spark, _pattern(folder, None))
    if found is None:
        found = spark.createDataFrame([], EMAIL_BATCH).withColumn("_metadata", F.struct(F.lit("").alias("file_path")))
    return found.where(F.col("metadata").isNotNull()).select(
        batch_name(F.col("_metadata.file_path")).alias("batch_file"), "metadata.*"
    )


def unreadable_batches(spark: SparkSession, folder: str, year: int | None = None) -> DataFrame:
    """Files the loaders skip: ``batch_file, path, bytes, reason``.

    ``not json``: cut short or no JSON at all; ``no mails``: JSON without a list of mails.
    Only the few columns of the envelope are parsed, and no content is returned.
    """
    schema = T.StructType([*EMAIL_BATCH.fields, T.StructField("_broken", T.StringType())])
    reader = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True)
    reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken")
    found = _found(lambda: reader.json(_pattern(folder, year)))
    if found is None:
        return spark.createDataFrame([], "batch_file string, path string, bytes bigint, reason string")
    # a broken record may still have given its mails
    reason = F.when(F.col("emails").isNotNull(), None).when(F.col("_broken").isNotNull(), "not json").otherwise("no mails")
    path = F.col("_metadata.file_path")
    rows = found.select(
        batch_name(path).alias("batch_file"), path.alias("path"), F.col("_metadata.file_size").alias("bytes"),
        reason.alias("reason"),
    )
    return rows.where("reason IS NOT NULL").distinct()


def load_single_mails(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Mails stored one JSON object per file; with ``multi_line=False``, one
    object per line, which Spark can split."""
    mails = spark.read.schema(EMAIL_JSON).option("multiLine", multi_line).json(path)
    # A file that is no mail object reads as all null.
    return mails.where(F.coalesce(*mails.columns).isNotNull()).withColumnRenamed("from", "sender")


def union_batches(*mails: DataFrame) -> DataFrame:
    """All rows of all batches; columns a batch lacks are null."""
    result = mails[0]
    for other in mails[1:]:
        result = result.unionByName(other, allowMissingColumns=True)
    return result
