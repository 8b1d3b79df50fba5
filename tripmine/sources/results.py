"""Stored flight results of the second-generation tracker."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripmine.schemas import RESULT_FILE
from tripmine.sources.batches import batch_name


def load_results(spark: SparkSession, path: str) -> DataFrame:
    """Flights of one result file, or folder of result files, in file order."""
    files = (
        spark.read.schema(RESULT_FILE)
        .option("multiLine", True)
        .option("recursiveFileLookup", True)
        .json(path)
    )
    return files.select(
        F.col("_metadata.file_path").alias("path"), F.posexplode("flights").alias("place", "f")
    ).select(F.struct("path", "place").alias("seq"), "f.*")


def latest_results(spark: SparkSession, folder: str) -> str:
    """Path of the result last modified, by the file listing alone."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(f"{folder}/flights_*.json")
    )
    name = batch_name(F.col("path"))
    # files of one time: the greatest name
    latest = files.agg(F.max_by(name, F.struct("modificationTime", "path"))).first()[0]
    return f"{folder}/{latest}"
