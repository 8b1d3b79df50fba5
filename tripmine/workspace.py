"""Shared scratch space: where intermediate tables are written on a cluster."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    A local session without the setting gets a temporary folder; a cluster
    session without it is an error, because executors would not share one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return _local_folder()


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="tripmine-")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder nobody has used before."""
    return f"{shared_folder(spark)}/tripmine/{uuid.uuid4().hex}/{name}"


def as_table(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once and read it back.

    Cuts the lineage with files that outlive lost executors, and gives the
    optimizer real sizes for what follows.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
