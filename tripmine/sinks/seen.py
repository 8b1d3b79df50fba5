"""Remembered ids: a table that outlives runs and is never shuffled.

Ids are stored as Parquet in hash buckets of their key. A join on the key reads the
buckets as they lie, so every call moves its own new rows only, however many ids the
table holds. Each row says which writer recorded it in which batch: a batch that is
repeated after a failure sees the table as it was before, and may record its ids again.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Enough that a bucket of the expected number of ids fits a task; fixed when a table is made.
BUCKETS = 64


def id_key(id_: Column | str) -> Column:
    """The id as a text that is never null, so that a null id equals a null id."""
    id_ = F.col(id_) if isinstance(id_, str) else id_
    return F.coalesce(F.concat(F.lit("="), id_.cast("string")), F.lit(""))


class SeenIds:
    """The ids remembered under ``path``; ``buckets`` counts for a new table only."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark = spark
        self.path = path.rstrip("/")
        self.buckets = self._fixed_buckets(buckets)
        self.name = "seen_" + hashlib.md5(self.path.encode()).hexdigest()
        spark.sql(
            f"""CREATE TABLE IF NOT EXISTS {self.name} (key STRING, writer STRING, batch BIGINT) USING parquet
            CLUSTERED BY (key) INTO {self.buckets} BUCKETS LOCATION '{self.path}/ids'"""
        )

    def _fixed_buckets(self, wanted: int) -> int:
        spec = f"{self.path}/buckets"
        try:
            return self.spark.read.schema("buckets int").parquet(spec).first().buckets
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
        self.spark.range(1, numPartitions=1).select(F.lit(wanted).alias("buckets")).write.parquet(spec)
        return wanted

    def ids(self, writer: str = "", before: int | None = None) -> DataFrame:
        """Remembered keys; of ``writer``'s own only those of batches before ``before``."""
        # other sessions may have added files
        self.spark.catalog.refreshTable(self.name)
        table = self.spark.table(self.name)
        if before is not None:
            table = table.where((F.col("writer") != writer) | (F.col("batch") < before))
        return table.select(F.col("key").alias("__seen"))

    def unseen(self, rows: DataFrame, key: str = "key", **state) -> DataFrame:
        """The rows whose ``key`` (see :func:`id_key`) is not remembered."""
        return rows.join(self.ids(**state), F.col(key) == F.col("__seen"), "left_anti")

    def add(self, keys: DataFrame, writer: str = "", batch: int = 0) -> None:
        """Remember the distinct keys of the one column of ``keys``."""
        rows = keys.toDF("key").distinct().repartition(self.buckets, "key")
        rows = rows.select("key", F.lit(writer).alias("writer"), F.lit(batch).cast("bigint").alias("batch"))
        rows.write.insertInto(self.name)
