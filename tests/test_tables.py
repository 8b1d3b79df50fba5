"""Landed tables: large ones are written as they are read."""

import pytest
from pyspark.sql import functions as F

from workload import tables


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


@pytest.fixture
def folder(spark, sf_dir, tmp_path):
    """Tables whose orders lie in as many files as there are cores."""
    n = spark.sparkContext.defaultParallelism
    rows = spark.range(n * 50, numPartitions=n).select(
        F.when(F.col("id") % 50 != 7, F.col("id")).alias("o_orderkey"),
        (F.col("id") % 9).alias("o_custkey"),
        F.expr("timestamp_ntz'1995-03-01' + make_dt_interval(CAST(id % 700 AS INT))").alias("o_orderdate"),
    )
    rows.unionAll(rows.where("o_orderkey % 50 < 3")).coalesce(n).write.parquet(f"{tmp_path}/orders.parquet")
    for name in ("documents", "conversations"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_shared_tables_are_read_as_they_lie(spark, sf_dir, folder):
    orders = tables.given(spark, folder, "orders")
    assert exchanges(tables._spread_out(spark, orders)) == 0
    one = tables.given(spark, sf_dir, "orders")
    spread = tables._spread_out(spark, one)
    assert exchanges(spread) == 1 and spread.count() == one.count()
    assert tables._spread_out(spark, orders.where("false")).count() == 0


def test_mail_is_landed_without_a_sort_and_whole(spark, folder, tmp_path, monkeypatch):
    plans = []
    given = tables._derived
    monkeypatch.setattr(tables, "_derived", lambda *a, **k: plans.append(given(*a, **k)) or plans[-1])
    mail = tables.mail(spark, folder)
    wanted = plans[0].select(*tables.MAIL_COLUMNS).withColumn("labels", F.array("label", F.lit("TRAVEL"))).drop("label")
    assert mail.exceptAll(wanted.select(mail.columns)).isEmpty() and mail.count() == wanted.count()
    # files in time order would each hold few of the years
    assert mail.groupBy(F.input_file_name()).agg(F.count_distinct(F.year("sent_at")).alias("n")).agg(F.max("n")).first()[0] > 1
