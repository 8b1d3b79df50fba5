"""The stream gives what the batch gives, once per id, also late, after a restart and after a repeated batch."""

from pyspark.sql import functions as F

from tripmine.plans.gate import gate
from tripmine.sinks.seen import SeenIds
from tripmine.streaming.gate import (
    batch_stream,
    first_copies,
    judged,
    load_ingested,
    mail_stream,
    start_gate,
    start_ingest,
    stream_funnel,
)
from workload import tables


def details(df):
    d = F.col("booking_details")
    return sorted(df.select("id", d["confirmation_code"], d["flight_numbers"], d["confidence"]).collect(), key=str)


def folders(tmp_path):
    return [str(tmp_path / n) for n in ("landing", "target", "checkpoint")]


def test_repeats_and_restart(spark, sf_dir, tmp_path):
    landing, target, checkpoint = folders(tmp_path)
    mail = tables.mail(spark, sf_dir)
    early, late = mail.where("seq % 2 = 0"), mail.where("seq % 3 = 0")

    def run():
        arrivals = mail_stream(spark, landing, mail.schema, files_per_trigger=2)
        start_gate(arrivals, target, checkpoint).awaitTermination()
        return spark.read.parquet(target)

    early.repartition(3).write.mode("append").parquet(landing)
    assert details(run()) == details(gate(early))
    # Every third mail again: half of them were seen before the restart.
    late.repartition(3).write.mode("append").parquet(landing)
    everything = mail.where("seq % 2 = 0 OR seq % 3 = 0")
    assert details(run()) == details(gate(everything))
    assert details(run()) == details(gate(everything))
    counts = stream_funnel(spark, target).first()
    assert counts.total == early.count() + late.count() and counts.confirmed <= counts.potential <= counts.total


def test_a_repeated_batch_replaces_what_it_wrote(spark, sf_dir, tmp_path):
    import shutil

    landing, target, checkpoint = folders(tmp_path)
    mail = tables.mail(spark, sf_dir).where("seq < 400")
    mail.repartition(4).write.parquet(landing)

    def run():
        start_gate(mail_stream(spark, landing, mail.schema, files_per_trigger=1), target, checkpoint).awaitTermination()
        return details(spark.read.parquet(target))

    first = run()
    assert first == details(gate(mail))
    # as if the driver had died after the last batch was written, before it was marked as done
    shutil.os.remove(f"{checkpoint}/commits/3")
    shutil.os.remove(f"{checkpoint}/commits/.3.crc")
    assert run() == first
    # a checkpoint that is gone starts a new writer: ids of the old one stay known
    start_gate(mail_stream(spark, landing, mail.schema), target, f"{checkpoint}_new").awaitTermination()
    assert details(spark.read.parquet(target)) == first


def test_first_of_each_id_is_judged(spark):
    rows = [(3, "a", "Boarding pass", "flight VN123 code ABC123"), (1, "a", "Note", "x"), (2, "b", "Boarding pass", "flight VN123 code ABC123"),
            (4, None, "Boarding pass", "flight VN123 code ABC123"), (5, None, "Note", "x"), (6, "b", "Note", "x")]
    mail = spark.createDataFrame([(*r[:3], "x", r[3]) for r in rows], "seq int, id string, subject string, sender string, body string")
    found = {r.key: r.mail and r.mail.seq for r in first_copies(judged(mail), F.col("seq")).collect()}
    assert found == {"=a": None, "=b": 2, "": 4}


def test_batch_files_as_stream(spark, sf_dir, tmp_path):
    _, target, checkpoint = folders(tmp_path)
    arrivals = batch_stream(spark, tables.email_batches(spark, sf_dir))
    start_gate(arrivals, target, checkpoint).awaitTermination()
    assert details(spark.read.parquet(target)) == details(gate(tables.mail(spark, sf_dir)))


def test_ingest_keeps_year_and_place(spark, sf_dir, tmp_path):
    _, target, checkpoint = folders(tmp_path)
    arrivals = batch_stream(spark, tables.email_batches(spark, sf_dir), files_per_trigger=3)
    start_ingest(arrivals, target, checkpoint).awaitTermination()
    mail = tables.mail(spark, sf_dir).where("year(sent_at) = 1996")
    stored = load_ingested(spark, target, 1996).orderBy("seq").collect()
    assert [r.id for r in stored] == [
        r.id for r in mail.orderBy(F.expr(tables.HALF), F.floor(F.col("seq") / tables.CHUNK), "seq").collect()
    ]
    scan = load_ingested(spark, target, 1996)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in scan


def test_seen_ids_between_runs(spark, tmp_path):
    path = str(tmp_path / "seen")
    seen = SeenIds(spark, path, buckets=4)
    seen.add(spark.createDataFrame([("=a",), ("",), ("=a",)], "k string"), "w", 0)
    other = spark.newSession()
    rows = other.createDataFrame([("=a",), ("=b",), ("",)], "key string")
    again = SeenIds(other, path, buckets=99)
    assert again.buckets == 4 and [r.key for r in again.unseen(rows).collect()] == ["=b"]
    again.add(rows, "w", 1)
    assert {r["__seen"] for r in seen.ids("w", before=1).collect()} == {"=a", ""}
    assert {r["__seen"] for r in seen.ids("v", before=0).collect()} == {"=a", "=b", ""}
    assert SeenIds(spark, str(tmp_path / "none")).unseen(rows.limit(3)).count() == 3


def test_seen_ids_are_not_shuffled(spark, tmp_path):
    seen = SeenIds(spark, str(tmp_path / "seen"))
    seen.add(spark.range(1000).select(F.concat(F.lit("="), "id")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        new = seen.unseen(spark.range(500, 1500).select(F.concat(F.lit("="), "id").alias("key")))
        text = new._jdf.queryExecution().executedPlan().toString()
        assert new.count() == 500
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SelectedBucketsCount: 64 out of 64" in text and text.count("Exchange hashpartitioning") == 1
