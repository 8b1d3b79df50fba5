"""The corpus pipeline: five stages from raw documents to a weighted mixture.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor
kept; it is written as Parquet and read again before the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripmine.llm import decontaminate, fuzzy_lines, kneser_ney, mixing, token_groups
from tripmine.llm.ids import sized
from tripmine.workspace import as_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity stays under their language's threshold."""
    return kneser_ney.without_rejected(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that are kept elsewhere; texts and sizes change, rows stay."""
    return fuzzy_lines.dedup_lines(docs)


def _keyed(docs: DataFrame) -> DataFrame:
    """``_key, doc_id, text``: rows of one id and different texts have keys of their own."""
    key = F.xxhash64(docs["doc_id"], docs["text"])
    return docs.select(key.alias("_key"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    keys = sized(as_table(keys.toDF("_out").distinct(), "out"))
    return docs.join(keys, F.xxhash64(docs["doc_id"], docs["text"]) == keys["_out"], "left_anti")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies (five words, 0.8); rows without words stay.

    Rows alike in id and text are copies as well, and one of them stays.
    """
    keyed = _keyed(docs)
    found = token_groups.link_components(keyed.select(F.col("_key").alias("doc_id"), "text"), words=5, percent=80)
    found = as_table(found.where("n_shingles > 0").select(F.col("doc_id").alias("_key"), "component_id"), "groups")
    rows = keyed.groupBy("_key").agg(F.first("doc_id").alias("doc_id"), F.count("*").alias("n"))
    members = as_table(found.distinct().join(rows, "_key"), "members")
    first = members.groupBy("component_id").agg(F.min(F.struct("doc_id", "_key"))["_key"].alias("kept"))
    spare = members.join(first, "component_id").where("_key <> kept").select("_key")
    rest = _without(docs, spare)
    repeated = as_table(members.where("n > 1").select(F.col("_key").alias("_again")), "repeated")
    if repeated.isEmpty():
        return rest
    again = F.xxhash64(rest["doc_id"], rest["text"])
    one = rest.join(sized(repeated), again == repeated["_again"], "left_semi").dropDuplicates(["doc_id", "text"])
    return rest.join(sized(repeated), again == repeated["_again"], "left_anti").unionByName(one)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    keyed = _keyed(docs).select(F.col("_key").alias("doc_id"), "text")
    return _without(docs, decontaminate.contained_items(keyed, items).select("doc_id"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with at least one copy in the mixture, with domain posteriors, rate and copies."""
    return mixing.mixed(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("copies > 0")


STAGES = [
    ("quality", quality),
    ("lines", lines),
    ("near_copies", near_copies),
    ("decontaminate", without_benchmark),
    ("mixture", mixture),
]

#: Perplexity and fitted rates have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = as_table(stage(spark, docs, sf_dir), name)
    return docs
