"""From raw documents to shards of a training mix.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as
Parquet and read again for the next one. All but the last return the columns of
``documents``; a stage works on every row its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termwell.llm.common import read_table, stored
from termwell.llm.decontaminate import with_leaks
from termwell.llm.language import fit_text_model, identify
from termwell.llm.minhash import near_duplicates
from termwell.llm.mixing import mixed_rows, word_count
from termwell.llm.sharding import assign_shards


def _rows(docs: DataFrame, *columns: str) -> DataFrame:
    """The rows as a struct beside the columns a stage reads, so that no column of theirs can clash."""
    return docs.select(F.struct("*").alias("document"), *columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; text that no language explains goes."""
    model = fit_text_model(docs, F.col("doc_id"))
    found = identify(_rows(docs, "text", "lang", "source"), model, declared=F.col("lang"), host=F.col("source"))
    return found.filter("accepted").select("document.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one with the smallest doc_id."""
    classes = near_duplicates(docs)
    staying = classes.filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).select("doc_id").distinct()
    keyed = _rows(docs, "doc_id").withColumn("text_hash", F.xxhash64("document.text"))
    once = keyed.dropDuplicates(["doc_id", "text_hash"])
    return once.join(staying, once["doc_id"].eqNullSafe(staying["doc_id"]), "left_semi").select("document.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item and no long excerpt, re-parameterised ones included.

    An item of fewer than five words inside a longer document does not drop it.
    """
    return with_leaks(_rows(docs, "text"), read_table(spark, sf_dir, "benchmark")).filter(
        ~F.exists("leaks", lambda leak: leak["kind"] != "short")).select("document.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources take them."""
    return mixed_rows(docs, word_count())


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix with shard and slot, equal texts together."""
    return assign_shards(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

ORACLE_SQL = None  # the stages are not expressible in SQL; tests compare each with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder of tables."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
