"""The pipeline's stages against brute force, and the edge cases all stages share."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from termwell.llm.common import word_hashes
from termwell.llm.minhash import probability_jaccard, weighted_shingles

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def ids(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


def test_order_and_names():
    assert list(STAGES) == ["language_id", "near_dedup", "decontamination", "mixing", "sharding"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_language_keeps_clean_and_drops_noise(spark, docs):
    noise = spark.createDataFrame([(9001, "", "en", "src0", 0), (9002, None, "en", "src0", 0), (9003, "1234 #### 9876", "de", "src1", 14),
                                   (9004, "zqxj vkqz xxqj wvzk qqzx jjvw zzkq xvjq wqzk", None, None, 45)], docs.schema)
    out = STAGES["language_id"](spark, docs.union(noise), SF)
    assert out.columns == docs.columns and ids(out) == ids(docs)


def test_near_dedup_keeps_one_of_each_class(spark, docs):
    rows = [(r.doc_id, weighted_shingles(word_hashes(r.text))) for r in docs.collect()]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and probability_jaccard(rows[i][1], rows[j][1]) >= 0.8:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    smallest = {}
    for k, (i, _) in enumerate(rows):
        smallest[label[k]] = min(smallest.get(label[k], i), i)
    out = STAGES["near_dedup"](spark, docs.union(docs.limit(20)), SF)
    assert out.columns == docs.columns and ids(out) == Counter(smallest.values())


def test_decontamination_drops_leaks(spark, docs):
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = lambda t: " ".join((t or "").split())
    leaked = {r.doc_id for r in docs.collect() if any(clean(b) and clean(b) in clean(r.text) for b in bench)}
    out = STAGES["decontamination"](spark, docs, SF)
    assert leaked and out.columns == docs.columns and not leaked & set(ids(out))
    assert len(ids(out)) >= docs.count() - len(leaked) - 2


def test_mixing_repeats_whole_documents(spark, docs):
    out = STAGES["mixing"](spark, docs, SF)
    assert out.columns == docs.columns and max(ids(out).values()) <= 2
    texts = {tuple(r) for r in docs.collect()}
    assert {tuple(r) for r in out.collect()} <= texts
    words = lambda df: df.agg(F.sum(F.size(F.split(F.trim("text"), r"\s+")))).first()[0]
    assert abs(words(out) / words(docs) - 1.5) < 0.05


def test_sharding_adds_places(spark, docs):
    out = STAGES["sharding"](spark, docs, SF)
    assert out.columns == [*docs.columns, "shard", "slot"] and ids(out) == ids(docs)


@pytest.mark.parametrize("name", list(STAGES))
def test_edge_rows_and_clashing_columns(spark, docs, name):
    odd = docs.limit(30).select(*docs.columns, *[F.lit("kept").alias(c) for c in (
        "document", "row", "h", "size", "salt", "score", "rep", "key", "class_id", "text_hash", "label", "p", "ll", "host", "item_id")])
    blank = odd.limit(3).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in odd.schema])
    long = odd.limit(1).withColumn("text", F.repeat(F.lit("the long text and so on "), 20000))
    table = odd.union(blank).union(long).union(odd.limit(2))
    out = STAGES[name](spark, table, SF)
    rows = out.collect()
    assert [c for c in out.columns if c not in ("shard", "slot")] == table.columns
    assert all(r["document"] in ("kept", None) for r in rows) and len(rows) <= 2 * table.count()
    assert STAGES[name](spark, table.limit(0), SF).count() == 0


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "text", "lang", "source", "n_chars", "shard", "slot"} == set(out.columns) and out.count() > 0
    assert out.agg(F.countDistinct("shard")).first()[0] > 12
