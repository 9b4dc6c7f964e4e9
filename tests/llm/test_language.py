"""Language identification: held-out accuracy, fusion, rejection, edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from termwell.llm.language import (
    TextModel,
    declared_in,
    fit_text_model,
    host_of,
    identify,
    suffix_of,
    trigram_buckets,
    visible_text,
)

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def model(docs):
    return fit_text_model(docs.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0), F.col("doc_id"))


def test_held_out_accuracy_of_the_text_alone(docs, model):
    held = docs.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    out = identify(held.select("doc_id", "text", "lang"), model).select("lang", "text_language").collect()
    assert len(out) > 100 and np.mean([r.lang == r.text_language for r in out]) > 0.97


def test_clean_documents_are_kept(docs, model):
    out = identify(docs, model, declared=F.col("lang"), host=F.col("source"))
    assert out.filter("NOT accepted").count() == 0
    assert out.filter("language = lang").count() >= 0.99 * out.count()


def test_noise_and_empty_are_rejected(spark, model):
    rows = [(1, ""), (2, None), (3, "12345 !!! ###"), (4, "zqxj vkqz xxqj wvzk qqzx jjvw zzkq xvjq wqzk " * 5),
            (5, "The and that with for the in of to ation ing the and of"), (6, "x" * 300000)]
    df = spark.createDataFrame([(i, t, "kept", 1.5) for i, t in rows], "doc_id long, text string, `row` string, ll double")
    got = {r.doc_id: r for r in identify(df, model).collect()}
    assert {i for i, r in got.items() if r.accepted} == {5}
    assert got[1].language == got[2].language == got[4].language == "und" and got[5].language == "en"
    assert all(r.row == "kept" and r.ll == 1.5 for r in got.values())


def test_evidence_decides_short_texts(spark):
    """Equal text likelihoods: the declaration decides, else the host, else the suffix, else all documents."""
    table = np.log(np.full((1 << 15, 2), 1e-6))
    for word, column in (("aaaa", 0), ("bbbb", 1)):
        table[trigram_buckets(word), column] = np.log(0.2)
    table[trigram_buckets("cccc")] = np.log(0.2)
    model = TextModel(("de", "fr"), table.astype(np.float32))
    rows = [(k, "aaaa", "de", "http://one.example.de/x") for k in range(60)]
    rows += [(100 + k, "bbbb", "fr", "http://two.example.fr/") for k in range(40)]
    rows += [(200 + k, "aaaa", None, "http://mixed.example.fr/") for k in range(40)]
    rows += [(1000, "cccc", "fr", None), (1001, "cccc", None, "http://one.example.de/y"), (1002, "cccc", None, "http://new.example.fr/"),
             (1003, "cccc", None, None), (1004, "cccc", None, "http://mixed.example.fr/z"), (1005, "cccc", "xx-yy", "not an address")]
    df = spark.createDataFrame(rows, "doc_id long, text string, tag string, url string")
    got = {r.doc_id: r for r in identify(df, model, declared=F.col("tag"), address=F.col("url")).collect()}
    assert got[1000].language == "fr" and got[1001].language == "de" and got[1003].language == "de"
    assert got[1004].language == "de" and got[1005].language == "de"
    assert got[1002].confidence < got[1001].confidence and got[1002].accepted  # a new host falls back on its suffix


def test_parsers(spark):
    row = spark.createDataFrame([("HTTP://u:p@Www.Example.CO:80/de/?x", "<!doctype html><HTML class=a lang='FR-ca'><script>x<y</script><p>Bon &jour</p>")],
                                "url string, html string").select(
        host_of(F.col("url")), suffix_of(host_of(F.col("url"))), declared_in(F.col("html")), F.trim(visible_text(F.col("html")))).first()
    assert tuple(row) == ("www.example.co", "co", "fr", "Bon &jour")


def test_empty_table_and_no_labels(spark, model):
    schema = "doc_id long, text string, lang string"
    nothing = spark.createDataFrame([], schema)
    assert identify(nothing, model, declared=F.col("lang"), host=F.col("lang")).count() == 0
    unlabelled = spark.createDataFrame([(1, "some text", None)], schema)
    out = identify(unlabelled, fit_text_model(unlabelled, F.col("doc_id"))).first()
    assert (out.language, out.accepted) == ("und", False)


def test_all_languages_are_modelled(spark):
    """40 languages of own letters, the rarest with regional labels, and one with too few rows for a model."""
    word = lambda k: "".join(chr(0x4E00 + 97 * k + j) for j in range(12))
    tags = [f"{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(40)]
    rows = [(k * 100 + j, (word(k) + " ") * 8, tags[k] if k < 39 else f"{tags[k].upper()}-R{j}", "s")
            for k in range(40) for j in range(10 if k < 39 else 6)]
    rows += [(9000, "zqxj vkqz xxqj wvzk qqzx jjvw zzkq " * 5, "zz", "s"), (9001, "123 !!", "zz", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = fit_text_model(df, F.col("doc_id"))
    assert model.languages == tuple(sorted(tags))
    got = {r.doc_id: r for r in identify(df, model, declared=F.col("lang"), host=F.col("source")).collect()}
    assert all(r.accepted and r.language == tags[i // 100] for i, r in got.items() if i < 9000)
    assert got[9000].accepted and got[9000].language == "zz" and not got[9001].accepted
