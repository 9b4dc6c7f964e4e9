"""Quality scores on the held-out fold; licence scans against brute force."""

import random
import zlib

import numpy as np
import pytest

from termwell.llm.licences import TEMPLATES, Automaton, plain_places, scanner, with_licences
from termwell.llm.quality import fit_quality, held_out_fold, op1_quality, with_quality

SF = "/root/testdata/sf0.01"


def auc(scores, labels):
    order = np.argsort(scores)
    ranks = np.empty(len(scores))
    ranks[order] = np.arange(1, len(scores) + 1)
    good = labels == 1
    return (ranks[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())


@pytest.fixture(scope="module")
def scored(spark):
    return op1_quality(spark, SF).collect()


def test_held_out_accuracy(spark, scored):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [r for r in scored if r.held_out and r.doc_id in labels]
    truth = np.array([labels[r.doc_id] for r in held])
    assert len(scored) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in scored)
    assert auc(np.array([r.score for r in held]), truth) > 0.95
    assert np.mean([r.predicted for r in held if labels[r.doc_id]]) > 0.97
    assert np.mean([r.predicted for r in held if not labels[r.doc_id]]) < 0.3
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in scored)


def test_held_out_labels_do_not_matter(spark, scored):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    from pyspark.sql import functions as F

    turned = labels.withColumn("quality", F.when(held_out_fold(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in with_quality(docs, fit_quality(docs, turned)).select("doc_id", "score").collect()}
    assert again == {r.doc_id: r.score for r in scored}


def test_edge_cases(spark):
    docs = spark.createDataFrame([(k, t, 9.0, "x") for k, t in enumerate(
        [None, "", "a", "good words here " * 40000, "é" * 100] + [f"plain text number {k}" for k in range(40)])],
        "doc_id long, text string, score double, share string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(45)] + [(3, 0), (None, 1), (4, None), (5, 7)], "doc_id long, quality int")
    for known in (labels, labels.limit(0), labels.filter("quality = 1")):
        out = with_quality(docs, fit_quality(docs, known)).collect()
        assert len(out) == 45 and all(0 <= r.score <= 1 for r in out)
    assert with_quality(docs.limit(0), fit_quality(docs, labels)).count() == 0
    repeated = docs.union(docs).union(docs)
    assert with_quality(repeated, fit_quality(repeated, labels)).count() == 135


def test_matching_statistics_match_brute_force():
    rng = random.Random(6)
    for _ in range(200):
        sequences = [[rng.randrange(3) for _ in range(rng.randrange(1, 12))] for _ in range(3)]
        automaton, words = Automaton(sequences), [rng.randrange(3) for _ in range(20)]
        ends = lambda x, q=sequences: sorted({(n, i + len(x)) for n, s in enumerate(q) for i in range(len(s) - len(x) + 1) if s[i:i + len(x)] == x})
        for k, (state, size) in enumerate(automaton.statistics(words)):
            assert size == max(n for n in range(k + 2) if n == 0 or ends(words[k + 1 - n:k + 1]))
            assert not size or automaton.ends[state] == ends(words[k + 1 - size:k + 1])


def test_base_places_match_brute_force(spark):
    rng = random.Random(7)
    words = "cc by general public license all rights reserved the mit gnu version licensed under foo é CC-BY".split()
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 40))) for _ in range(400)]
    texts += [None, "", "CC BY", "cc\x7fby", "cc by " * 50000, "All rights reserved. ALL RIGHTS RESERVED"]
    df = spark.createDataFrame([(k, t, "old", 5) for k, t in enumerate(texts)], "doc_id long, text string, labels string, n_words int")
    for r in with_licences(df).collect():
        places = plain_places(texts[r.doc_id])
        assert (r.n_base, r.first_word, r.last_word) == (len(places), *((places[0][0], places[-1][0]) if places else (None, None)))
        assert r.base_labels == ",".join(sorted({label for _, label in places}))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert with_licences(df.limit(0)).count() == 0


def test_templates_are_found_with_gaps_and_edits():
    for label, versions in TEMPLATES.items():
        for text in versions:
            found = scanner().scan(f"Some file. {text} Some code follows.")
            assert label in found["labels"].split(",")
            assert any(s["covered"] > 0.99 for s in found["spans"] if s["label"] == label)
    mit = TEMPLATES["mit"][0]
    assert "mit" in scanner().scan(mit.replace("merge", "combine").replace("persons", "people"))["labels"].split(",")
    assert scanner().scan("the software and the work of the public")["labels"] == ""


def test_everyday_phrases_are_no_licence():
    assert scanner().scan("the film was released under the title of the book")["labels"] == ""
    assert scanner().scan("code licensed under the BSD license")["labels"] == ""
    for text in ("Licensed under the terms of the MIT License.", "it is released under the MIT license", "This project is licensed under the MIT License"):
        assert scanner().scan(text)["labels"] == "mit-notice"
    assert scanner().scan("Licensed under CC BY 4.0")["labels"].split(",")[0] == "cc-by"


def test_training_pieces_are_spread_over_the_text(spark):
    from pyspark.sql import functions as F

    from termwell.llm.common import spread_pieces

    texts = ["", "short", "a" * 80, "".join(chr(97 + k // 100) for k in range(1000))]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "text string")
    for column in (F.col("text"), F.encode("text", "UTF-8")):
        found = [r[0] if isinstance(r[0], str) or r[0] is None else bytes(r[0]).decode() for r in df.select(spread_pieces(column, 80)).collect()]
        assert found[:3] == texts[:3] and found[4] is None
        assert len(found[3]) == 80 and found[3].startswith("a" * 10) and found[3].endswith("j" * 10) and len(set(found[3])) >= 7


def test_templates_from_a_table(spark):
    docs = spark.createDataFrame([(1, "intro: house rules forbid all copying of these pages by anyone. end"), (2, "Licensed under CC BY 4.0"), (3, None)], "doc_id long, text string")
    templates = spark.createDataFrame([("house", "House rules forbid all copying of these pages by anyone"), ("none", None), (None, "x y z"), ("empty", "...")], "label string, template string")
    found = {r.doc_id: (r.labels, r.base_labels) for r in with_licences(docs, templates=templates).collect()}
    assert found == {1: ("house", ""), 2: ("cc-by", "cc-by"), 3: ("", "")}


def test_kin_licences_are_told_apart():
    for label, words in (("lgpl-notice", "Lesser"), ("agpl-notice", "Affero")):
        found = scanner().scan(f"This file is licensed under the GNU {words} General Public License.")["labels"].split(",")
        assert label in found and not {"lgpl-notice", "agpl-notice"} - {label} & set(found)
    by = scanner().scan("This work is licensed under a Creative Commons Attribution 4.0 International License")["labels"]
    assert by == "cc-by"


def test_scores_equal_plain_compression(spark):
    """The score of a text recomputed step by step from the model's dictionaries and weights."""
    import zstandard

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = fit_quality(docs, labels)
    packers = [zstandard.ZstdCompressor(level=3, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(
        content, dict_type=zstandard.DICT_TYPE_RAWCONTENT if raw else zstandard.DICT_TYPE_FULLDICT)) for content, raw in (model.good, model.bad)]
    for r in with_quality(docs, model).limit(40).collect():
        data = (r.text or "").encode()
        if not data:
            assert r.score == model.empty
            continue
        good, bad = (sum(len(p.compress(data[k:k + 512])) for k in range(0, len(data), 512)) for p in packers)
        a, b = np.clip([(bad - good) / max(good, bad), np.log(min(good, bad) / len(data))], model.low, model.high)
        z = model.weights[0] + sum(w * (x - m) / s for w, x, m, s in zip(model.weights[1:], (a, b, b * b), model.mean, model.scale, strict=True))
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-9
