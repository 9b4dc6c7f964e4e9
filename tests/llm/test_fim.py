"""Fill-in-the-middle samples against plain string cuts."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from termwell.llm.fim import UnitIndex, restored, with_fim


def plain_cut(key, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    n = len(text)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b, c = text[:low], text[low:high], text[high:]
    if h[3] % 100 < 20:
        return n, "spm", low, high - low, f"<S>{c}<P>{a}<M>{b}"
    return n, "psm", low, high - low, f"<P>{a}<S>{c}<M>{b}"


def test_unit_index():
    rng = random.Random(3)
    for size in [0, 1, 2, 7, 8, 9, 63, 64, 65, 500]:
        text = "".join(rng.choice("aé€𝄞\n<") for _ in range(size))
        index = UnitIndex(np.frombuffer(text.encode(), np.uint8))
        ends = np.cumsum([0] + [len(c.encode()) for c in text])
        assert index.end_of(np.arange(size + 1)).tolist() == ends.tolist()
        assert index.units_before(ends).tolist() == list(range(size + 1))


def test_outputs_equal_plain_cuts(spark):
    rng = random.Random(5)
    texts = [None, "", "a", "é", "𝄞", "<P>", "a<S>b", "<<<S", "<M", ">P<", "x" * 300_000, "€uro " * 50_000]
    texts += ["".join(rng.choice("ab é€𝄞<PSM>\n") for _ in range(rng.randrange(60))) for _ in range(400)]
    rows = [(k, t, "other", 7) for k, t in enumerate(texts)] + [(None, "no key at all", "other", 7), (11, texts[11], "again", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, n int").repartition(5)
    out = with_fim(docs, F.col("doc_id")).withColumn("back", restored(F.col("output"), F.col("form")))
    assert out.columns == ["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output", "back"]
    found = out.collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_cut(r.doc_id, r.text)
        assert r.back == (r.text or "")
    assert {r.form for r in found} == {"plain", "psm", "spm"}
    assert with_fim(docs.limit(0), F.col("doc_id")).count() == 0


def test_other_sentinels(spark):
    docs = spark.createDataFrame([(str(k), "some text to cut " * k) for k in range(30)], "name string, body string")
    marks = ("[pre|", "[suf|", "[mid|")
    out = with_fim(docs, F.col("name"), "body", changed=100, suffix_first=100, sentinels=marks)
    rows = out.withColumn("back", restored(F.col("output"), F.col("form"), marks)).collect()
    assert {r.form for r in rows if r.body} == {"spm"} and all(r.back == r.body for r in rows)
    with pytest.raises(ValueError):
        with_fim(docs, F.col("name"), "body", sentinels=("<<", "<a", "b"))
