"""Phrases of a language against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from termwell.llm.collocations import Words, _packed, _stretches, collocations, phrase_counts


def pieces(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall(r"[^\x20\x09]+", piece) for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower)]


def plain_counts(rows, longest=3):
    counts = {}
    for lang, text in rows:
        of = counts.setdefault("und" if lang is None else lang, Counter())
        for words in pieces(text):
            for size in range(1, longest + 1):
                of.update(tuple(words[k:k + size]) for k in range(len(words) - size + 1))
    return counts


def plain_collocations(rows, longest=3, least=10, absorbed=50, top=2000):
    out = []
    for lang, f in plain_counts(rows, longest).items():
        n = sum(v for p, v in f.items() if len(p) == 1)
        scored = []
        for p, a in f.items():
            if len(p) < 2 or a < least:
                continue
            if any(len(q) > len(p) and b >= least and 100 * b >= absorbed * a and any(
                    q[k:k + len(p)] == p for k in range(len(q) - len(p) + 1)) for q, b in f.items()):
                continue
            score, k = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), " ".join(p), f[p[:k]], f[p[k:]]))
        for rank, (score, a, _, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase, -a, left, right, n, -score))
    return sorted(out)


def made(count, seed, words="the a of new york city san jose big Big é ß the the the new york"):
    rng, words = random.Random(seed), words.split()
    out = [("en", None), (None, "x y"), ("en", ""), ("und", "x y"), ("en", "...!?"), ("en", "one"), ("de", "\t \n"),
           ("en", "New York\nCity"), ("fr", " ".join(["mot"] * 500)), ("en", "a\x0bb\x0cc\x1fd e" * 12)]
    for _ in range(count):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n"]) for _ in range(rng.randrange(40)))
        out.append((rng.choice(["en", "en", "de", None]), text))
    return out


def result(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("budget", [20, 200, 1 << 18])
def test_equals_plain_counting(spark, budget):
    rows = made(300, budget)
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "lang string, text string, phrase string, f int").repartition(4)
    assert result(collocations(docs, budget=budget)) == plain_collocations(rows)
    words, phrases = phrase_counts(docs, least=2, budget=budget)
    counts = plain_counts(rows)
    assert {(r.lang, r.phrase): r.f for r in words.collect()} == {(g, p[0]): n for g, f in counts.items() for p, n in f.items() if len(p) == 1}
    found = phrases.collect()
    assert {(r.lang, r.phrase): r.f for r in found} == {
        (g, " ".join(p)): n for g, f in counts.items() for p, n in f.items() if len(p) > 1 and n >= 2}
    assert len(found) == len({(r.lang, r.phrase) for r in found})


def test_longer_phrases_and_ties(spark):
    rows = [("en", "p q r s t " * 12)] * 3 + [("en", f"u{k} v{k}. " * 5) for k in range(6)] + [("en", "a b c d. " * 7)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    for longest, top in ((2, 4), (5, 2000)):
        assert result(collocations(docs, longest=longest, least=5, top=top, budget=10)) == plain_collocations(rows, longest, 5, 50, top)


def test_large_counts_are_exact(spark):
    """Products beyond 64 bits: the same arithmetic on counts written down directly."""
    from pyspark.sql import functions as F

    a, left, right = 3 * 10**12 + 7, 5 * 10**12 + 1, 4 * 10**12 + 3
    wide = [F.lit(v).cast("decimal(19,0)") for v in (a, left, right)]
    square = (wide[0] * wide[0]).cast("decimal(38,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    value = F.call_function("div", square.cast("decimal(38,0)"), (wide[1] * wide[2]).cast("decimal(38,0)"))
    assert spark.range(1).select(value).first()[0] == 10**6 * a * a // (left * right)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "lang string, text string")
    assert result(collocations(docs)) == []
    assert result(collocations(spark.createDataFrame([("en", None), (None, "")], "lang string, text string"))) == []


def test_stretches_keep_pieces_whole():
    texts = ["one two three. four five", "", "six", "seven eight", "nine\nten eleven, twelve", "x" * 50 + " y", "a b c d e f g h"]
    batch = pa.record_batch({"lang": pa.array(["en"] * len(texts)), "text": pa.array(texts)})
    expected = [w for t in texts for w in pieces(t) if w]
    for size in (1, 7, 20, 1000):
        found = []
        for words, lang, names in _stretches([batch], size):
            assert set(lang.tolist()) <= {0} and names == ["en"]
            current = []
            for k in range(len(words)):
                current.append(words.distinct[int(words.codes[k])].as_py().decode())
                if not words.linked[k]:
                    found.append(current)
                    current = []
        assert found == expected


def test_packing_keeps_to_the_budget():
    weights = np.random.default_rng(1).integers(0, 60, 500)
    groups = _packed(weights, 100)
    totals = np.bincount(groups, weights)
    assert totals.max() <= 100 and totals[:-1].min() > 40
    assert len(Words(np.zeros(0, np.uint8), np.zeros(1, np.int64))) == 0
