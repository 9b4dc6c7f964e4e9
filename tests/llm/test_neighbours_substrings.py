"""Nearest neighbours: recall against brute force. Repeated passages: brute force."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from termwell.llm.neighbours import nearest
from termwell.llm.substrings import FMIndex, anchored, repeated_windows, without_repeats
from termwell.llm.common import word_hashes


def plain_nearest(rows, k):
    usable = {(i, tuple(v)) for i, v in rows if i is not None and v is not None and len(v) == 8
              and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for i, v in usable:
        if i % 20 == 0:
            out[i] = sorted((-float(np.dot(v, w)), j) for j, w in usable if j != i)[:k]
    return out


def fetched(spark, rows, **options):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, v string, h1 int")
    out = {}
    for r in nearest(df, F.col("vec_id") % 20 == 0, **options).collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: sorted(hits) for q, hits in out.items()}


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(8)
    rows = [(k, (rng.normal(size=8) * rng.choice([0.1, 1, 3])).astype(np.float32).tolist()) for k in range(3000)]
    rows += [(4000 + k, [1.0, 2.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0]) for k in range(1500)]  # one very common vector
    rows += [(9000, None), (9020, [0.0] * 8), (9040, [1.0, None] + [0.0] * 6), (9060, [float("nan")] + [1.0] * 7),
             (9080, [float("inf")] + [1.0] * 7), (9100, [1.0, 2.0]), (None, [1.0] * 8), rows[40], rows[40]]
    return rows


def test_recall_and_order(spark, vectors):
    want, got = plain_nearest(vectors, 20), fetched(spark, vectors)
    assert got.keys() == want.keys()
    recall = []
    for q, hits in got.items():
        assert [h[0] for h in hits] == list(range(1, 21)) and q not in [h[1] for h in hits]
        scores = dict((j, -s) for s, j in plain_nearest(vectors, 10 ** 6)[q]) if q < 100 else None
        assert [(-s, j) for _, j, s in hits] == sorted((-s, j) for _, j, s in hits)
        if scores:
            assert all(abs(scores[j] - s) < 1e-9 for _, j, s in hits)
        recall.append(len({j for _, j, _ in hits} & {j for _, j in want[q]}) / 20)
    assert np.mean(recall) >= 0.9


def test_few_vectors_and_ties(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 5.0]), (2, [0.5, -5.0]), (3, [0.5, 0.0]), (20, [1.0, 0.0])]
    got = fetched(spark, rows)
    assert [j for _, j, _ in got[0]] == [20, 1, 2, 3] and [j for _, j, _ in got[20]] == [0, 1, 2, 3]
    assert fetched(spark, []) == {} and fetched(spark, [(1, [1.0])]) == {} and fetched(spark, [(20, [1.0])]) == {}


def test_windows_match_brute_force():
    rng = random.Random(9)
    for _ in range(200):
        w = rng.choice([2, 3, 4])
        segments = [[rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(1, 15))] for _ in range(rng.randrange(1, 8))]
        docs, starts = np.array([rng.randrange(4) for _ in segments]), np.array([rng.randrange(5) for _ in segments])
        first = {}
        for g, s in enumerate(segments):
            for k in range(len(s) - w + 1):
                first[tuple(s[k:k + w])] = min(first.get(tuple(s[k:k + w]), (99, 99)), (docs[g], starts[g] + k))
        want = {(g, k) for g, s in enumerate(segments) for k in range(len(s) - w + 1) if first[tuple(s[k:k + w])] < (docs[g], starts[g] + k)}
        assert set(zip(*[x.tolist() for x in repeated_windows(segments, docs, starts, w)], strict=True)) == want


def test_backward_search_counts():
    rng = np.random.default_rng(10)
    for symbols in (2, 5, 300):
        text = rng.integers(1, symbols + 1, 2000).astype(np.int32)
        text[-1] = 0
        index, starts = FMIndex(text), np.arange(0, 1900, 7)
        for size in (1, 3, 20):
            low, high = index.intervals(text, starts, size)
            for s, a, b in zip(starts.tolist(), low.tolist(), high.tolist(), strict=True):
                pattern = text[s:s + size]
                at = [p for p in np.flatnonzero(text == pattern[0]).tolist() if np.array_equal(text[p:p + size], pattern)]
                assert sorted(index.order[a:b].tolist()) == (at if len(at) > 1 else [])


def test_equal_windows_share_an_anchor():
    rng = random.Random(11)
    passage = [f"p{rng.randrange(50)}" for _ in range(80)]
    one = " ".join([f"a{k}" for k in range(30)] + passage + ["z"] * 25)
    two = " ".join(["q"] * 7 + passage + [f"b{k}" for k in range(40)])
    runs = []
    for text in (one, two):
        words, found = text.split(), {}
        for anchor, start, n in zip(*[x.tolist() for x in anchored(word_hashes(text))], strict=True):
            for k in range(start, start + n):
                found.setdefault(tuple(words[k:k + 20]), set()).add(anchor)
        runs.append(found)
    common = runs[0].keys() & runs[1].keys()
    assert len(common) >= 61 and all(runs[0][w] == runs[1][w] for w in common)


def plain_removal(rows, window=20):
    key = lambda i: (i is None, i or 0)
    first = {}
    for i, t in rows:
        words = (t or "").split()
        for k in range(len(words) - window + 1):
            g = " ".join(words[k:k + window])
            first[g] = min(first.get(g, (key(i), k)), (key(i), k))
    out = []
    for i, t in rows:
        words = (t or "").split()
        gone = set()
        for k in range(len(words) - window + 1):
            if first[" ".join(words[k:k + window])] < (key(i), k):
                gone.update(range(k, k + window))
        left = [w for k, w in enumerate(words) if k not in gone]
        out.append((i, len(words), len(gone), hashlib.sha256(" ".join(left).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    word = lambda: rng.choice(["the", "of", "a", "é", "\x00"]) if rng.random() < 0.5 else f"w{rng.randrange(30)}"
    passage = [word() for _ in range(70)]
    out = []
    for _ in range(150):
        words = [word() for _ in range(rng.randrange(0, 90))]
        if rng.random() < 0.5:
            cut = rng.randrange(0, 40)
            words[10:10] = passage[cut:cut + rng.randrange(15, 60)]
        out.append(" ".join(words))
    out += ["one " * 100, "one " * 40, "x y " * 60, "copy of words " * 9] + ["\t".join(passage)] * 20 + [None, "", " \n "]
    out.append(" ".join(f"l{k % 9000}" for k in range(30000)))
    rng.shuffle(out)
    rows = list(enumerate(out))
    return rows + [rows[3], rows[3], (None, " ".join(passage)), (None, " ".join(passage))]


@pytest.mark.parametrize("heavy", [50_000, 3])
def test_removal_matches_brute_force(spark, rows, heavy):
    df = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], "doc_id long, text string, anchor string, n int, spans string")
    got = sorted((tuple(r) for r in without_repeats(df, heavy_above=heavy).collect()), key=str)
    assert got == plain_removal(rows)


def test_empty_removal(spark):
    assert without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert without_repeats(spark.createDataFrame([(1, "a b")], "doc_id long, text string")).first().n_removed == 0


def test_many_ties_go_to_the_smallest_ids(spark):
    """Eighty different vectors of equal product in one leaf."""
    rows = [(k, [1.0, math.cos(k), math.sin(k)]) for k in range(80)] + [(100, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6)
    found = nearest(df, F.col("vec_id") == 100).orderBy("rank").collect()
    assert [r.vec_id for r in found] == list(range(20))
