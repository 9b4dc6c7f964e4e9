"""Near duplicates against brute force, and the signature's properties."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from termwell.llm.common import shingle_hashes, word_hashes
from termwell.llm.minhash import (
    COUNTERS,
    block_links,
    connected,
    near_duplicates,
    prob_minhash,
    probability_jaccard,
    rare_prefix,
    shared_weights,
    weighted_shingles,
)


def plain_similarity(a, b):
    """Probability Jaccard by its definition, on counters."""
    if not a or not b:
        return float(not a and not b)
    both = set(a) | set(b)
    return sum(1.0 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in both) for d in a if d in b)


def plain_shingles(text):
    words = (text or "").split()
    size = min(5, len(words))
    return Counter(tuple(words[k:k + size]) for k in range(len(words) - size + 1)) if words else Counter()


def plain_classes(rows):
    sets = [plain_shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (sets[i].keys() & sets[j].keys() or not sets[i] and not sets[j]) and plain_similarity(sets[i], sets[j]) >= 0.8:
                parent[top(i)] = top(j)
    smallest = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            smallest[top(k)] = min(smallest.get(top(k), i), i)
    return Counter((rows[k][0], smallest.get(top(k))) for k in range(len(rows)))


def test_exact_similarity_matches_definition():
    rng = random.Random(1)
    for _ in range(200):
        a, b = (Counter({rng.randrange(30): rng.randrange(1, 6) for _ in range(rng.randrange(0, 25))}) for _ in range(2))
        pack = lambda c: (np.array(sorted(c), np.uint64), np.array([c[k] for k in sorted(c)], np.int32))
        assert probability_jaccard(pack(a), pack(b)) == pytest.approx(plain_similarity(a, b))


def test_signature_estimates_similarity():
    rng = random.Random(2)
    a = {k * 7919 + 13: rng.randrange(1, 5) for k in range(400)}
    for kept, change in ((0.95, 0.9), (0.7, 0.5), (0.3, 1.0)):
        b = {k: (v if rng.random() < change else v + 3) for k, v in a.items() if rng.random() < kept}
        pack = lambda c: (np.array(sorted(c), np.uint64), np.array([c[k] for k in sorted(c)]))
        agree = np.mean(prob_minhash(*pack(a), 4096) == prob_minhash(*pack(b), 4096))
        assert abs(agree - plain_similarity(a, b)) < 0.04


def test_signature_does_not_depend_on_scale_or_horizon():
    items, weights = np.arange(1, 50, dtype=np.uint64), np.arange(1, 50)
    assert len(set(prob_minhash(np.array([9], np.uint64), np.array([3])).tolist())) == 1
    # Parts that no arrival hits below a short horizon are filled by later ones.
    few = prob_minhash(np.array([3, 4], np.uint64), np.array([1, 10 ** 6]), 512)
    assert set(few.tolist()) <= {3, 4} and (few == 4).mean() > 0.99


def test_word_and_shingle_hashes():
    a, b = word_hashes("one two  three\tfour\nfive six"), word_hashes("x one two three four five six é")
    assert (a == b[1:7]).all() and len(set(b.tolist())) == 8
    assert (shingle_hashes(a, 5) == shingle_hashes(b, 5)[1:3]).all()
    assert len(shingle_hashes(a[:3], 5)) == 1 and len(word_hashes(None)) == len(word_hashes(" \n")) == 0


def edited(rng, words, changes):
    words = list(words)
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"new{rng.random()}"
    return words


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    for g in range(40):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(20, 80))]
        for _ in range(rng.randrange(1, 6)):
            out.append(" ".join(edited(rng, base, rng.randrange(0, 8))))
    base = [f"v{rng.randrange(4000)}" for _ in range(90)]
    out += [" ".join(edited(rng, base, rng.randrange(1, 3))) for _ in range(50)]  # one large group of near copies
    out += ["exact copy of a text that many share"] * 30
    passage = [f"p{k}" for k in range(40)]
    out += [" ".join(passage + [f"own{rng.random()}" for _ in range(40)]) for _ in range(25)]  # a shared passage, not near
    out += ["one two", "one two", "one", "", None, "  \n", "a a a a a a a a a a a a a b", "a a a a a a a a a a a a a c",
            " ".join(f"long{k}" for k in range(300)), " ".join(f"long{k}" for k in range(1, 301))]
    rng.shuffle(out)
    rows = list(enumerate(out))
    return rows + [rows[5], rows[5], (None, "no id here at all but words"), (None, out[7])]


def test_classes_match_brute_force(spark, rows):
    df = spark.createDataFrame([(i, t, 1, "k", "x") for i, t in rows], "doc_id long, text string, rep int, bucket string, bands string")
    got = Counter(tuple(r) for r in near_duplicates(df).collect())
    assert got == plain_classes(rows)


def test_very_long_texts(spark):
    long = [f"w{k}" for k in range(60000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[5:])), (3, " ".join(long[30000:])), (4, "a " * 60000), (5, "a " * 59000)]
    got = dict(tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}


def test_empty_and_single(spark):
    schema = "doc_id long, text string"
    assert near_duplicates(spark.createDataFrame([], schema)).count() == 0
    assert [tuple(r) for r in near_duplicates(spark.createDataFrame([(4, "a b c d e f")], schema)).collect()] == [(4, 4)]


def test_connected_components(spark):
    chain = [(k, k + 1) for k in range(60)] + [(100, 101), (101, 102), (102, 100)]
    got = dict(tuple(r) for r in connected(spark.createDataFrame(chain, "a long, b long")).collect())
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 101: 100, 102: 100}


def test_rare_prefixes_meet():
    """Two similar sets share a shingle of their prefixes at which the bound holds, whatever the counters."""
    rng = np.random.default_rng(6)
    met = 0
    for _ in range(300):
        a = {int(k): int(v) for k, v in zip(rng.choice(10 ** 6, 60, replace=False), rng.integers(1, 4, 60), strict=True)}
        b = {**{k: v + int(rng.random() < 0.1) for k, v in a.items() if rng.random() < 0.95},
             **{int(k): 1 for k in rng.choice(10 ** 6, rng.integers(0, 8), replace=False)}}
        pack = lambda c: (np.array(sorted(c), np.uint32), np.array([c[k] for k in sorted(c)], np.int32))
        counts = rng.integers(2, 9, COUNTERS)
        one, other = (dict(zip(*(x.tolist() for x in rare_prefix(*pack(c), counts)), strict=True)) for c in (a, b))
        near = any(1 / (1 - one[k]) + 1 / (1 - other[k]) <= 2.25 + 1e-9 for k in one.keys() & other.keys())
        if probability_jaccard(pack(a), pack(b)) >= 0.8:
            met += 1
            assert near
    assert met > 50


def test_large_buckets_are_searched_whole(spark, rows, monkeypatch):
    """Every bucket counts as large, and the random rounds, which may miss any pair, find none."""
    import termwell.llm.minhash as module

    for name, value in (("MIDDLE_BUCKET", 1), ("RANDOM_ROUNDS", 0)):
        monkeypatch.setattr(module, name, value)
    df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
    assert Counter(tuple(r) for r in near_duplicates(df).collect()) == plain_classes(rows)


def test_small_cells_are_searched_whole(spark, rows, monkeypatch):
    """As above, with blocks of a few sets and matrices of a few shingles."""
    import termwell.llm.minhash as module

    for name, value in (("MIDDLE_BUCKET", 1), ("RANDOM_ROUNDS", 0), ("BLOCK_ROWS", 3), ("MATRIX_ITEMS", 7), ("FEW_PAIRS", 2)):
        monkeypatch.setattr(module, name, value)
    df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
    assert Counter(tuple(r) for r in near_duplicates(df).collect()) == plain_classes(rows)


def some_sets(rng, n, most):
    out = []
    for _ in range(n):
        items = np.sort(rng.choice(60, rng.integers(1, 40), replace=False)).astype(np.uint32)
        out.append((items, rng.integers(1, most + 1, len(items)).astype(np.int32)))
    return out


def test_shared_weights(monkeypatch):
    import termwell.llm.minhash as module

    rng = np.random.default_rng(7)
    for few, width, most in ((0, 5, 1), (16, 4, 3), (10 ** 6, 9, 2), (40, 1000, 1)):
        monkeypatch.setattr(module, "FEW_PAIRS", few)
        monkeypatch.setattr(module, "MATRIX_ITEMS", width)
        left, right = some_sets(rng, 9, most), some_sets(rng, 14, most)
        mine, theirs = shared_weights(left, right)
        for i, a in enumerate(left):
            for j, b in enumerate(right):
                assert mine[i, j] == a[1][np.isin(a[0], b[0])].sum() and theirs[i, j] == b[1][np.isin(b[0], a[0])].sum()
    apart = [(np.array([k], np.uint32), np.ones(1, np.int32)) for k in range(2)]
    assert [x.tolist() for x in shared_weights(apart[:1], apart[1:])] == [[[0.0]], [[0.0]]]


def test_block_links_join_the_classes_that_are_linked():
    rng = np.random.default_rng(8)
    base = some_sets(rng, 6, 2)
    sets = [(a[0][kept], a[1][kept]) for a in base for _ in range(5) for kept in [rng.random(len(a[0])) < 0.95] if kept.any()]
    block, of = rng.integers(0, 2, len(sets)), rng.integers(0, 20, len(sets))

    def joined(links):
        parent = {int(c): int(c) for c in of}

        def top(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in links:
            parent[top(int(of[a]))] = top(int(of[b]))
        groups = {}
        for c in parent:
            groups.setdefault(top(c), set()).add(c)
        return sorted(map(sorted, groups.values()))

    for lo, hi in ((0, 1), (0, 0)):
        there = [k for k in range(len(sets)) if block[k] in (lo, hi)]
        table = pa.table({
            "block": block[there], "lo": np.full(len(there), lo), "hi": np.full(len(there), hi), "rep": np.array(there), "class": of[there],
            "items": pa.array([sets[k][0].tobytes() for k in there], pa.binary()), "counts": pa.array([sets[k][1].tobytes() for k in there], pa.binary())})
        links = list(zip(*(block_links(table).column(c).to_pylist() for c in "ab"), strict=True))
        every = [(i, j) for i in there for j in there if block[i] == lo and block[j] == hi and of[i] != of[j]
                 and probability_jaccard(sets[i], sets[j]) >= 0.8]
        assert joined(links) == joined(every) and 0 < len(links) < len(set(of.tolist())) and set(links) <= {tuple(sorted(p)) for p in every}


def test_pairs_of_a_large_group_are_no_rows(spark, monkeypatch):
    """Texts just below the threshold that share rare shingles: their pairs, a square of the group, are no rows."""
    import termwell.llm.minhash as module

    stored, tables = module.stored, {}

    def counting(df, label):
        out = stored(df, label)
        tables[label] = tables.get(label, 0) + out.count()
        return out

    monkeypatch.setattr(module, "stored", counting)
    monkeypatch.setattr(module, "RANDOM_ROUNDS", 0)
    monkeypatch.setattr(module, "MIDDLE_BUCKET", 0)
    rng, n, base, texts = random.Random(9), 200, [f"w{k}" for k in range(100)], []
    for _ in range(n):
        places = rng.sample(range(7, 100, 14), 3)  # of seven, each edited in one of two ways
        texts.append(" ".join(f"{w}{rng.choice('xy')}" if k in places else w for k, w in enumerate(base)) + f" own{rng.random()}")
    found = near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    sets, classes = [weighted_shingles(word_hashes(t)) for t in texts], list(range(n))
    for i in range(n):
        for j in range(i):
            if classes[i] != classes[j] and probability_jaccard(sets[i], sets[j]) >= 0.8:
                classes = [min(classes[i], classes[j]) if c in (classes[i], classes[j]) else c for c in classes]
    assert dict(tuple(r) for r in found.collect()) == dict(enumerate(classes)) and 3 < len(set(classes)) < n
    assert tables["pairs"] <= 16 * n and tables["close"] <= 16 * n, tables
