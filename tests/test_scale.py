"""Operators whose groups may be of any size, against brute force with hot groups."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from termwell.operators import bm25, joins, querylog, scan, traces, vectors


def random_rows(n, seed=1, hot=0.5):
    rng = random.Random(seed)
    return [("hot" if rng.random() < hot else f"k{rng.randrange(5)}", rng.randrange(1000), i, rng.randrange(10)) for i in range(n)]


def test_running_sums_cross_slices(spark):
    rows = random_rows(500)
    frame = spark.createDataFrame(rows, "g string, t long, id long, v long").repartition(5)
    out = scan.running(frame, ["g"], ["t", "id"], {"s": ("sum", F.col("v")), "m": ("max", F.col("v"))}, totals=True).collect()
    expected = {}
    for group in {r[0] for r in rows}:
        members = sorted((r for r in rows if r[0] == group), key=lambda r: (r[1], r[2]))
        for i, r in enumerate(members):
            expected[r[2]] = (sum(x[3] for x in members[:i + 1]), max(x[3] for x in members[:i + 1]), sum(x[3] for x in members))
    assert {r["id"]: (r["s"], r["m"], r["s_total"]) for r in out} == expected


def test_previous_row(spark):
    rows = random_rows(300, 2)
    frame = spark.createDataFrame(rows, "g string, t long, id long, v long")
    out = {r["id"]: (r["prev_t"], r["prev_v"]) for r in scan.previous(frame, ["g"], ["t", "id"], ["t", "v"]).collect()}
    expected = {}
    for group in {r[0] for r in rows}:
        members = sorted((r for r in rows if r[0] == group), key=lambda r: (r[1], r[2]))
        for before, r in zip([None, *members], members):
            expected[r[2]] = (before[1], before[3]) if before else (None, None)
    assert out == expected


def test_descending_numbers(spark):
    rows = random_rows(200, 3)
    frame = spark.createDataFrame(rows, "g string, t long, id long, v long")
    out = {r["id"]: r["n"] for r in scan.numbered(frame, ["g"], [F.desc("v"), F.asc("id")], "n").collect()}
    for group in {r[0] for r in rows}:
        members = sorted((r for r in rows if r[0] == group), key=lambda r: (-r[3], r[2]))
        assert [out[r[2]] for r in members] == list(range(1, len(members) + 1))


def test_null_groups_are_groups(spark):
    frame = spark.createDataFrame([(None, 1), ("a", 2), (None, 3)], "g string, id long")
    out = {r["id"]: r["n"] for r in scan.numbered(frame, ["g"], ["id"], "n").collect()}
    assert out == {1: 1, 2: 1, 3: 2}


def chain(times, ttl):
    anchors = []
    for t in sorted(times):
        if not anchors or t >= anchors[-1] + ttl:
            anchors.append(t)
    return anchors


@pytest.mark.parametrize("limit", [10_000, 20])
def test_ttl_anchors(spark, limit):
    """With a limit of 20 times per key the hot keys are walked slice by slice."""
    rows = random_rows(600, 4)
    frame = spark.createDataFrame(rows, "g string, t long, id long, v long")
    out = sorted((r["g"], r["anchor"]) for r in querylog.ttl_anchors(frame, "g", F.col("t"), 37, limit).collect())
    assert out == sorted((g, a) for g in {r[0] for r in rows} for a in chain([r[1] for r in rows if r[0] == g], 37))


@pytest.mark.parametrize("limit", [10_000, 5])
def test_breaker(spark, limit):
    rng = random.Random(5)
    calls = [("a" if rng.random() < 0.7 else "b", 100 * i + rng.randrange(50), i, rng.random() < 0.75) for i in range(400)]
    frame = spark.createDataFrame(calls, "agent string, s long, call_id long, failed boolean").withColumn("ts", F.timestamp_seconds("s"))
    out = {r["call_id"]: r["state"] for r in traces.breaker_states(frame, recovery_s=900, group_rows=limit).collect()}
    expected = {}
    for agent in "ab":
        state, failures, wins, opened = "closed", 0, 0, 0
        for _, s, i, failed in sorted(c for c in calls if c[0] == agent):
            if state == "open" and s - opened >= 900:
                state, wins = "half_open", 0
            if failed:
                failures, wins = failures + 1, 0
                if state != "open" and failures >= 5:
                    state, opened = "open", s
            else:
                failures, wins = 0, wins + 1
                if state == "half_open" and wins >= 2:
                    state = "closed"
            expected[i] = state
    assert out == expected
    assert {"open", "half_open", "closed"} <= set(out.values())


def test_failure_runs_follow_the_example(spark):
    calls = [("x", i, i, f == "F") for i, f in enumerate("FFFFFSF")]
    frame = spark.createDataFrame(calls, "agent string, s long, call_id long, failed boolean").withColumn("ts", F.timestamp_seconds("s"))
    out = sorted((r["failures"], r["flagged"]) for r in traces.failure_runs(frame).collect())
    assert out == [(1, False), (5, True)]


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


@pytest.mark.parametrize("seed", [6, 7])
def test_near_duplicates_by_brute_force(spark, seed):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(40)}" for _ in range(rng.randrange(1, 14))] for _ in range(12)]
    log = []
    for i in range(160):
        words = list(rng.choice(base)) if rng.random() < 0.6 else list(base[0])
        if rng.random() < 0.5 and words:
            words[rng.randrange(len(words))] = f"w{rng.randrange(40)}"
        log.append((i, rng.randrange(400), " ".join(words)))
    frame = spark.createDataFrame(log, "query_id long, s long, text string").withColumn("ts", F.timestamp_seconds("s"))
    ttl = 50
    out = {r["query_id"]: (r["match_id"], r["similarity"]) for r in querylog.near_dup_queries(frame, ttl=ttl * 1_000_000).collect()}
    first = {}
    for i, _, text in log:
        first.setdefault(frozenset(text.split()), i)
    expected = {}
    for i, s, text in log:
        words, found = frozenset(text.split()), []
        for j, other_s, other in log:
            if (other_s, j) < (s, i) and other_s > s - ttl:
                similarity = jaccard(words, frozenset(other.split()))
                if similarity >= 0.8:
                    found.append((-similarity, first[frozenset(other.split())]))
        if found:
            best = min(found)
            expected[i] = (best[1], round(-best[0], 6))
    assert out == expected


def test_hot_keys_in_lookup_join(spark):
    facts = spark.createDataFrame([("hot" if i % 2 else f"k{i % 7}", i) for i in range(400)], "k string, i long")
    lookup = spark.createDataFrame([("hot", 1), ("k0", 2), ("k2", 3)], "k string, v long")
    plain = sorted(map(tuple, facts.join(lookup, ["k"], "left").collect()), key=str)
    split = sorted(map(tuple, joins.lookup_join(facts, lookup, ["k"], "left", hot_min_rows=50).collect()), key=str)
    assert split == plain


def chunks_frame(spark, texts):
    rows = [(i, f"n{i % 3}", "overview", "Asia", "c", [], text) for i, text in enumerate(texts)]
    return spark.createDataFrame(rows, "chunk_id long, name string, section string, region string, category string, tags array<string>, text string")


def test_query_blocks_give_the_same_hits(spark):
    rng = random.Random(8)
    texts = [" ".join(f"t{rng.randrange(30)}" for _ in range(rng.randrange(0, 20))) for _ in range(60)]
    index = bm25.build_index(chunks_frame(spark, texts))
    queries = spark.createDataFrame([(q, f"t{q} t{q + 1} t1 t1") for q in range(12)], "query_id long, text string")
    whole = sorted(map(tuple, bm25.bm25_topk(index, queries).collect()))
    blocks = sorted(map(tuple, bm25.bm25_topk(index, queries, block_rows=5).collect()))
    assert whole == blocks and whole


def test_bm25_by_hand(spark):
    texts = ["alpha beta beta", "alpha gamma", "delta", ""]
    chunks = chunks_frame(spark, texts)
    index = bm25.build_index(chunks)
    query = spark.createDataFrame([(1, "Alpha alpha beta zeta"), (2, "")], "query_id long, text string")
    docs = [f"n{i % 3} n{i % 3} overview asia c {t}".split() for i, t in enumerate(texts)]
    avgdl = sum(map(len, docs)) / len(docs)

    def score(doc):
        total = 0.0
        for token in ["alpha", "alpha", "beta", "zeta"]:
            df = sum(token in d for d in docs)
            tf = doc.count(token)
            if tf:
                idf = np.log((len(docs) - df + 0.5) / (df + 0.5) + 1)
                total += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(doc) / avgdl))
        return total

    hits = {r["chunk_id"]: r for r in bm25.bm25_topk(index, query).collect()}
    expected = {i: score(d) for i, d in enumerate(docs) if score(d) >= 0.01}
    assert set(hits) == set(expected)
    for i, r in hits.items():
        assert r["score"] == pytest.approx(expected[i], abs=1e-6)
        assert r["norm_score"] == pytest.approx(expected[i] / max(expected.values()), abs=1e-4)


def test_added_index_equals_rebuild(spark):
    texts = [f"a b{i} c{i % 4}" for i in range(20)]
    chunks = chunks_frame(spark, texts)
    whole = bm25.build_index(chunks)
    grown = bm25.add_to_index(bm25.build_index(chunks.filter("chunk_id < 8")), chunks)
    for part in ("postings", "doc_len", "term_df", "stats"):
        columns = getattr(whole, part).columns
        assert sorted(map(tuple, getattr(whole, part).select(columns).collect())) == sorted(
            map(tuple, getattr(grown, part).select(columns).collect())
        )


def test_index_survives_storage(spark, tmp_path):
    chunks = chunks_frame(spark, [f"a b{i}" for i in range(9)])
    index = bm25.build_index(chunks)
    bm25.write_index(index, str(tmp_path / "index"))
    queries = spark.createDataFrame([(1, "a b3")], "query_id long, text string")
    stored = bm25.read_index(spark, str(tmp_path / "index"))
    assert sorted(map(tuple, bm25.bm25_topk(stored, queries).collect())) == sorted(map(tuple, bm25.bm25_topk(index, queries).collect()))


def test_dense_blocks_and_ties(spark):
    rng = np.random.default_rng(9)
    matrix = rng.integers(-2, 3, size=(50, 6)).astype(float)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(matrix)]
    stored = spark.createDataFrame(rows, "chunk_id long, v array<double>").repartition(4)
    asked = spark.createDataFrame(rows, "query_id long, v array<double>")
    whole = sorted(map(tuple, vectors.dense_topk(stored, asked, 5).collect()))
    blocks = sorted(map(tuple, vectors.dense_topk(stored, asked, 5, rows=10).collect()))
    unit = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-9)
    cosine = np.round(unit @ unit.T, 6)
    expected = []
    for q in range(50):
        order = sorted(range(50), key=lambda c: (-cosine[q, c], c))[:5]
        expected += [(q, c, n + 1) for n, c in enumerate(order)]
    assert [(r[0], r[1], r[3]) for r in sorted(whole, key=lambda r: (r[0], r[3]))] == expected
    assert whole == blocks


def test_fusion_values(spark):
    a = spark.createDataFrame([("q", "x", 1), ("q", "y", 2)], "query_id string, chunk_id string, rank int")
    b = spark.createDataFrame([("q", "x", 1)], "query_id string, chunk_id string, rank int")
    out = {r["chunk_id"]: r["score"] for r in vectors.rrf_merge([a, b]).collect()}
    assert out["x"] == pytest.approx(2 / 61, abs=1e-9) and out["y"] == pytest.approx(1 / 62, abs=1e-9)
