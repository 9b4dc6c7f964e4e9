"""The stored index of segments, exact dense search by cells, and scores of given pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from termwell.operators import bm25, segments, vectors
from termwell.session import run_dir

CHUNK = "chunk_id long, name string, section string, region string, category string, tags array<string>, text string"


def made_chunks(spark, count, seed=1, common="the of and to in is"):
    """Texts of very common words, each with some that few others hold; lengths differ widely."""
    rng = random.Random(seed)
    rows = []
    for i in range(count):
        words = [rng.choice(common.split()) for _ in range(rng.choice([5, 20, 200]))] + [f"r{rng.randrange(count // 3)}" for _ in range(rng.randrange(1, 6))]
        rng.shuffle(words)
        rows.append((i, f"n{i % 7}", "overview", "Asia", "c", [], " ".join(words)))
    return spark.createDataFrame(rows, CHUNK)


def made_queries(spark, count, seed=2, ids=300):
    rng = random.Random(seed)
    return spark.createDataFrame([(q, " ".join(["the", "of"] + [f"r{rng.randrange(ids)}" for _ in range(rng.randrange(4))])) for q in range(count)],
                                 "query_id long, text string")


def hits(df):
    return sorted((r.query_id, r["rank"], r.chunk_id, r.score, r.norm_score) for r in df.collect())


@pytest.fixture(scope="module")
def grown(spark):
    """Seven additions, ids repeated across and inside of them, merged after each."""
    chunks = made_chunks(spark, 1200)
    index = segments.open_index(spark, run_dir(spark, "test-segments"))
    seen = []
    for low in range(0, 1200, 180):
        part = chunks.filter(F.col("chunk_id").between(low - 30, low + 179))
        index = segments.merge(segments.add(index, part.union(part), buckets=4), fanout=3)
        seen.append(len(index.segments))
    return chunks, index, seen


def test_segments_equal_one_index(spark, grown):
    chunks, index, seen = grown
    assert max(seen) < 5 and index.n_docs == 1200 and len(index.segments) < 7
    whole = bm25.build_index(chunks)
    assert abs(index.avgdl - whole.stats.first()["avgdl"]) < 1e-9
    expected = whole.postings.join(whole.term_df, "term").select("chunk_id", "term", "tf", "dl", "df")
    assert sorted(map(tuple, segments.stored_postings(index).collect())) == sorted(map(tuple, expected.collect()))


def test_segment_search_is_exact(spark, grown):
    chunks, index, _ = grown
    whole = bm25.build_index(chunks)
    queries = made_queries(spark, 60, ids=400).union(spark.createDataFrame([(100, ""), (101, None), (102, "nothing known"), (103, "the"), (104, "the the of")], "query_id long, text string"))
    for k in (1, 8):
        assert hits(segments.topk(index, queries, k)) == hits(bm25.bm25_topk(whole, queries, k))
    again = segments.open_index(spark, index.path)
    assert again == index and hits(segments.topk(again, queries, 3)) == hits(bm25.bm25_topk(whole, queries, 3))


def test_bounds_spare_postings(spark, grown):
    """Queries of common words with a rare one: less than half of the matching postings are read."""
    chunks, index, _ = grown
    queries = made_queries(spark, 40, seed=5, ids=400).filter(F.size(F.split("text", " ")) > 2)
    terms = segments.weighted_terms(index, queries)
    seeds, _, more = segments.blocks_to_score(index, terms, 3)
    read = segments.matched(index, seeds.union(more), terms).count()
    whole = bm25.build_index(chunks)
    everything = whole.postings.join(bm25.query_terms(queries), "term").count()
    assert 0 < read < everything / 2


def scan_paths(df, table):
    """The operators above each scan of a table, from the scan to the first join."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    paths = []
    for at, line in enumerate(lines):
        if "Scan parquet" in line and f"_{table}" in line:
            depth, path = len(line) - len(line.lstrip(" :+-*")), [line]
            for above in reversed(lines[:at]):
                own = len(above) - len(above.lstrip(" :+-*"))
                if own < depth:
                    depth = own
                    path.append(above)
                    if "Join" in above:
                        break
            paths.append(path)
    return paths


def test_reads_move_no_stored_rows(spark, grown):
    """Neither additions nor searches shuffle or broadcast what the index holds."""
    chunks, index, _ = grown
    pairs = spark.createDataFrame([(1, 5)], "query_id long, block long")
    terms = spark.createDataFrame([(1, "the", 1.0)], "query_id long, term string, weight double")
    docs = bm25.doc_tokens(chunks.limit(50)).repartition(4, "chunk_id")
    for df, table in ((segments._scored(index, pairs, terms), "postings"), (segments._promises(index, terms), "bounds"), (segments.absent(index, docs), "docs")):
        paths = scan_paths(df, table)
        assert len(paths) == len(index.segments)
        for path in paths:
            assert "Bucketed: true" in path[0] and "Join" in path[-1]
            assert not any("Exchange" in step for step in path), path


def test_frequent_terms_are_sliced(spark, monkeypatch):
    monkeypatch.setattr(segments, "SLICE_BOUNDS", 3)
    monkeypatch.setattr(segments, "BLOCK_DOCS", 8)
    chunks = made_chunks(spark, 200, seed=9)
    index = segments.add(segments.open_index(spark, run_dir(spark, "test-slices")), chunks, buckets=3)
    assert index.table(index.segments[0], "terms").agg(F.max("slices")).first()[0] > 1
    queries = made_queries(spark, 20, ids=60)
    assert hits(segments.topk(index, queries)) == hits(bm25.bm25_topk(bm25.build_index(chunks), queries))


def test_empty_index(spark):
    index = segments.open_index(spark, run_dir(spark, "test-empty"))
    index = segments.merge(segments.add(index, made_chunks(spark, 3).limit(0)))
    assert index.n_docs == 0 and segments.topk(index, made_queries(spark, 3)).count() == 0
    rows = [(5, None, None, None, None, None, None), (6, "", "", "", "", [], "one word")]
    index = segments.add(index, spark.createDataFrame(rows, CHUNK))
    assert index.n_docs == 2
    query = spark.createDataFrame([("q", "word")], "query_id string, text string")
    assert [r.chunk_id for r in segments.topk(index, query).collect()] == [6]


def test_given_pairs(spark):
    chunks, queries = made_chunks(spark, 90, seed=4), made_queries(spark, 15, ids=30)
    index = bm25.build_index(chunks)
    pairs = spark.createDataFrame([(q, c) for q in range(15) for c in range(q, 90, 7)] + [(3, 10), (3, 999), (77, 1)], "query_id long, chunk_id long")
    scores = {(r.query_id, r.chunk_id): r.score for r in bm25.bm25_scores(index, queries).collect()}
    expected = {p: scores[p] for p in map(tuple, pairs.collect()) if p in scores}
    found = bm25.score_pairs(index, queries, pairs).collect()
    assert {(r.query_id, r.chunk_id): r.score for r in found} == expected and len(found) == len(expected)


def test_hot_terms_in_hashed_parts(spark, monkeypatch):
    monkeypatch.setattr(bm25, "HOT_POSTINGS", 20)
    chunks, queries = made_chunks(spark, 150, seed=6), made_queries(spark, 25, ids=50)
    index = bm25.build_index(chunks)
    assert hits(bm25.bm25_topk(index, queries, block_rows=3)) == hits(bm25.bm25_topk(index, queries))


def plain_nearest(stored, asked, k):
    def unit(rows):
        matrix = np.array([v for _, v in rows], float)
        lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
        return matrix / np.where(lengths == 0, 1e-9, lengths)

    cosine = np.round(unit(asked) @ unit(stored).T, 6)
    return sorted((q, n, stored[c][0]) for row, (q, _) in enumerate(asked) for n, c in enumerate(
        sorted(range(len(stored)), key=lambda c: (-cosine[row, c], stored[c][0]))[:k], 1))


def clustered(count, clusters, seed, spread=0.05, dim=12):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((clusters, dim))
    owner = np.where(rng.random(count) < 0.35, 0, rng.integers(0, clusters, count))  # one cluster holds a third
    return [(i, [float(x) for x in v]) for i, v in enumerate(centres[owner] + spread * rng.standard_normal((count, dim)))]


@pytest.mark.parametrize("cell_rows", [20, 10_000])
def test_cells_are_exact(spark, cell_rows, monkeypatch):
    monkeypatch.setattr(vectors, "SLICE_ROWS", 50)
    rows = clustered(600, 25, 1) + [(1000, [0.0] * 12), (1001, [0.0] * 12), (1002, [1.0] + [0.0] * 11)] + [(2000 + i, [3.0] * 12) for i in range(9)]
    asked = rows[::7] + [(5000, [0.0] * 12), (5001, [-1.0] * 12)]
    stored = spark.createDataFrame([*rows, (7, None)][::-1], "chunk_id long, v array<double>").repartition(3)
    queries = spark.createDataFrame([*asked, (9, None)], "query_id long, v array<double>")
    for k in (1, 5):
        found = sorted((r.query_id, r["rank"], r.chunk_id) for r in vectors.dense_topk(stored, queries, k, rows=40, cell_rows=cell_rows).collect())
        assert found == plain_nearest(rows, asked, k)


def test_cells_spare_products(spark):
    """On clustered vectors far fewer products than queries times vectors."""
    rows = clustered(3000, 40, 3)
    stored = spark.createDataFrame(rows, "chunk_id long, v array<float>").repartition(4)
    queries = spark.createDataFrame(rows[::10], "query_id long, v array<float>")
    placed, found, more, cells = vectors.dense_views(stored, queries, 5, cell_rows=60)
    first = vectors.durable(vectors._views(queries, cells, 5)).filter("first")
    seen = first.select("cell").unionByName(more.select("cell")).groupBy("cell").count().collect()
    products = sum(int(cells.counts[r["cell"]]) * r["count"] for r in seen)
    assert products < 0.5 * 300 * 3000


def test_text_ids_and_empty_sides(spark):
    stored = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.0, 1.0])], "chunk_id string, v array<double>")
    asked = spark.createDataFrame([("q", [2.0, 0.1])], "query_id string, v array<double>")
    assert [r.chunk_id for r in vectors.dense_topk(stored, asked, 2).orderBy("rank").collect()] == ["a", "b"]
    assert vectors.dense_topk(stored.limit(0), asked, 2).count() == 0 and vectors.dense_topk(stored, asked.limit(0), 2).count() == 0
