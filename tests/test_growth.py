"""What one task holds and what travels must not grow with the input."""

import random

import pytest
from pyspark.sql import functions as F

from termwell.functions import text as T
from termwell.operators import bm25, segments, vectors
from termwell.operators import ranking as K
from termwell.session import run_dir

CHUNK = "chunk_id long, name string, section string, region string, category string, tags array<string>, text string"


def test_index_parts_follow_the_text(spark, monkeypatch):
    """Adaptive execution may not merge the texts of an index into fewer tasks than their size asks for."""
    monkeypatch.setattr(bm25, "PART_CHARS", 300)
    monkeypatch.setattr(bm25, "PART_TOKENS", 60)
    rows = [(i, "n", "s", "r", "c", [], f"w{i % 9} " * 10) for i in range(300)]
    for chunks in (spark.createDataFrame(rows, CHUNK), spark.createDataFrame(rows + rows, CHUNK)):
        index = bm25.build_index(chunks)
        assert index.postings.rdd.getNumPartitions() >= 9000 // 300
        assert index.doc_len.count() == 300
        grown = bm25.add_to_index(index, chunks.withColumn("chunk_id", F.col("chunk_id") + 1000))
        assert grown.postings.rdd.getNumPartitions() >= 6000 // 60
        assert grown.doc_len.count() == 600


def offered(spark, seed=3):
    """Rows and questions of which some come twice, some without words, some with a null key or field."""
    rng = random.Random(seed)

    def words(most):
        return [f"w{rng.randrange(30)}" for _ in range(rng.randrange(most))]

    listing = [(i % 40 if i % 11 else None, *[words(5) for _ in bm25.FIELD_WEIGHTS]) for i in range(60)]
    listing += [(2, None, *[["w1"]] * 7), (3, *[["w1"]] * 7, None), (4, *[[]] * 8), (44, *[None] * 8)]
    questions = [(q % 12, rng.choice([None, words(12), words(12), ["elsewhere"] * 3])) for q in range(20)] + [(None, ["w1"])]
    offers = sorted({(rng.randrange(14), rng.randrange(45)) for _ in range(200)}) + [(None, 1), (1, None)]
    rows = spark.createDataFrame(listing, "ord long, " + ", ".join(f"{field} array<string>" for field in bm25.FIELD_WEIGHTS))
    return spark.createDataFrame(offers, "query_id long, ord long"), spark.createDataFrame(questions, "query_id long, words array<string>"), rows


def test_offered_scores_equal_plain_ones(spark):
    offers, questions, rows = offered(spark)
    score = bm25.keyword_score(F.col("words"), {field: F.col(field) for field in bm25.FIELD_WEIGHTS})
    plain = offers.join(questions, "query_id").join(rows, "ord").select("query_id", "ord", score.alias("score"))
    found = sorted(map(tuple, bm25.keyword_scores(offers, questions, rows).collect()), key=str)
    scores = {score for _, _, score in found}
    assert found == sorted(map(tuple, plain.collect()), key=str) and {None, 0.0} < scores and len(scores) > 5


def test_no_words_travel_with_offers(spark):
    """An offer carries the numbers of its row's words, and no array of words meets it."""
    plan = bm25.keyword_scores(*offered(spark))._jdf.queryExecution().optimizedPlan()
    attributes = plan.children().apply(0).output().mkString(" ") if plan.children().size() else ""
    kinds = [plan.children().apply(0).output().apply(i).dataType().simpleString() for i in range(plan.children().apply(0).output().size())]
    assert attributes and "array<string>" not in kinds and "array<bigint>" in kinds


@pytest.mark.parametrize("query", ["Medical EXAMS in Asia", "", None])
def test_reasons_take_the_lowered_query(spark, query):
    row = spark.createDataFrame([("Asia", ["India"], "Medical", ["exams"], query, 0.5)],
                                "region string, countries array<string>, category string, tags array<string>, query string, score double")
    fields = {c: F.col(c) for c in ("region", "countries", "category", "tags")}
    args = (fields, F.col("query"), F.col("score"), F.lit("deadline"))
    plain, given = row.select(K.match_reasons(*args), K.match_reasons(*args, F.lower("query"))).first()
    assert plain == given


def test_question_rows_are_numbered_before_their_words(spark):
    """A row must keep one number, or its words would meet those of the listing one by one."""
    offers = spark.createDataFrame([(1, 1)], "query_id long, ord long")
    questions = spark.createDataFrame([(1, "a b c d")], "query_id long, text string").select("query_id", T.tokens(F.col("text")).alias("words"))
    rows = spark.createDataFrame([(1, *[["a", "b"]] * 8)], "ord long, " + ", ".join(f"{f} array<string>" for f in bm25.FIELD_WEIGHTS))
    assert [tuple(r) for r in bm25.keyword_scores(offers, questions, rows).collect()] == [(1, 1, 0.5)]


def test_buckets_follow_the_words(spark, monkeypatch):
    """A segment has more buckets the more words it holds; additions and merges mix segments of different counts."""
    monkeypatch.setattr(segments, "BUCKET_TOKENS", 800)
    chunks = spark.createDataFrame([(i, "n", "s", "r", "c", [], f"w{i % 9} x{i % 50} " * 4) for i in range(600)], CHUNK)
    index = segments.open_index(spark, run_dir(spark, "test-buckets"))
    index = segments.add(index, chunks.filter("chunk_id < 60"), buckets=2)
    index = segments.add(index, chunks.filter("chunk_id BETWEEN 40 AND 399"), buckets=2)
    assert [s.n_docs for s in index.segments] == [60, 340] and index.segments[0].buckets < index.segments[1].buckets
    assert all(s.buckets * 800 >= s.total_len > s.buckets * 800 / 2 or s.buckets == 2 for s in index.segments)
    index = segments.merge(segments.add(index, chunks, buckets=2), fanout=2)
    assert index.n_docs == 600 and all(s.buckets * 800 >= s.total_len for s in index.segments)
    queries = spark.createDataFrame([(1, "w3 x7"), (2, "n x49")], "query_id long, text string")
    whole = bm25.build_index(chunks)
    columns = ["query_id", "chunk_id", "score", "rank", "norm_score"]
    assert sorted(map(tuple, segments.topk(index, queries).select(columns).collect())) == sorted(
        map(tuple, bm25.bm25_topk(whole, queries).select(columns).collect()))
    assert sorted(map(tuple, segments.stored_postings(index).collect())) == sorted(map(tuple, bm25.with_df(whole.postings, whole.term_df).collect()))


def test_counts_of_terms_sort_no_postings(spark):
    """Counts meet postings in hashed parts; a sort would hold all postings of a part."""
    index = bm25.build_index(spark.createDataFrame([(i, "n", "s", "r", "c", [], f"w{i % 9} x") for i in range(40)], CHUNK))
    plan = bm25.with_df(index.postings, index.term_df)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


def test_scores_of_names_carry_no_texts(spark, monkeypatch):
    """Queries and names are numbered for the scores; a pair without a query counts by its name."""
    chunks = spark.createDataFrame([(i, f"src{i % 4}", "s", "r", "c", [], f"w{i % 3} exam") for i in range(30)], CHUNK)
    pairs = spark.createDataFrame([(1, "exam w1", "src1"), (2, "exam w1", "src2"), (3, None, "src3"), (4, "w2", None)], "pair_id long, query string, name string")
    seen, sums = [], bm25._sums_of
    monkeypatch.setattr(bm25, "_sums_of", lambda *a: seen.append(sums(*a)) or seen[-1])
    found = {r.pair_id: r.relevance for r in bm25.name_relevance(bm25.build_index(chunks), chunks, pairs).collect()}
    assert found[1] > 0 and found[2] > 0 and found[3] == 1.0 and found[4] == 0.0
    assert len(seen) == 2 and all(kind in ("bigint", "double") for df in seen for _, kind in df.dtypes)


def test_vectors_travel_once_per_large_cell(spark, monkeypatch):
    """Rows sent to the grid stay within a few per vector, as cells and blocks hold many rows."""
    count = 4000
    assert min(vectors.CELL_ROWS, vectors.QUERY_VECTOR_ROWS, vectors.SLICE_ROWS) >= count
    rows = [(i, [random.Random(i * 31 + j).gauss(0, 1) for j in range(6)]) for i in range(count)]
    stored = spark.createDataFrame(rows, "chunk_id long, v array<double>")
    asked = stored.withColumnRenamed("chunk_id", "query_id")
    _, _, more, cells = vectors.dense_views(stored, asked, 4)
    first = vectors._views(asked, cells, 4, first_only=True)
    assert first.count() + more.count() <= 2 * count
