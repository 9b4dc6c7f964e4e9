"""Index, BM25, dense and hybrid retrieval over documents and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termwell.functions import text as T
from termwell.operators import bm25, freshness, querylog, segments, vectors
from termwell.plans.registry import query
from termwell.plans.tables import AS_OF, ctes, frame, provided
from termwell.session import run_dir

DIM = 64

# The retrieval side in SQL: tokens of the weighted text, lengths, counts, scores.
_TOKENS = """
doc_tokens AS (
  SELECT chunk_id, regexp_extract_all(lower(concat_ws(' ', name, name, section, region, category,
    array_to_string(tags, ' '), array_to_string(tags, ' '), text)), '[a-z0-9]+') AS toks FROM chunks),
doc_len AS (SELECT chunk_id, len(toks) AS dl FROM doc_tokens),
stats AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM doc_len),
postings AS (
  SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(toks) AS term FROM doc_tokens) GROUP BY ALL),
term_df AS (SELECT term, count(*) AS df FROM postings GROUP BY term)"""


def _scores(source: str, name: str = "scores") -> str:
    return f"""
{name}_terms AS (
  SELECT query_id, term, count(*) AS qtf
  FROM (SELECT query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM {source}) GROUP BY ALL),
{name} AS (
  SELECT query_id, chunk_id, round(sum(
    qtf * ln((n_docs - df + 0.5) / (df + 0.5) + 1) * (tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl)))), 6) AS score
  FROM {name}_terms JOIN postings USING (term) JOIN term_df USING (term) JOIN doc_len USING (chunk_id), stats
  GROUP BY ALL)"""


def _best(source: str, k: int, name: str, where: str = "true") -> str:
    return f"""
{name} AS (
  SELECT query_id, chunk_id, score, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM {source} WHERE {where})
  WHERE rank <= {k})"""


def _hits(source: str, name: str = "hits") -> str:
    return f"""
{name} AS (
  SELECT *, round(score / max(score) OVER (PARTITION BY query_id), 4) AS norm_score FROM {source})"""


_INDEX = f"{ctes('chunks', 'queries')}, {_TOKENS}"
_TOPK = f"{_INDEX}, {_scores('queries')}, {_best('scores', 8, 'best', 'score >= 0.01')}, {_hits('best')}"


def _index(spark: SparkSession, sf: str) -> tuple[bm25.Index, DataFrame]:
    chunks = frame(spark, sf, "chunks")
    return bm25.build_index(chunks), chunks


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "queries")


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return provided(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("v"))


def _query_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Every stored vector asks for its neighbours."""
    return _vectors(spark, sf).withColumnRenamed("chunk_id", "query_id")


@query("tokenise", f"{ctes('chunks')}, t AS (SELECT chunk_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM chunks) "
                   "SELECT token, count(*) AS n FROM t GROUP BY token")
def tokenise(spark, sf):
    words = frame(spark, sf, "chunks").select(F.explode(T.tokens(F.col("text"))).alias("token"))
    return words.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query("bm25_index", f"{_INDEX} SELECT chunk_id, term, tf, dl, df FROM postings JOIN doc_len USING (chunk_id) JOIN term_df USING (term)")
def bm25_index(spark, sf):
    index, _ = _index(spark, sf)
    return bm25.with_df(index.postings, index.term_df)


@query("bm25_index_add", f"{_INDEX} SELECT chunk_id, dl, count(*) AS terms, CAST(sum(tf) AS BIGINT) AS tokens, CAST(sum(df) AS BIGINT) AS df_sum "
                         "FROM postings JOIN doc_len USING (chunk_id) JOIN term_df USING (term) GROUP BY ALL")
def bm25_index_add(spark, sf):
    """Documents added language by language, every row twice; segments merged, and the index opened again."""
    return segments.stored_postings(_stored_index(spark, sf)).groupBy("chunk_id", "dl").agg(
        F.count(F.lit(1)).alias("terms"), F.sum("tf").alias("tokens"), F.sum("df").alias("df_sum")
    )


def _stored_index(spark: SparkSession, sf: str) -> segments.SegmentIndex:
    """An index on the shared folder, grown by three additions that overlap."""
    chunks = frame(spark, sf, "chunks")
    first = chunks.filter("region = 'en'")
    index = segments.open_index(spark, run_dir(spark, "index"))
    for part in (first.unionByName(first), chunks.filter("region IN ('en', 'de')"), chunks.unionByName(chunks)):
        index = segments.merge(segments.add(index, part), fanout=2)
        segments.vacuum(index)  # nobody else reads this index
    return segments.open_index(spark, index.path)


@query("segment_topk", f"{_TOPK} SELECT query_id, chunk_id, score, rank, norm_score FROM hits")
def segment_topk(spark, sf):
    """The best documents out of a stored index that grew and was merged."""
    return segments.topk(_stored_index(spark, sf), _asked(spark, sf))


@query("score_pairs", f"""{_INDEX}, {_scores('queries')} SELECT query_id, chunk_id, score FROM scores WHERE query_id = chunk_id % 50""")
def score_pairs(spark, sf):
    """Scores of given pairs only: each document with one query."""
    index, chunks = _index(spark, sf)
    pairs = chunks.select((F.col("chunk_id") % 50).alias("query_id"), "chunk_id")
    return bm25.score_pairs(index, _asked(spark, sf), pairs)


@query("bm25_score", f"{_INDEX}, {_scores('queries')} SELECT query_id, chunk_id, score FROM scores")
def bm25_score(spark, sf):
    return bm25.bm25_scores(_index(spark, sf)[0], _asked(spark, sf))


_FILTERS = f"""
filters AS (SELECT query_id, CASE query_id % 3 WHEN 0 THEN 'FR' WHEN 1 THEN 'en' END AS region,
  CASE query_id % 4 WHEN 0 THEN 'SRC3' WHEN 1 THEN '' END AS category, 'overview' AS section FROM queries)"""


@query("candidate_filter", f"""{_INDEX}, {_scores('queries')}, {_FILTERS}, kept AS (
  SELECT s.query_id, s.chunk_id, s.score FROM scores s JOIN chunks c USING (chunk_id) JOIN filters f USING (query_id)
  WHERE (coalesce(f.region, '') = '' OR lower(c.region) IN (lower(f.region), 'global'))
    AND (coalesce(f.category, '') = '' OR lower(c.category) = lower(f.category)) AND c.section = f.section),
{_best('kept', 8, 'best', 'score >= 0.01')} SELECT query_id, chunk_id, score, rank FROM best""")
def candidate_filter(spark, sf):
    index, chunks = _index(spark, sf)
    asked = _asked(spark, sf)
    filters = asked.select(
        "query_id",
        F.expr("CASE query_id % 3 WHEN 0 THEN 'FR' WHEN 1 THEN 'en' END").alias("region"),
        F.expr("CASE query_id % 4 WHEN 0 THEN 'SRC3' WHEN 1 THEN '' END").alias("category"),
        F.lit("overview").alias("section"),
    )
    kept = bm25.candidate_scores(index, asked, chunks, filters)
    return bm25.best(kept.filter(F.col("score") >= bm25.MIN_SCORE), bm25.TOP_K)


@query("bm25_topk", f"{_TOPK} SELECT query_id, chunk_id, score, rank, norm_score FROM hits")
def bm25_topk(spark, sf):
    return bm25.bm25_topk(_index(spark, sf)[0], _asked(spark, sf))


_UNIT = """
vec AS (SELECT vec_id AS chunk_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings),
unit AS (SELECT chunk_id, [x / CASE WHEN n = 0 THEN 1e-9 ELSE n END FOR x IN v] AS u
         FROM (SELECT chunk_id, v, sqrt(list_sum([x * x FOR x IN v])) AS n FROM vec))"""
_DENSE = f"""
cosine AS (SELECT q.chunk_id AS query_id, c.chunk_id, round(list_inner_product(q.u, c.u), 6) AS score FROM unit q, unit c),
{_best('cosine', 16, 'dense')}"""


@query("l2_normalise", f"WITH {_UNIT} SELECT chunk_id, i, round(u[i], 6) AS x FROM unit, range(1, {DIM + 1}) AS r(i)")
def l2_normalise(spark, sf):
    unit = _vectors(spark, sf).select("chunk_id", F.posexplode(vectors.l2_normalised(F.col("v"))).alias("i", "x"))
    return unit.select("chunk_id", (F.col("i") + 1).cast("long").alias("i"), F.round("x", 6).alias("x"))


@query("dense_topk", f"WITH {_UNIT}, {_DENSE} SELECT query_id, chunk_id, score, rank FROM dense")
def dense_topk(spark, sf):
    return vectors.dense_topk(_vectors(spark, sf), _query_vectors(spark, sf), 2 * bm25.TOP_K)


_MERGE = """
lists AS (SELECT query_id, chunk_id, rank FROM by_text UNION ALL SELECT query_id, chunk_id, rank FROM dense),
fused AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM lists GROUP BY ALL)"""


@query("rrf_merge", f"{_INDEX}, {_scores('queries')}, {_best('scores', 16, 'by_text')}, {_UNIT}, {_DENSE}, {_MERGE} "
                    "SELECT query_id, chunk_id, score FROM fused")
def rrf_merge(spark, sf):
    by_text = bm25.best(bm25.bm25_scores(_index(spark, sf)[0], _asked(spark, sf)), 16)
    return vectors.rrf_merge([by_text, dense_topk(spark, sf)])


@query("hybrid_topk", f"{_INDEX}, {_scores('queries')}, {_best('scores', 16, 'by_text', 'score > 0')}, {_UNIT}, {_DENSE}, {_MERGE}, "
                      f"{_best('fused', 8, 'best')}, {_hits('best')} "
                      "SELECT query_id, chunk_id, score, rank, norm_score FROM hits WHERE score >= 0.01")
def hybrid_topk(spark, sf):
    return vectors.hybrid_topk(
        _index(spark, sf)[0], _asked(spark, sf), _vectors(spark, sf), _query_vectors(spark, sf)
    )


@query("chunks_by_name", f"{ctes('chunks')} SELECT chunk_id, name FROM chunks WHERE lower(name) IN (SELECT lower(upper(source)) FROM documents WHERE lang = 'es')")
def chunks_by_name(spark, sf):
    names = provided(spark, sf, "documents").filter("lang = 'es'").select(F.upper("source").alias("name"))
    return bm25.chunks_by_name(frame(spark, sf, "chunks"), names).select("chunk_id", "name")


@query("index_stats", f"""{_INDEX} SELECT n_docs AS corpus_size, round(avgdl, 1) AS avg_doc_length,
  (SELECT count(*) FROM term_df) AS vocabulary_size, (SELECT count(DISTINCT name) FROM chunks) AS known_names,
  (SELECT count(*) > 0 FROM embeddings) AS hybrid FROM stats""")
def index_stats(spark, sf):
    index, chunks = _index(spark, sf)
    return bm25.index_stats(index, chunks, _vectors(spark, sf))


@query("vector_store", "SELECT vec_id AS chunk_id, len(embedding) AS dim, round(list_sum([CAST(x AS DOUBLE) FOR x IN embedding]), 6) AS total FROM embeddings")
def vector_store(spark, sf):
    path = run_dir(spark, "vectors")
    vectors.write_vectors(_vectors(spark, sf), path)
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    return spark.read.parquet(path).select("chunk_id", F.size("v").alias("dim"), F.round(total, 6).alias("total"))


@query("vector_lookup", "SELECT vec_id AS chunk_id, round(CAST(embedding[1] AS DOUBLE), 6) AS x FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def vector_lookup(spark, sf):
    ids = frame(spark, sf, "chunks").filter("region = 'en'")
    return vectors.vector_lookup(_vectors(spark, sf), ids).select("chunk_id", F.round(F.col("v")[0].cast("double"), 6).alias("x"))


@query("vector_refresh", "SELECT doc_id AS chunk_id, vec_id IS NOT NULL AS reused, round(coalesce(CAST(embedding[2] AS DOUBLE), 0.0), 6) AS x "
                         "FROM documents LEFT JOIN embeddings ON vec_id = doc_id")
def vector_refresh(spark, sf):
    matrix = vectors.vector_matrix(frame(spark, sf, "chunks"), _vectors(spark, sf), DIM)
    return matrix.select("chunk_id", "reused", F.round(F.col("v")[1], 6).alias("x"))


@query("vector_missing", "SELECT doc_id AS chunk_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def vector_missing(spark, sf):
    return vectors.missing_vectors(frame(spark, sf, "chunks"), _vectors(spark, sf))


def _as_of() -> object:
    return F.lit(AS_OF).cast("timestamp")


def _stale_sql(date_sortable: str = "date_sortable", stored: str = "stored_at", year_round: str = "is_year_round") -> str:
    return (
        f"coalesce(NOT {year_round} AND coalesce({date_sortable}, '') <> '' AND {date_sortable} < '{AS_OF[:7]}' "
        f"AND ({stored} IS NULL OR datediff('second', {stored}, TIMESTAMP '{AS_OF}') >= 60 * 86400), false)"
    )


@query("stale_flag", f"""{ctes('dated')} SELECT id, coalesce(NOT is_year_round AND date_sortable < '1999-06'
  AND (stored_at IS NULL OR datediff('second', stored_at, TIMESTAMP '1999-06-15 12:00:00') >= 60 * 86400), false) AS stale FROM dated""")
def stale_flag(spark, sf):
    flag = freshness.stale(
        F.col("date_sortable"), F.col("stored_at").cast("timestamp"), F.col("is_year_round"),
        F.lit("1999-06-15 12:00:00").cast("timestamp"),
    )
    return frame(spark, sf, "dated").select("id", flag.alias("stale"))


def _timed_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "chunks").withColumn("stored_at", F.col("stored_at").cast("timestamp"))


@query("fresh_hits", f"{_TOPK} SELECT h.query_id, h.chunk_id, h.rank FROM hits h JOIN chunks c USING (chunk_id) WHERE NOT {_stale_sql('c.date_sortable', 'c.stored_at', 'c.is_year_round')}")
def fresh_hits(spark, sf):
    kept = freshness.fresh_hits(bm25_topk(spark, sf), _timed_chunks(spark, sf), _as_of())
    return kept.select("query_id", "chunk_id", "rank")


@query("stale_hits", f"{_TOPK} SELECT query_id, count(*) AS hits, count(*) FILTER (WHERE {_stale_sql()}) AS stale_hits FROM hits JOIN chunks USING (chunk_id) GROUP BY query_id")
def stale_hits(spark, sf):
    return freshness.stale_hits_per_query(bm25_topk(spark, sf), _timed_chunks(spark, sf), _as_of())


_COVERED = f"""covered AS (
  SELECT query_id, count(*) AS hits, count(*) FILTER (WHERE norm_score >= 0.55) AS good_hits, arg_min(norm_score, rank) AS top_score,
    count(*) FILTER (WHERE norm_score >= 0.55) >= 3 AS is_sufficient
  FROM (SELECT h.* FROM hits h JOIN chunks c USING (chunk_id) WHERE NOT {_stale_sql('c.date_sortable', 'c.stored_at', 'c.is_year_round')})
  GROUP BY query_id)"""


def _covered(spark: SparkSession, sf: str) -> DataFrame:
    return freshness.coverage(freshness.fresh_hits(bm25_topk(spark, sf), _timed_chunks(spark, sf), _as_of()))


@query("coverage", f"{_TOPK}, {_COVERED} SELECT * FROM covered")
def coverage(spark, sf):
    return _covered(spark, sf)


@query("tier_route", f"""{_TOPK}, {_COVERED}, fetched AS (SELECT conv_id AS query_id, count(*) AS n FROM conversations GROUP BY 1)
SELECT q.query_id, CASE WHEN coalesce(is_sufficient, false) THEN 'bm25' WHEN coalesce(n, 0) > 0 THEN 'llm' ELSE 'bm25' END AS source,
  coalesce(is_sufficient, false) OR coalesce(n, 0) > 0 AS is_sufficient, NOT coalesce(is_sufficient, false) AS needs_fetch,
  coalesce(top_score, 0.0) AS top_score
FROM queries q LEFT JOIN covered USING (query_id) LEFT JOIN fetched USING (query_id)""")
def tier_route(spark, sf):
    """Conversations stand for externally fetched rows of the query of their number."""
    fetched = provided(spark, sf, "conversations").select(F.col("conv_id").alias("query_id"))
    return freshness.tier_route(_asked(spark, sf), _covered(spark, sf), fetched)


_PAIRS = """pairs AS (SELECT DISTINCT query_id * 1000 + CAST(substr(name, 4) AS BIGINT) AS pair_id, query_id, query, name
  FROM (SELECT h.query_id, q.text AS query, c.name FROM hits h JOIN chunks c USING (chunk_id) JOIN queries q USING (query_id))),
pair_texts AS (SELECT pair_id AS query_id, concat(query, ' ', name) AS text FROM pairs)"""


@query("name_relevance", f"""{_TOPK}, {_PAIRS}, {_scores('pair_texts', 'pair_scores')}, {_best('pair_scores', 3, 'pair_best', 'score >= 0.01')},
{_hits('pair_best', 'pair_hits')}
SELECT pair_id, max(p.query_id) AS query_id, max(p.name) AS name,
  coalesce(max(h.norm_score) FILTER (WHERE lower(c.name) = lower(p.name)), 0.0) AS relevance
FROM pairs p LEFT JOIN pair_hits h ON h.query_id = p.pair_id LEFT JOIN chunks c ON c.chunk_id = h.chunk_id GROUP BY pair_id""")
def name_relevance(spark, sf):
    """Relevance of the sources found for a query, as pairs of query and source."""
    index, chunks = _index(spark, sf)
    asked = _asked(spark, sf)
    found = bm25.bm25_topk(index, asked).join(chunks.select("chunk_id", "name"), "chunk_id").join(asked, "query_id")
    pairs = found.select(
        (F.col("query_id") * 1000 + F.substring("name", 4, 10).cast("long")).alias("pair_id"),
        "query_id", F.col("text").alias("query"), "name",
    ).distinct()
    return bm25.name_relevance(index, chunks, pairs).drop("query")


@query("enrichment_context", f"""{ctes('chunks')}, {_TOKENS}, names AS (
  SELECT DISTINCT source AS name FROM documents UNION SELECT DISTINCT concat(lang, ' ', source) FROM documents WHERE lang <> 'en'),
numbered AS (SELECT *, row_number() OVER (ORDER BY name) AS query_id FROM names),
name_texts AS (SELECT query_id, name AS text FROM numbered), {_scores('name_texts')}, {_best('scores', 5, 'best', 'score >= 0.01')}, {_hits('best')},
flagged AS (SELECT chunk_id, lower(name) AS own, region, {_stale_sql()} AS stale FROM chunks),
stored AS (SELECT own AS key, count(*) AS n, bool_or(stale) AS s FROM flagged WHERE region = 'de' GROUP BY 1),
exact AS (SELECT own AS key, count(*) AS n, bool_or(stale) AS s FROM flagged GROUP BY 1),
near AS (SELECT lower(q.name) AS key, count(*) AS n, bool_or(f.stale) AS s FROM hits h JOIN numbered q USING (query_id) JOIN flagged f USING (chunk_id)
  WHERE f.own = lower(q.name) OR h.norm_score >= 0.7 GROUP BY 1),
found AS (SELECT q.name, coalesce(st.n, 0) AS stored_n, coalesce(st.s, false) AS stored_stale, coalesce(e.n, r.n, 0) AS index_n,
  CASE WHEN e.n IS NOT NULL THEN e.s ELSE coalesce(r.s, false) END AS index_stale
  FROM names q LEFT JOIN stored st ON st.key = lower(q.name) LEFT JOIN exact e ON e.key = lower(q.name) LEFT JOIN near r ON r.key = lower(q.name))
SELECT name, CASE WHEN stored_n > 0 AND NOT stored_stale THEN 'store' WHEN index_n >= 2 AND NOT index_stale THEN 'bm25' ELSE 'fetch' END AS source,
  CASE WHEN stored_n > 0 AND NOT stored_stale THEN stored_n >= 2 ELSE index_n >= 2 AND NOT index_stale END AS is_sufficient,
  CASE WHEN stored_n > 0 AND NOT stored_stale THEN stored_n WHEN index_n >= 2 AND NOT index_stale THEN index_n ELSE 0 END AS n_chunks
FROM found""")
def enrichment_context(spark, sf):
    """Sources by name, and names no chunk has; German documents are the store."""
    chunks = _timed_chunks(spark, sf)
    docs = provided(spark, sf, "documents")
    names = docs.select(F.col("source").alias("name")).union(
        docs.filter("lang <> 'en'").select(F.concat_ws(" ", "lang", "source"))
    ).distinct()
    index = bm25.build_index(chunks)
    hits = bm25.bm25_topk(index, names.select(F.col("name").alias("query_id"), F.col("name").alias("text")), 5)
    return freshness.enrichment_source(
        names, chunks.filter("region = 'de'"), chunks, hits.withColumnRenamed("query_id", "name"), _as_of()
    )


@query("weighted_keyword_score", f"""{ctes('listing', 'questions', 'offers')}, fields AS (SELECT ord, tags, name, category, subjects, countries, org, region, coalesce(description, '') AS description FROM listing),
offered AS (SELECT q.query_id, q.text, f.* FROM offers o JOIN questions q USING (query_id) JOIN fields f ON f.ord = o.ord),
words AS (SELECT *, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM offered)
SELECT query_id, ord, CASE WHEN len(w) > 0 THEN round(({' + '.join(
    f"CAST({weight} AS DOUBLE) * len(list_intersect(w, regexp_extract_all(lower({column}), '[a-z0-9]+')))"
    for column, weight in (("array_to_string(tags, ' ')", 3.0), ("name", 2.5), ("category", 2.0),
        ("array_to_string(subjects, ' ')", 1.5), ("array_to_string(countries, ' ')", 1.5), ("org", 1.0), ("region", 1.0), ("description", 0.8)))}) / (CAST(13.3 AS DOUBLE) * len(w)), 4) ELSE 0.0 END AS score FROM words""")
def weighted_keyword_score(spark, sf):
    """Each question scored against all listing rows offered to it."""
    # Words are found once per listing row and per question, not once per pair.
    rows = frame(spark, sf, "listing").select("ord", *[
        T.tokens(F.array_join(field, " ") if field in ("tags", "subjects", "countries") else T.text_or_empty(F.col(field))).alias(field)
        for field in bm25.FIELD_WEIGHTS
    ])
    asked = frame(spark, sf, "questions").select("query_id", T.tokens(F.col("text")).alias("words"))
    return bm25.keyword_scores(frame(spark, sf, "offers"), asked, rows)


@query("token_jaccard", """WITH sets AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS s FROM documents)
SELECT a.doc_id, round(CASE WHEN len(a.s) > 0 AND len(b.s) > 0 THEN len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s)))::DOUBLE ELSE 0 END, 6) AS jaccard
FROM sets a JOIN sets b ON b.doc_id = a.doc_id + 1""")
def token_jaccard(spark, sf):
    """Similarity of each document to the next one."""
    sets = provided(spark, sf, "documents").select("doc_id", querylog.token_set(F.col("text")).alias("s"))
    following = sets.select((F.col("doc_id") - 1).alias("doc_id"), F.col("s").alias("next"))
    return sets.join(following, "doc_id").select(
        "doc_id", F.round(querylog.token_jaccard(F.col("s"), F.col("next")), 6).alias("jaccard")
    )
