"""Deduplication, scoring, filters, sorts and pages; the listing search."""

from __future__ import annotations

from pyspark.sql import functions as F

from termwell.operators import ranking as K
from termwell.plans import search
from termwell.plans.intent_queries import EFFECTIVE_SQL
from termwell.plans.registry import query
from termwell.plans.tables import ctes, frame, provided
from termwell.plans.text_queries import LISTING
from termwell.vocab.listing import DIFFICULTIES

RANKED = ctes("listing", "ranked")


def _ranked(spark, sf):
    return frame(spark, sf, "ranked")


def _row(*names):
    return {name: F.col(name) for name in names}


_SHARDS = """shards AS (SELECT 0 AS shard_no, * FROM listing WHERE region = 'Asia' UNION ALL SELECT 1, * FROM listing WHERE difficulty = 'Hard'
  UNION ALL SELECT 2, * FROM listing WHERE cost_usd IS NOT NULL)"""


def _shards(spark, sf):
    rows = frame(spark, sf, "listing")
    return K.shard_union([rows.filter("region = 'Asia'"), rows.filter("difficulty = 'Hard'"), rows.filter("cost_usd IS NOT NULL")])


@query("shard_union", f"{LISTING}, {_SHARDS} SELECT shard_no, count(*) AS rows FROM shards GROUP BY ROLLUP (shard_no)")
def shard_union(spark, sf):
    return K.shard_counts(_shards(spark, sf))


@query("dedup_first", f"""{LISTING}, fp AS (SELECT *, lower(name) || '|' || lower(org) AS fp FROM listing),
cats AS (SELECT fp, category, min(ord) AS pos, count(*) AS n FROM fp GROUP BY ALL),
shards AS (SELECT fp, string_agg(category || ' x' || n, ', ' ORDER BY pos) AS source_shards FROM cats GROUP BY fp),
firsts AS (SELECT fp, min(ord) AS ord, count(*) AS copies FROM fp GROUP BY fp)
SELECT f.ord, l.name, l.org, l.category, f.copies, s.source_shards FROM firsts f JOIN shards s USING (fp) JOIN listing l ON l.ord = f.ord""")
def dedup_first(spark, sf):
    rows = K.dedup_first(frame(spark, sf, "listing").select("ord", "name", "org", "category"))
    named = F.transform("source_shards", lambda s: F.concat(s["category"], F.lit(" x"), s["n"].cast("string")))
    return rows.withColumn("source_shards", F.array_join(named, ", "))


@query("dedup_best", f"""{LISTING} SELECT ord, name, org, score FROM listing
QUALIFY row_number() OVER (PARTITION BY lower(name), lower(org) ORDER BY score DESC, ord) = 1""")
def dedup_best(spark, sf):
    return K.dedup_best(frame(spark, sf, "listing").select("ord", "name", "org", "score"))


@query("presort", f"{LISTING} SELECT category, ord, row_number() OVER (PARTITION BY category ORDER BY score DESC, ord) - 1 AS position FROM listing")
def presort(spark, sf):
    return K.presort(frame(spark, sf, "listing").select("category", "ord", "score"), ["category"], "score").drop("score")


# All lines choose a new order for the offers of their supplier.
_LISTS = "lists AS (SELECT l_suppkey AS query_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) - 1 AS position, l_orderkey, l_linenumber FROM lineitem)"


def _lists(spark, sf):
    """Offers per supplier by falling price, as one ranking per supplier."""
    from termwell.operators.scan import numbered

    rows = provided(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("query_id"), "l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey"
    )
    order = [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_partkey")]
    ranked = numbered(rows, ["query_id"], order, "n")
    return ranked.select("query_id", (F.col("n") - 1).alias("position"), "l_orderkey", "l_linenumber")


def _picks(spark, sf):
    return provided(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("query_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pick_no"),
        ((F.col("l_partkey") + F.col("l_linenumber")) % 14 - 1).alias("position"),
    )


@query("rerank_merge", f"""WITH {_LISTS}, picks AS (SELECT l_suppkey AS query_id, l_orderkey * 10 + l_linenumber AS pick_no, (l_partkey + l_linenumber) % 14 - 1 AS position
  FROM lineitem),
sizes AS (SELECT query_id, count(*) AS n FROM lists GROUP BY 1),
valid AS (SELECT query_id, position, min(pick_no) AS pick FROM picks JOIN sizes USING (query_id) WHERE n > 8 AND position >= 0 AND position < least(n, 12) GROUP BY 1, 2),
top AS (SELECT l.*, row_number() OVER (PARTITION BY l.query_id ORDER BY pick NULLS LAST, l.position) - 1 AS new_position
  FROM lists l LEFT JOIN valid v ON v.query_id = l.query_id AND v.position = l.position WHERE l.position < 12),
merged AS (SELECT * FROM top UNION ALL SELECT *, position FROM lists WHERE position >= 12)
SELECT query_id, position, l_orderkey, l_linenumber, new_position, CASE WHEN query_id IN (SELECT query_id FROM valid) THEN 'bm25+llm' ELSE 'bm25' END AS rank_source FROM merged""")
def rerank_merge(spark, sf):
    return K.rerank_merge(_lists(spark, sf), _picks(spark, sf))


@query("position_score", f"""{LISTING} SELECT region, ord, position, CAST(round(CAST(1.0::DOUBLE - position / n::DOUBLE * 0.9::DOUBLE AS DECIMAL(20, 10)), 4) AS DOUBLE) AS final_score FROM (
  SELECT region, ord, row_number() OVER (PARTITION BY region ORDER BY score DESC, ord) - 1 AS position, count(*) OVER (PARTITION BY region) AS n FROM listing)""")
def position_score(spark, sf):
    rows = frame(spark, sf, "listing").select("region", "ord", "score")
    return K.position_score(rows, ["region"], [F.desc("score"), F.asc("ord")]).drop("score")


_HYBRID = """CAST(round(CAST(least(greatest(0.55::DOUBLE * confidence + 0.30::DOUBLE * score + 0.15::DOUBLE *
  (CASE WHEN n > 1 THEN 1.0::DOUBLE - position / n::DOUBLE * 0.9::DOUBLE ELSE 1.0 END), 0.0), 1.0) AS DECIMAL(20, 10)), 4) AS DOUBLE)"""


@query("hybrid_score", f"""{RANKED} SELECT run_id, position, {_HYBRID} AS score FROM (
  SELECT r.run_id, r.position, l.confidence, r.score, count(*) OVER (PARTITION BY r.run_id) AS n FROM ranked r JOIN listing l USING (ord))""")
def hybrid_score(spark, sf):
    rows = _ranked(spark, sf).select("run_id", "position", "ord", "score")
    sizes = rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    joined = rows.join(frame(spark, sf, "listing").select("ord", "confidence"), "ord").join(sizes, "run_id")
    score = K.hybrid_score(F.col("confidence"), F.col("score"), F.col("position"), F.col("n"))
    return joined.select("run_id", "position", score.alias("score"))


_PASS = """(NOT w_free OR coalesce(cost_usd <= 0, false))
  AND (coalesce(w_month, '') = '' OR (contains(lower(date), 'year') AND contains(lower(date), 'round')) OR contains(lower(date), substr(lower(w_month), 1, 3)))
  AND (coalesce(w_year, 0) = 0 OR coalesce(date_sortable, '') = '' OR starts_with(date_sortable, CAST(w_year AS VARCHAR)))
  AND (len(w_countries) = 0 OR list_has_any(list_transform(countries, lambda c: lower(c)), list_transform(w_countries, lambda c: lower(c))))"""


@query("post_filter", f"""{EFFECTIVE_SQL}, {ctes('listing', 'offers')[5:]}, offered AS (SELECT e.query_id, l.*, e.free_only AS w_free, e.month AS w_month, e.year AS w_year, e.countries AS w_countries
  FROM effective e JOIN offers o USING (query_id) JOIN listing l USING (ord))
SELECT query_id, ord FROM offered WHERE {_PASS}""")
def post_filter(spark, sf):
    offered = search.offered_rows(spark, sf).select("query_id", "ord", "date", "date_sortable", "countries", "cost_usd")
    params = search.request_params(spark, sf)
    keep = K.passes_filters(
        _row("date", "date_sortable", "countries", "cost_usd"), F.col("w.year"), F.col("w.month"), F.col("w.countries"), F.col("w.free_only")
    )
    return offered.join(params, "query_id").filter(keep).select("query_id", "ord")


_LEVELS = "CASE difficulty " + " ".join(f"WHEN '{d}' THEN {n}" for n, d in enumerate(DIFFICULTIES, start=1)) + " ELSE 0 END"
SORT_KEYS = {
    "deadline": "coalesce(nullif(date_sortable, ''), '9999-99'), ord",
    "cost_asc": "coalesce(cost_usd, 9999999.0), ord",
    "difficulty": f"{_LEVELS} DESC, ord",
    "relevance": "score DESC, ord",
}


@query("sort_modes", f"{LISTING} " + " UNION ALL ".join(
    f"SELECT '{mode}' AS mode, ord, row_number() OVER (ORDER BY {key}) AS position FROM listing" for mode, key in SORT_KEYS.items()))
def sort_modes(spark, sf):
    """Position of every catalog row under each sort mode."""
    from termwell.operators.scan import numbered

    rows = frame(spark, sf, "listing").select("ord", "score", "cost_usd", "date_sortable", "difficulty")
    modes = F.array(*[F.lit(mode) for mode in SORT_KEYS])
    keyed = rows.withColumn("mode", F.explode(modes)).withColumn(
        "key", K.sort_key(F.col("mode"), _row("score", "cost_usd", "date_sortable", "difficulty"))
    ).select("mode", "key", "ord")
    return numbered(keyed, ["mode"], ["key", "ord"], "position").drop("key")


_REASONS = """CASE WHEN contains(lower(q), lower(region)) OR len(list_filter(countries, lambda c: contains(lower(q), lower(c)))) > 0 THEN 'Geographic match: ' || region END,
  CASE WHEN contains(lower(q), lower(category)) OR len(list_filter(tags, lambda t: contains(lower(q), t))) > 0 THEN 'Category: ' || category END,
  CASE WHEN score >= 0.4 THEN 'Strong BM25 corpus match (' || CAST(CAST(round(CAST(score AS DECIMAL(20, 10)), 2) AS DOUBLE) AS VARCHAR) || ')' WHEN score >= 0.15 THEN 'Partial corpus match (' || CAST(CAST(round(CAST(score AS DECIMAL(20, 10)), 2) AS DOUBLE) AS VARCHAR) || ')' END,
  CASE WHEN sort_by = 'deadline' THEN 'Sorted by upcoming deadline' END, CASE WHEN sort_by = 'cost_asc' THEN 'Sorted by cost (lowest first)' END"""


@query("match_reasons", f"""{ctes('listing', 'requests', 'offers')}, offered AS (SELECT r.query_id, r.query AS q, r.sort_by, l.* FROM requests r JOIN offers o USING (query_id) JOIN listing l USING (ord))
SELECT query_id, ord, coalesce(nullif(concat_ws('; ', {_REASONS}), ''), 'Relevance match for: ' || substr(q, 1, 50)) AS reasons FROM offered""")
def match_reasons(spark, sf):
    requests = frame(spark, sf, "requests").select("query_id", "query", "sort_by", F.lower("query").alias("asked"))
    offered = search.offered_rows(spark, sf).join(requests, "query_id")
    reasons = K.match_reasons(_row("region", "countries", "category", "tags"), F.col("query"), F.col("score"), F.col("sort_by"), F.col("asked"))
    return offered.select("query_id", "ord", F.array_join(reasons, "; ").alias("reasons"))


@query("paginate", f"""{RANKED}, numbered AS (SELECT run_id, ord, score, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, ord, position) AS row_no,
  count(*) OVER (PARTITION BY run_id) AS total FROM ranked)
SELECT run_id, ord, score, row_no, total FROM numbered WHERE row_no > (1 + run_id % 2 - 1) * 3 AND row_no <= (1 + run_id % 2) * 3""")
def paginate(spark, sf):
    """Page one or two of three rows of every run."""
    page = 1 + F.col("run_id") % 2
    rows = _ranked(spark, sf).select("run_id", "ord", "score", "position")
    paged = K.paginate(rows, ["run_id"], [F.desc("score"), F.asc("ord"), F.asc("position")], page, F.lit(3))
    return paged.drop("position")


@query("one_page", f"{LISTING} SELECT ord, name, score FROM listing ORDER BY score DESC, ord LIMIT 12 OFFSET 24")
def one_page(spark, sf):
    return K.one_page(frame(spark, sf, "listing").select("ord", "name", "score"), [F.desc("score"), F.asc("ord")], 3, 12)


@query("head_limit", f"{LISTING} SELECT ord, name FROM listing ORDER BY ord LIMIT 20")
def head_limit(spark, sf):
    return K.head_limit(frame(spark, sf, "listing").select("ord", "name"), [F.asc("ord")], 20)


@query("enrich_select", f"""{RANKED} SELECT run_id, ord, position, row_number() OVER (PARTITION BY run_id ORDER BY position) AS rank FROM ranked
QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY position) <= 1 + run_id % 4""")
def enrich_select(spark, sf):
    rows = _ranked(spark, sf).select(F.col("run_id").alias("query_id"), "ord", "position")
    return K.enrich_select(rows, 1 + F.col("query_id") % 4, [F.asc("position")]).withColumnRenamed("query_id", "run_id")


@query("enrich_merge", f"""{LISTING} SELECT ord, CASE WHEN score >= 0.5 THEN trim(substr('About ' || name || '. ' || coalesce(description, ''), 1, 480), ' ') ELSE description END AS description FROM listing""")
def enrich_merge(spark, sf):
    from termwell.functions.text import clipped_context

    rows = frame(spark, sf, "listing").select("ord", "name", "score", "description")
    context = F.concat(F.lit("About "), F.col("name"), F.lit(". "), F.coalesce("description", F.lit("")))
    enriched = rows.filter("score >= 0.5").select("ord", clipped_context(context).alias("description"))
    return K.enrich_merge(rows, enriched, "ord", ["description"]).select("ord", "description")


@query("ui_filter", f"""{ctes('listing', 'requests', 'offers')}, offered AS (SELECT r.query_id, coalesce(r.region, 'All') AS f_region, coalesce(r.difficulty, 'All') AS f_difficulty,
  coalesce(CAST(r.year AS STRING), 'Any year') AS f_year, coalesce(r.month, 'Any month') AS f_month, l.* FROM requests r JOIN offers o USING (query_id) JOIN listing l USING (ord))
SELECT query_id, ord FROM offered WHERE (f_region = 'All' OR region = 'Global' OR region = f_region) AND (f_difficulty = 'All' OR difficulty = f_difficulty)
  AND (f_year = 'Any year' OR regexp_matches(date, 'year.?round', 'i') OR contains(date || ' ' || deadline, f_year))
  AND (f_month = 'Any month' OR regexp_matches(date, 'year.?round', 'i') OR contains(lower(date), lower(substr(f_month, 1, 3))))""")
def ui_filter(spark, sf):
    wanted = frame(spark, sf, "requests").selectExpr(
        "query_id", "coalesce(region, 'All') AS f_region", "coalesce(difficulty, 'All') AS f_difficulty",
        "coalesce(CAST(year AS STRING), 'Any year') AS f_year", "coalesce(month, 'Any month') AS f_month",
    )
    keep = K.ui_filter(
        _row("region", "difficulty", "date", "deadline"), F.col("f_region"), F.col("f_difficulty"), F.col("f_year"), F.col("f_month")
    )
    return search.offered_rows(spark, sf).join(wanted, "query_id").filter(keep).select("query_id", "ord")


_CATALOG = f"""{EFFECTIVE_SQL}, {ctes('listing', 'offers')[5:]},
offered AS (SELECT e.query_id, l.*, e.free_only AS w_free, e.month AS w_month, e.year AS w_year, e.countries AS w_countries, e.sort_by,
  row_number() OVER (PARTITION BY e.query_id ORDER BY l.ord) - 1 AS position, count(*) OVER (PARTITION BY e.query_id) AS n
  FROM effective e JOIN offers o USING (query_id) JOIN listing l USING (ord)),
scored AS (SELECT * REPLACE ({_HYBRID} AS score) FROM offered WHERE {_PASS}),
unique_rows AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY query_id, lower(name), lower(org) ORDER BY score DESC, position) = 1),
sorted AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY
    CASE sort_by WHEN 'deadline' THEN 0 WHEN 'cost_asc' THEN coalesce(cost_usd, 9999999.0) WHEN 'difficulty' THEN -({_LEVELS}) ELSE -score END,
    CASE sort_by WHEN 'deadline' THEN coalesce(nullif(date_sortable, ''), '9999-99') ELSE '' END, position) AS row_no,
  count(*) OVER (PARTITION BY query_id) AS total FROM unique_rows)
SELECT s.query_id, ord, score, row_no, total, s.sort_by FROM sorted s JOIN requests r USING (query_id)
WHERE row_no > (greatest(r.page, 1) - 1) * greatest(r.page_size, 1) AND row_no <= greatest(r.page, 1) * greatest(r.page_size, 1)"""


@query("search_catalog", _CATALOG)
def search_catalog(spark, sf):
    """The listing search of every request over the rows it is offered."""
    return search.search_catalog(spark, sf).select("query_id", "ord", "score", "row_no", "total", "sort_by")


@query("result_projection", f"{LISTING} SELECT ord, score AS relevance_score, array_to_string(match_reasons, '; ') AS match_reasons FROM listing")
def result_projection(spark, sf):
    ranked = frame(spark, sf, "listing").select("ord", F.col("score").alias("final_score"), F.col("match_reasons").alias("source_shards"))
    return K.result_projection(ranked).withColumn("match_reasons", F.array_join("match_reasons", "; "))
