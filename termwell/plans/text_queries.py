"""Text, key and date derivations over the catalog, questions and requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from termwell.functions import text as T
from termwell.operators import catalog
from termwell.plans.registry import query
from termwell.plans.retrieval_queries import _TOPK, bm25_topk
from termwell.plans.tables import ctes, frame, provided, wide_frame
from termwell.vocab.listing import MONTH_SPELLINGS, ROLLING_DEADLINES, UNDATED_WORDS

LISTING = ctes("listing")


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _mentions(text: str, spellings: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({text}), '{s}')" for s in spellings) + ")"


def months_sql(text: str) -> str:
    parts = ", ".join(f"CASE WHEN {_mentions(text, s)} THEN {_list(s)} ELSE []::VARCHAR[] END" for s in MONTH_SPELLINGS)
    return f"flatten([{parts}])"


def years_sql(text: str) -> str:
    return rf"regexp_extract_all({text}, '\b(20[0-9][0-9])\b', 1)"


def date_sortable_sql(text: str) -> str:
    undated = " OR ".join(f"contains(lower({text}), '{w}')" for w in UNDATED_WORDS)
    month = "CASE " + " ".join(
        f"WHEN {_mentions(text, s)} THEN '-{n:02d}'" for n, s in enumerate(MONTH_SPELLINGS, start=1)
    ) + " ELSE '' END"
    year = rf"nullif(regexp_extract({text}, '\b(20[0-9][0-9])\b', 1), '')"
    return f"CASE WHEN NOT ({undated}) THEN {year} || {month} END"


def dashed_sql(text: str) -> str:
    return f"trim(regexp_replace(lower({text}), '[^a-z0-9]+', '-', 'g'), '-')"


def squeezed_sql(text: str) -> str:
    return rf"trim(regexp_replace(lower({text}), '\s+', ' ', 'g'))"


def year_round_sql(text: str) -> str:
    return f"(contains(lower(coalesce({text}, '')), 'year') AND contains(lower(coalesce({text}, '')), 'round'))"


OVERVIEW_SQL = """(name || ' is a ' || lower(category) || ' exam administered by ' || org || '. Region: ' || region
  || '. Available in: ' || array_to_string(countries[1:6], ', ') || '. Date: ' || date || '. Registration deadline: ' || deadline
  || '. Difficulty: ' || difficulty || '. Duration: ' || duration || '. Cost: ' || cost || '.'
  || CASE WHEN coalesce(description, '') <> '' THEN ' ' || trim(description) ELSE '' END)"""

SUBJECTS_SQL = """(name || ' — Subjects: ' || array_to_string(subjects[1:8], ', ') || '. Keywords: ' || array_to_string(tags[1:10], ' ')
  || '. Org: ' || org || '. Category: ' || category || '. Region: ' || region || '.')"""


def _deadline_sql() -> str:
    em, ey = months_sql("date"), years_sql("date")
    dm, dy = months_sql("deadline"), years_sql("deadline")

    def each(items: str, sentence: str) -> str:
        return f"list_transform(list_sort(list_distinct({items})), lambda w: {sentence})"

    rolling = ", ".join("'" + r + "'" for r in ROLLING_DEADLINES)
    return f"""array_to_string(list_concat(
  CASE WHEN {year_round_sql('date')} THEN [name || ' is available year round with no fixed exam date.', name || ' can be taken any time of year.']
  ELSE list_concat([name || ' exam date: ' || date || '.'],
    CASE WHEN len({em}) > 0 THEN [name || ' is scheduled in ' || date || '. Month: ' || array_to_string({em}, ' ') || '.'] ELSE [] END,
    CASE WHEN len({ey}) > 0 THEN [name || ' exam year: ' || array_to_string({ey}, ' ') || '.'] ELSE [] END,
    {each(em, "'Exam taking place in ' || w || '. ' || name || ' ' || w || ' exam. ' || w || ' examination ' || name || '.'")},
    {each(ey, "name || ' ' || w || ' exam. Examination in ' || w || '.'")}) END,
  CASE WHEN lower(deadline) IN ({rolling}) THEN [name || ' has a rolling registration deadline — apply any time.']
  ELSE list_concat([name || ' registration deadline: ' || deadline || '.'],
    CASE WHEN len({dm}) > 0 THEN ['Register for ' || name || ' before ' || deadline || '. Application closes ' || array_to_string({dm}, ' ')
      || '. Deadline month: ' || array_to_string({dm}, ' ') || '.'] ELSE [] END,
    {each(dm, "'Closing date in ' || w || '. Register by ' || w || '. ' || name || ' ' || w || ' deadline. Application deadline ' || w || '.'")},
    {each(dy, "'Deadline in ' || w || '. Registration closes ' || w || '.'")}) END,
  CASE WHEN len({em}) + len({dm}) > 0 THEN [name || ' relevant months: ' || array_to_string(list_sort(list_distinct(list_concat({em}, {dm}))), ', ')
    || '. Category: ' || category || '. Region: ' || region || '.'] ELSE [] END,
  CASE WHEN len({ey}) + len({dy}) > 0 THEN [name || ' relevant years: ' || array_to_string(list_sort(list_distinct(list_concat({ey}, {dy}))), ', ')
    || '. Upcoming in ' || array_to_string(list_sort(list_distinct(list_concat({ey}, {dy}))), ', ') || '.'] ELSE [] END,
  CASE WHEN {year_round_sql('date')} THEN [name || ' ongoing exam. Available throughout the year. No specific month required.'] ELSE [] END), ' ')"""


DEADLINE_SQL = _deadline_sql()
CHUNKS_SQL = f"""{LISTING}, based AS (SELECT *, substr({dashed_sql("name || '-' || org")}, 1, 50) AS base FROM listing),
made AS (
  SELECT *, base || '-overview' AS chunk_id, 'overview' AS section, tags[1:8] AS chunk_tags, {OVERVIEW_SQL} AS text FROM based
  UNION ALL SELECT *, base || '-subjects', 'subjects', tags[1:8], {SUBJECTS_SQL} FROM based
  UNION ALL SELECT *, base || '-deadline-alerts', 'deadline-alerts',
    list_concat(tags[1:4], {months_sql('date')}, {years_sql('date')})[1:12], {DEADLINE_SQL} FROM based),
store AS (SELECT ord, chunk_id, name, org, region, category, section, chunk_tags AS tags, text, date AS exam_date,
  {date_sortable_sql('date')} AS date_sortable, stored_at, {year_round_sql('date')} AS is_year_round FROM made)"""


def listing_row() -> dict:
    return catalog.listing_columns()


@query("index_text", f"{ctes('chunks')} SELECT chunk_id, concat_ws(' ', name, name, section, region, category, array_to_string(tags, ' '), array_to_string(tags, ' '), text) AS indexed FROM chunks")
def index_text(spark, sf):
    text = T.index_text(*[F.col(c) for c in ("name", "section", "region", "category", "tags", "text")])
    return frame(spark, sf, "chunks").select("chunk_id", text.alias("indexed"))


@query("embed_text", f"{ctes('chunks')} SELECT chunk_id, name || ' is a ' || category || ' examination in ' || region || '. Subjects and keywords: ' || array_to_string(tags[1:6], ', ') || '. ' || substr(text, 1, 400) AS prose FROM chunks")
def embed_text(spark, sf):
    prose = T.embed_text(*[F.col(c) for c in ("name", "category", "region", "tags", "text")])
    return frame(spark, sf, "chunks").select("chunk_id", prose.alias("prose"))


@query("slug", f"{LISTING} SELECT ord, substr({dashed_sql('name')}, 1, 50) AS name_slug, substr({dashed_sql(chr(39).join(['name || ', '-', ' || org']))}, 1, 50) AS full_slug FROM listing")
def slug(spark, sf):
    return wide_frame(spark, sf, "listing").select(
        "ord", T.slug(F.col("name")).alias("name_slug"), T.slug(F.col("name"), F.col("org")).alias("full_slug")
    )


@query("stable_id", f"""{LISTING} SELECT ord, substr({dashed_sql("name || '-' || org")}, 1, 40) || '-' || substr(sha1(lower(name || '-' || org)), 1, 6) AS id FROM listing""")
def stable_id(spark, sf):
    return wide_frame(spark, sf, "listing").select("ord", T.stable_id(F.col("name"), F.col("org")).alias("id"))


@query("extract_months", f"{LISTING} SELECT ord, array_to_string({months_sql('date')}, ' ') AS months FROM listing")
def extract_months(spark, sf):
    return wide_frame(spark, sf, "listing").select("ord", F.array_join(T.months_in(F.col("date")), " ").alias("months"))


@query("extract_years", f"{LISTING} SELECT ord, array_to_string({years_sql(chr(39).join(['date || ', ' ', ' || deadline']))}, ' ') AS years FROM listing")
def extract_years(spark, sf):
    both = F.concat_ws(" ", "date", "deadline")
    return wide_frame(spark, sf, "listing").select("ord", F.array_join(T.years_in(both), " ").alias("years"))


@query("date_sortable", f"{LISTING} SELECT ord, {date_sortable_sql('date')} AS exam_date, {date_sortable_sql('deadline')} AS due FROM listing")
def date_sortable(spark, sf):
    return wide_frame(spark, sf, "listing").select(
        "ord", T.date_sortable(F.col("date")).alias("exam_date"), T.date_sortable(F.col("deadline")).alias("due")
    )


@query("is_year_round", f"{LISTING} SELECT ord, {year_round_sql('date')} AS is_year_round FROM listing")
def is_year_round(spark, sf):
    return wide_frame(spark, sf, "listing").select("ord", T.is_year_round(F.col("date")).alias("is_year_round"))


@query("overview_text", f"{LISTING} SELECT ord, {OVERVIEW_SQL} AS text FROM listing")
def overview_text(spark, sf):
    return wide_frame(spark, sf, "listing").select("ord", T.overview_text(listing_row()).alias("text"))


@query("subjects_text", f"{LISTING} SELECT ord, {SUBJECTS_SQL} AS text FROM listing")
def subjects_text(spark, sf):
    return wide_frame(spark, sf, "listing").select("ord", T.subjects_text(listing_row()).alias("text"))


@query("deadline_text", f"{LISTING} SELECT ord, {DEADLINE_SQL} AS text FROM listing")
def deadline_text(spark, sf):
    return wide_frame(spark, sf, "listing").select("ord", T.deadline_text(listing_row()).alias("text"))


@query("make_chunks", f"""{CHUNKS_SQL} SELECT ord, chunk_id, section, array_to_string(tags, '|') AS tags, text, exam_date, date_sortable,
  strftime(stored_at, '%Y-%m-%d') AS stored_on, is_year_round FROM store""")
def make_chunks(spark, sf):
    made = catalog.make_chunks(wide_frame(spark, sf, "listing"), F.col("stored_at"))
    return made.select(
        "ord", "chunk_id", "section", F.array_join("tags", "|").alias("tags"), "text", "exam_date", "date_sortable",
        F.date_format("stored_at", "yyyy-MM-dd").alias("stored_on"), "is_year_round",
    )


@query("context_block", rf"""{_TOPK} SELECT query_id, string_agg('## ' || name || ' (' || section || ') — score '
  || CAST(round(CAST(norm_score AS DECIMAL(10, 4)), 2) AS VARCHAR) || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context
FROM hits JOIN chunks USING (chunk_id) GROUP BY query_id""")
def context_block(spark, sf):
    """Hits are at most eight per query, so their texts are gathered safely."""
    shown = F.round(F.col("norm_score").cast("decimal(10,4)"), 2).cast("string")
    block = F.concat(
        F.lit("## "), F.col("name"), F.lit(" ("), F.col("section"), F.lit(") — score "), shown, F.lit("\n"), F.col("text")
    )
    blocks = bm25_topk(spark, sf).join(frame(spark, sf, "chunks"), "chunk_id").select("query_id", "rank", block.alias("block"))
    gathered = F.sort_array(F.collect_list(F.struct("rank", "block")))
    return blocks.groupBy("query_id").agg(F.array_join(gathered["block"], "\n\n").alias("context"))


@query("exam_context", f"""{CHUNKS_SQL}, latest AS (SELECT * FROM store QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY stored_at DESC, ord DESC) = 1)
SELECT name, org, string_agg('[' || upper(section) || '] ' || text, chr(10) || chr(10) ORDER BY chunk_id) AS context FROM latest GROUP BY name, org""")
def exam_context(spark, sf):
    """All sections of one exam; an exam has three chunks."""
    chunks = catalog.chunk_upsert(catalog.make_chunks(wide_frame(spark, sf, "listing"), F.col("stored_at")))
    block = F.concat(F.lit("["), F.upper("section"), F.lit("] "), F.col("text"))
    gathered = F.sort_array(F.collect_list(F.struct(F.col("chunk_id"), block.alias("block"))))
    return chunks.groupBy("name", "org").agg(F.array_join(gathered["block"], "\n\n").alias("context"))


_RUN_LISTING = f"{ctes('listing', 'ranked')}, full_rows AS (SELECT r.run_id, r.position, l.* FROM ranked r JOIN listing l USING (ord))"


def _run_rows(spark, sf):
    ranked = frame(spark, sf, "ranked").select("run_id", "position", "ord")
    return ranked.join(wide_frame(spark, sf, "listing"), "ord")


@query("result_lines", f"""{_RUN_LISTING} SELECT run_id, string_agg(CAST(position + 1 AS VARCHAR) || '. **' || name || '** (' || category || ') | ' || region
  || ' | ' || array_to_string(countries[1:3], ', ') || ' | Date: ' || date || ' | Deadline: ' || deadline || ' | Diff: ' || difficulty
  || ' | Cost: ' || cost, chr(10) ORDER BY position) AS lines FROM full_rows WHERE position < 8 GROUP BY run_id""")
def result_lines(spark, sf):
    """Numbered listing of the first eight rows of each run."""
    line = F.concat(
        (F.col("position") + 1).cast("string"), F.lit(". **"), F.col("name"), F.lit("** ("), F.col("category"), F.lit(") | "),
        F.col("region"), F.lit(" | "), F.array_join(F.slice("countries", 1, 3), ", "), F.lit(" | Date: "), F.col("date"),
        F.lit(" | Deadline: "), F.col("deadline"), F.lit(" | Diff: "), F.col("difficulty"), F.lit(" | Cost: "), F.col("cost"),
    )
    top = _run_rows(spark, sf).filter("position < 8").select("run_id", "position", line.alias("line"))
    gathered = F.sort_array(F.collect_list(F.struct("position", "line")))
    return top.groupBy("run_id").agg(F.array_join(gathered["line"], "\n").alias("lines"))


@query("result_bullets", f"""{_RUN_LISTING} SELECT run_id, position, '- **' || name || '** (' || category || ') | ' || region
  || ' | ' || array_to_string(countries[1:4], ', ') || ' | Date: ' || date || ' | Deadline: ' || deadline || ' | Difficulty: ' || difficulty
  || ' | Cost: ' || cost AS line FROM full_rows""")
def result_bullets(spark, sf):
    """One bullet per result row; kept as rows because a run may have any number."""
    line = F.concat(
        F.lit("- **"), F.col("name"), F.lit("** ("), F.col("category"), F.lit(") | "), F.col("region"), F.lit(" | "),
        F.array_join(F.slice("countries", 1, 4), ", "), F.lit(" | Date: "), F.col("date"), F.lit(" | Deadline: "),
        F.col("deadline"), F.lit(" | Difficulty: "), F.col("difficulty"), F.lit(" | Cost: "), F.col("cost"),
    )
    return _run_rows(spark, sf).select("run_id", "position", line.alias("line"))


def request_row() -> dict:
    return {c: F.col(c) for c in (
        "query", "region", "category", "difficulty", "focus", "sort_by", "year", "month", "countries", "free_only", "page", "page_size"
    )}


@query("constraint_text", f"""{ctes('requests')} SELECT query_id, coalesce(nullif(concat_ws(', ',
  CASE WHEN coalesce(region, '') <> '' THEN 'region=' || region END, CASE WHEN coalesce(category, '') <> '' THEN 'category=' || category END,
  CASE WHEN coalesce(difficulty, '') <> '' THEN 'difficulty=' || difficulty END, CASE WHEN focus <> 'broad' THEN 'focus=' || focus END,
  CASE WHEN sort_by <> 'relevance' THEN 'sort=' || sort_by END, 'year=' || CAST(year AS VARCHAR), CASE WHEN coalesce(month, '') <> '' THEN 'month=' || month END,
  CASE WHEN len(countries) > 0 THEN 'countries=' || array_to_string(countries[1:3], ',') END, CASE WHEN free_only THEN 'free_only=true' END), ''), 'none') AS constraints FROM requests""")
def constraint_text(spark, sf):
    return frame(spark, sf, "requests").select("query_id", T.constraint_text(request_row()).alias("constraints"))


@query("clip_context", "SELECT doc_id, trim(substr(text, 1, 480), ' ') AS description FROM documents")
def clip_context(spark, sf):
    return provided(spark, sf, "documents").select("doc_id", T.clipped_context(F.col("text")).alias("description"))


@query("request_key", f"""{ctes('requests')} SELECT query_id, substr(sha256(trim(lower(query), ' ') || '|' || lower(coalesce(region, '')) || '|' || lower(coalesce(category, ''))
  || '|' || lower(coalesce(difficulty, ''))), 1, 16) AS key FROM requests""")
def request_key(spark, sf):
    key = T.request_key(F.col("query"), F.col("region"), F.col("category"), F.col("difficulty"))
    return frame(spark, sf, "requests").select("query_id", key.alias("key"))


def sanitised_sql(text: str) -> str:
    hidden = r"[\x00-\x08\x0B-\x1F\x7F-\x{9F}]|\p{Cf}|\p{Co}"
    return rf"trim(regexp_replace(regexp_replace({text}, '{hidden}', '', 'g'), '[\s\x{{A0}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{3000}}]+', ' ', 'g'), ' ')"


@query("sanitise", f"{ctes('guard_requests')} SELECT query_id, {sanitised_sql('query')} AS clean FROM guard_requests")
def sanitise(spark, sf):
    return frame(spark, sf, "guard_requests").select("query_id", T.sanitised(F.col("query")).alias("clean"))


@query("sanitise_pages", f"SELECT page_id, {sanitised_sql('html')} AS clean FROM pages")
def sanitise_pages(spark, sf):
    return provided(spark, sf, "pages").select("page_id", T.sanitised(F.col("html")).alias("clean"))


@query("identity_key", f"""{LISTING} SELECT ord, {squeezed_sql("'  ' || upper(name) || '  x '")} || '|' || {squeezed_sql('org')} AS key, lower(name) || '|' || lower(org) AS plain FROM listing""")
def identity_key(spark, sf):
    loud = F.concat(F.lit("  "), F.upper("name"), F.lit("  x "))
    return wide_frame(spark, sf, "listing").select(
        "ord", T.identity_key(loud, F.col("org")).alias("key"), T.fingerprint(F.col("name"), F.col("org")).alias("plain")
    )


_VIEW = """view_filters AS (SELECT query_id, CASE WHEN query_id % 3 = 0 THEN ' ' ELSE query END AS query,
  CASE WHEN query_id % 2 = 0 THEN coalesce(region, 'All') ELSE 'All' END AS region,
  CASE WHEN query_id % 5 = 0 THEN coalesce(difficulty, 'All') ELSE 'All' END AS difficulty,
  coalesce(month, 'Any month') AS month, coalesce(CAST(year AS STRING), 'Any year') AS year, free_only FROM requests)"""


@query("contextual_query", f"""{ctes('requests')}, {_VIEW}, parts AS (SELECT *, concat_ws(' ', CASE WHEN region <> 'All' THEN region END,
  CASE WHEN difficulty <> 'All' THEN lower(difficulty) END, CASE WHEN month <> 'Any month' THEN month END,
  CASE WHEN year <> 'Any year' THEN year END, CASE WHEN free_only THEN 'free' END) AS parts FROM view_filters)
SELECT query_id, coalesce(nullif(trim(query, ' '), ''), CASE WHEN parts <> '' THEN parts || ' examinations' END, 'popular global examinations') AS effective FROM parts""")
def contextual_query(spark, sf):
    rows = frame(spark, sf, "requests").selectExpr(
        "query_id", "CASE WHEN query_id % 3 = 0 THEN ' ' ELSE query END AS query",
        "CASE WHEN query_id % 2 = 0 THEN coalesce(region, 'All') ELSE 'All' END AS region",
        "CASE WHEN query_id % 5 = 0 THEN coalesce(difficulty, 'All') ELSE 'All' END AS difficulty",
        "coalesce(month, 'Any month') AS month", "coalesce(CAST(year AS STRING), 'Any year') AS year", "free_only",
    )
    effective = T.contextual_query(*[F.col(c) for c in ("query", "region", "difficulty", "month", "year", "free_only")])
    return rows.select("query_id", effective.alias("effective"))


@query("bold_terms", rf"""{_RUN_LISTING}, summaries AS (SELECT run_id, position, 'Try **' || name || '** by ' || org || ' or **' || category || '**.' AS s FROM full_rows)
SELECT run_id, position, array_to_string(regexp_extract_all(s, '\*\*(.+?)\*\*', 1), '|') AS terms, regexp_replace(s, '\*\*(.+?)\*\*', '<strong>\1</strong>', 'g') AS html FROM summaries""")
def bold_terms(spark, sf):
    text = F.concat(F.lit("Try **"), F.col("name"), F.lit("** by "), F.col("org"), F.lit(" or **"), F.col("category"), F.lit("**."))
    rows = _run_rows(spark, sf).select("run_id", "position", text.alias("s"))
    return rows.select(
        "run_id", "position", F.array_join(T.bold_terms(F.col("s")), "|").alias("terms"), T.bold_to_html(F.col("s")).alias("html")
    )
