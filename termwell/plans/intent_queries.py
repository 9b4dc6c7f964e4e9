"""Query understanding over a table of questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from termwell.functions import intent as I
from termwell.functions import text as T
from termwell.operators import validate
from termwell.plans.registry import query
from termwell.plans.tables import ctes, wide_frame
from termwell.plans.text_queries import request_row
from termwell.sources import payloads
from termwell.vocab import query_rules as rules
from termwell.vocab.listing import MONTHS
from termwell.vocab.runs import STAGES


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def texts(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


# RE2 sees a word boundary beside an accented letter. With every such letter put
# between underscores its boundaries agree with Unicode ones; ``plain`` undoes it.
def words_apart(text: str) -> str:
    return rf"regexp_replace({text}, '([À-ÖØ-öø-ɏ])', '_\1_', 'g')"


def plain(text: str) -> str:
    return rf"regexp_replace({text}, '_([À-ÖØ-öø-ɏ])_', '\1', 'g')"


def has(pattern: str, text: str = "w") -> str:
    return f"regexp_matches({text}, {lit(pattern)}, 'i')"


def first_sql(pairs, default: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {has(p)} THEN {lit(v)}" for p, v in pairs) + f" ELSE {default} END"


def all_sql(pairs) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {has(p)} THEN {lit(v)} END" for p, v in pairs) + "], lambda x: x IS NOT NULL)"


def lookup_sql(table: dict[str, str], key: str) -> str:
    return f"map({texts(table)}, {texts(table.values())})[{key}]"


MONTH_NAMES = {m.lower(): m for m in MONTHS} | {m[:3].lower(): m for m in MONTHS}
SORT_SQL = first_sql(rules.SORT_RULES, "'relevance'")
FREE_SQL = has(rules.FREE_PATTERN)
YEAR_SQL = f"TRY_CAST(nullif(regexp_extract(w, {lit(rules.YEAR_PATTERN)}, 1), '') AS INT)"
MONTH_SQL = lookup_sql(MONTH_NAMES, f"lower(regexp_extract(w, {lit(rules.MONTH_PATTERN)}, 1, 'i'))")
COUNTRIES_SQL = "list_filter([" + ", ".join(
    f"CASE WHEN contains(lower(text), {lit(c)}) THEN {lit(c.title())} END" for c in sorted(rules.COUNTRIES)
) + "], lambda x: x IS NOT NULL)"
CATEGORY_SQL = first_sql(rules.CATEGORY_RULES)
WORDS_SQL = r"regexp_extract_all(lower(w), '\b[a-z]+\b')"
ACRONYMS_SQL = f"list_transform(list_filter({WORDS_SQL}, lambda x: list_contains({texts(rules.ACRONYMS)}, x)), lambda x: upper(x))"
PHRASES_SQL = all_sql([(p, p[:40]) for p, _ in rules.PHRASE_RULES])
NOISE_SQL = plain(rf"regexp_replace(trim(regexp_replace(w, {lit(rules.NOISE_PATTERN)}, '', 'gi'), ' '), '\s+', ' ', 'g')")
PHRASE_TEXT_SQL = all_sql(rules.PHRASE_RULES)
SYNONYM_SQL = (
    f"list_transform(list_filter({texts(rules.SYNONYMS)}, lambda s: list_contains({WORDS_SQL}, s)), "
    f"lambda s: {lookup_sql(rules.SYNONYMS, 's')})"
)
ACRONYM_TEXT_SQL = f"list_transform({ACRONYMS_SQL}, lambda a: {lookup_sql(rules.ACRONYMS, 'lower(a)')})"
COMBO_SQL = "list_filter([" + ", ".join(
    f"CASE WHEN {has(a)} AND {has(b)} THEN {lit(t)} END" for a, b, t in rules.PLACE_SUBJECT_RULES
) + "], lambda x: x IS NOT NULL)"
DOMAINS_SQL = f"CASE WHEN len({all_sql(rules.DOMAIN_RULES)}) > 0 THEN {all_sql(rules.DOMAIN_RULES)} ELSE ['Unknown'] END"

BASE = f"{ctes('questions')}, q AS (SELECT query_id, text, {words_apart('text')} AS w FROM questions)"


def _questions(spark, sf):
    return wide_frame(spark, sf, "questions")


def _signal(name: str, sql: str, column):
    @query(name, f"{BASE} SELECT query_id, {sql} AS signal FROM q")
    def run(spark, sf):
        return _questions(spark, sf).select("query_id", column(F.col("text")).alias("signal"))

    return run


_signal("intent_sort", SORT_SQL, I.sort_hint)
_signal("intent_free", FREE_SQL, I.free_hint)
_signal("intent_year", YEAR_SQL, I.year_hint)
_signal("intent_month", MONTH_SQL, I.month_hint)
_signal("intent_countries", f"array_to_string({COUNTRIES_SQL}, ', ')", lambda c: F.array_join(I.country_hints(c), ", "))
_signal("intent_category", CATEGORY_SQL, I.category_hint)
_signal("intent_acronyms", f"array_to_string({ACRONYMS_SQL}, ' ')", lambda c: F.array_join(I.acronyms_found(c), " "))
_signal("intent_phrases", f"array_to_string({PHRASES_SQL}, ' ')", lambda c: F.array_join(I.phrase_matches(c), " "))
_signal("strip_noise", NOISE_SQL, I.strip_noise)
_signal("expand_phrase", f"array_to_string({PHRASE_TEXT_SQL}, '; ')", lambda c: F.array_join(I.phrase_expansions(c), "; "))
_signal("expand_synonym", f"array_to_string({SYNONYM_SQL}, '; ')", lambda c: F.array_join(I.synonym_expansions(c), "; "))
_signal("expand_acronym", f"array_to_string({ACRONYM_TEXT_SQL}, '; ')", lambda c: F.array_join(I.acronym_expansions(c), "; "))
_signal("expand_combo", f"array_to_string({COMBO_SQL}, '; ')", lambda c: F.array_join(I.combo_expansions(c), "; "))
_signal("expand_category", f"coalesce({CATEGORY_SQL}, '')", lambda c: F.array_join(I.category_expansions(c), "; "))
_signal("detect_domains", f"array_to_string({DOMAINS_SQL}, ', ')", lambda c: F.array_join(I.detect_domains(c), ", "))


@query("intent_struct", f"""{BASE} SELECT query_id, {SORT_SQL} AS sort_hint, {FREE_SQL} AS free_hint, {YEAR_SQL} AS year_hint, {MONTH_SQL} AS month_hint,
  array_to_string({COUNTRIES_SQL}, ', ') AS country_hints, {CATEGORY_SQL} AS category_hint, array_to_string({ACRONYMS_SQL}, ' ') AS acronyms_found,
  len({PHRASES_SQL}) AS phrases FROM q""")
def intent_struct(spark, sf):
    signals = _questions(spark, sf).select("query_id", I.intent(F.col("text")).alias("s"))
    return signals.select(
        "query_id", "s.sort_hint", "s.free_hint", "s.year_hint", "s.month_hint",
        F.array_join("s.country_hints", ", ").alias("country_hints"), "s.category_hint",
        F.array_join("s.acronyms_found", " ").alias("acronyms_found"), F.size("s.phrase_matches").alias("phrases"),
    )


EXPAND_SQL = rf"""{ctes('questions').replace('WITH', 'WITH RECURSIVE', 1)}, q AS (SELECT query_id, text, {words_apart('text')} AS w FROM questions),
layers AS (SELECT query_id, text, {NOISE_SQL} AS base, list_concat({PHRASE_TEXT_SQL}, {SYNONYM_SQL}, {ACRONYM_TEXT_SQL}, {COMBO_SQL},
  CASE WHEN {CATEGORY_SQL} IS NULL THEN [] ELSE [{CATEGORY_SQL}] END) AS candidates FROM q),
fold AS (
  SELECT query_id, 0 AS i, candidates, list_distinct(regexp_extract_all(lower(base), '[a-z0-9]+')) AS seen, []::VARCHAR[] AS added FROM layers
  UNION ALL
  SELECT query_id, i + 1, candidates,
    list_distinct(list_concat(seen, string_split(lower(candidates[i + 1]), ' '))),
    CASE WHEN len(list_filter(string_split(lower(candidates[i + 1]), ' '), lambda t: NOT list_contains(seen, t))) > 0
         THEN list_append(added, candidates[i + 1]) ELSE added END
  FROM fold WHERE i < len(candidates)),
expanded AS (SELECT query_id, text, trim(regexp_replace(concat_ws(' ', base, array_to_string(added, ' ')), '\s+', ' ', 'g'), ' ') AS expanded
  FROM fold JOIN layers USING (query_id) WHERE i = len(fold.candidates))"""


@query("expand_query", f"{EXPAND_SQL} SELECT query_id, expanded FROM expanded")
def expand_query(spark, sf):
    return _questions(spark, sf).select("query_id", I.expand_query(F.col("text")).alias("expanded"))


@query("expansion_ratio", f"{EXPAND_SQL} SELECT query_id, round(length(expanded) / greatest(length(text), 1)::DOUBLE, 6) AS ratio FROM expanded")
def expansion_ratio(spark, sf):
    rows = _questions(spark, sf).withColumn("expanded", I.expand_query(F.col("text")))
    return rows.select("query_id", F.round(I.expansion_ratio(F.col("text"), F.col("expanded")), 6).alias("ratio"))


REQUESTS = f"{ctes('requests')}, q AS (SELECT *, query AS text, {words_apart('query')} AS w FROM requests)"
EFFECTIVE_SQL = f"""{REQUESTS}, effective AS (SELECT query_id, region, difficulty,
  CASE WHEN sort_by <> 'relevance' THEN sort_by ELSE {SORT_SQL} END AS sort_by, free_only OR {FREE_SQL} AS free_only,
  coalesce(nullif(year, 0), {YEAR_SQL}) AS year, coalesce(nullif(month, ''), {MONTH_SQL}) AS month,
  CASE WHEN len(countries) > 0 THEN countries ELSE {COUNTRIES_SQL} END AS countries, coalesce(nullif(category, ''), {CATEGORY_SQL}) AS category FROM q)"""


def _effective(spark, sf):
    requests = wide_frame(spark, sf, "requests").withColumn("signals", I.intent(F.col("query")))
    params = I.effective_params(request_row(), F.col("signals"))
    return requests.select("query_id", "region", "difficulty", *[value.alias(name) for name, value in params.items()])


@query("effective_params", f"{EFFECTIVE_SQL} SELECT query_id, sort_by, free_only, year, month, array_to_string(countries, ', ') AS countries, category FROM effective")
def effective_params(spark, sf):
    return _effective(spark, sf).withColumn("countries", F.array_join("countries", ", ")).drop("region", "difficulty")


def _shown(names: dict[str, str]) -> str:
    items = ", ".join(f"CASE WHEN coalesce({sql}, '') <> '' THEN '{name}=' || {sql} END" for name, sql in names.items())
    return f"array_to_string(list_sort(list_filter([{items}], lambda x: x IS NOT NULL)), ', ')"


def _map_text(column):
    return F.array_join(F.sort_array(F.transform(F.map_entries(column), lambda e: F.concat_ws("=", e["key"], e["value"]))), ", ")


_FILTER_TEXT = _shown({
    "region": "region", "category": "category", "difficulty": "difficulty", "year": "CAST(year AS VARCHAR)", "month": "month",
    "countries": "array_to_string(countries, ', ')", "free_only": "CASE WHEN free_only THEN 'true' END",
})


@query("filters_applied", f"{EFFECTIVE_SQL} SELECT query_id, {_FILTER_TEXT} AS filters FROM effective")
def filters_applied(spark, sf):
    rows = _effective(spark, sf)
    applied = I.filters_applied({c: F.col(c) for c in rows.columns})
    return rows.select("query_id", _map_text(applied).alias("filters"))


_ACTIVE_TEXT = _shown({
    "sort_hint": f"nullif({SORT_SQL}, 'relevance')", "free_hint": f"CASE WHEN {FREE_SQL} THEN 'true' END",
    "year_hint": f"CAST({YEAR_SQL} AS VARCHAR)", "month_hint": MONTH_SQL, "country_hints": f"array_to_string({COUNTRIES_SQL}, ', ')",
    "category_hint": CATEGORY_SQL, "acronyms_found": f"array_to_string({ACRONYMS_SQL}, ', ')",
    "phrase_matches": f"array_to_string({PHRASES_SQL}, ', ')",
})


@query("active_signals", f"{BASE} SELECT query_id, {_ACTIVE_TEXT} AS active FROM q")
def active_signals(spark, sf):
    rows = _questions(spark, sf).withColumn("signals", I.intent(F.col("text")))
    return rows.select("query_id", _map_text(I.active_signals(F.col("signals"))).alias("active"))


_HINTS = f"""list_filter([CASE WHEN {SORT_SQL} <> 'relevance' THEN 'Sort by: ' || {SORT_SQL} END,
  CASE WHEN {FREE_SQL} THEN 'Only return free or zero-cost exams (cost_usd = 0)' END, 'Prefer exams with dates in ' || CAST({YEAR_SQL} AS VARCHAR),
  'Prefer exams scheduled in ' || {MONTH_SQL}, CASE WHEN len({COUNTRIES_SQL}) > 0 THEN 'Must be available in at least one of: ' || array_to_string({COUNTRIES_SQL}, ', ') END,
  CASE WHEN {CATEGORY_SQL} IS NOT NULL AND coalesce(category, '') = '' THEN 'Likely category: ' || {CATEGORY_SQL} END], lambda x: x IS NOT NULL)"""
_STRICT = "list_filter([" + ", ".join(
    f"CASE WHEN lower(coalesce({c}, '')) NOT IN ('all', '') THEN '{c.title()}: ' || {c} END" for c in ("region", "category", "difficulty")
) + "], lambda x: x IS NOT NULL)"


def _block(title: str, items: str) -> str:
    return f"CASE WHEN len({items}) > 0 THEN chr(10) || '{title}' || chr(10) || array_to_string(list_transform({items}, lambda i: '- ' || i), chr(10)) END"


@query("prompt_text", f"""{REQUESTS} SELECT query_id, concat_ws(chr(10), 'Search query: ' || query, {_block('Search intent (honour these):', _HINTS)},
  {_block('Strict filters:', _STRICT)}, chr(10) || 'Return JSON array now.') AS prompt FROM q""")
def prompt_text(spark, sf):
    rows = wide_frame(spark, sf, "requests").withColumn("signals", I.intent(F.col("query"))).select("*", "signals.*")
    names = ("query", "region", "category", "difficulty", "sort_hint", "free_hint", "year_hint", "month_hint", "country_hints", "category_hint")
    return rows.select("query_id", T.prompt_text({c: F.col(c) for c in names}).alias("prompt"))


_STAGE_VALUES = ", ".join(f"({n}, {lit(s)}, {lit(a)}, {lit(r)}, {k})" for n, (s, a, r, k) in enumerate(STAGES, start=1))
PLANS_SQL = f"""plans AS (SELECT query_id, domains, len(domains) > 1 AS is_cross_domain, CASE WHEN len(domains) > 1 THEN 3 ELSE 2 END AS min_items,
  CASE WHEN len(domains) > 1 THEN 0.6::DOUBLE ELSE 0 END AS min_coverage, CASE WHEN len(domains) > 1 THEN 0.35::DOUBLE ELSE 0.45 END AS min_result_quality
  FROM (SELECT query_id, {DOMAINS_SQL} AS domains FROM q))"""


@query("plan_rules", f"""{BASE}, {PLANS_SQL} SELECT query_id, array_to_string(domains, ', ') AS domains, is_cross_domain, min_items, min_coverage, min_result_quality,
  stage_no, stage, agent, rollback_strategy, max_retries FROM plans, (VALUES {_STAGE_VALUES}) AS s(stage_no, stage, agent, rollback_strategy, max_retries)""")
def plan_rules(spark, sf):
    planned = validate.plan_rules(_questions(spark, sf))
    return validate.stage_rows(planned).withColumn("domains", F.array_join("domains", ", "))


_PLAN_TEXTS = f"""{ctes('requests')}, raws AS (SELECT *, CASE query_id % 5 WHEN 0 THEN 'no json' WHEN 1 THEN '{{"shards": []}}'
  WHEN 2 THEN '{{"intent": "find", "shards": [{{"query": "a ' || query_id || '", "region": "Asia", "focus": "geography"}}, {{"query": "b", "category": ""}}], "enrich_top_n": 4}}'
  WHEN 3 THEN '{{"shards": [{{"focus": "category", "difficulty": "Hard"}}, null]}}' ELSE '{{"intent": "x", "enrich_top_n": 1}}' END AS raw FROM requests)"""


@query("shard_rows", f"""{_PLAN_TEXTS}, shards AS (
  SELECT r.*, CASE WHEN json_valid(raw) THEN raw::JSON END AS plan FROM raws r),
items AS (SELECT *, list_filter(json_extract(plan, '$.shards[*]'), lambda s: json_type(s) = 'OBJECT') AS parts FROM shards),
one AS (SELECT *, unnest(CASE WHEN coalesce(len(parts), 0) = 0 THEN [NULL] ELSE parts END) AS part, unnest(range(greatest(coalesce(len(parts), 0), 1))) AS shard_no FROM items)
SELECT query_id, CAST(shard_no AS INT) AS shard_no, coalesce(part->>'$.query', query) AS query,
  coalesce(nullif(part->>'$.region', ''), region) AS region, coalesce(nullif(part->>'$.category', ''), category) AS category,
  coalesce(nullif(part->>'$.difficulty', ''), difficulty) AS difficulty, coalesce(part->>'$.focus', 'broad') AS focus,
  coalesce(plan->>'$.intent', query) AS intent, coalesce(CAST(plan->>'$.enrich_top_n' AS INT), 2) AS enrich_top_n FROM one""")
def shard_rows(spark, sf):
    raw = F.expr("""CASE query_id % 5 WHEN 0 THEN 'no json' WHEN 1 THEN '{"shards": []}'
      WHEN 2 THEN concat('{"intent": "find", "shards": [{"query": "a ', query_id, '", "region": "Asia", "focus": "geography"}, {"query": "b", "category": ""}], "enrich_top_n": 4}')
      WHEN 3 THEN '{"shards": [{"focus": "category", "difficulty": "Hard"}, null]}' ELSE '{"intent": "x", "enrich_top_n": 1}' END""")
    return payloads.shard_rows(wide_frame(spark, sf, "requests").withColumn("raw", raw))
