"""Input and output data-quality rules as bulk jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from termwell.functions import guards as G
from termwell.functions import text as T
from termwell.operators import quality
from termwell.operators.layout import spread
from termwell.plans.intent_queries import lit, words_apart
from termwell.plans.registry import query
from termwell.plans.tables import ctes, provided, wide_frame
from termwell.plans.text_queries import sanitised_sql
from termwell.vocab import guard_rules as rules
from termwell.vocab.listing import CATEGORIES, DIFFICULTIES, MONTHS, REGIONS, SORT_MODES


def _in(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def matches(pattern: str, text: str = "w", ignore_case: bool = True) -> str:
    option = ", 'i'" if ignore_case else ""
    return f"regexp_matches({text}, {lit(pattern)}{option})"


def injection_sql() -> str:
    """RE2 has no look-ahead: such a pattern matches without it, and not with the
    excluded words in its place."""
    parts = []
    for pattern in rules.INJECTION_PATTERNS:
        if "(?!" not in pattern:
            parts.append(matches(pattern))
            continue
        before, rest = pattern.split("(?!", 1)
        depth, end = 1, 0
        while depth:
            depth += {"(": 1, ")": -1}.get(rest[end], 0)
            end += 1
        excluded, after = rest[:end - 1], rest[end:]
        parts.append(f"({matches(before + after)} AND NOT {matches(before + '(?:' + excluded + ')')})")
    return "(" + " OR ".join(parts) + ")"


def any_sql(patterns) -> str:
    return "(" + " OR ".join(matches(p) for p in patterns) + ")"


NO_SPACE = r"regexp_replace({0}, '\s+', '', 'g')"
REPEAT_SQL = r"""(coalesce(list_max(list_transform(list_distinct(string_split_regex(trim(lower(clean), ' '), '\s+')),
    lambda t: len(list_filter(string_split_regex(trim(lower(clean), ' '), '\s+'), lambda x: x = t)))), 0) > 6
  OR (length(packed) > 8 AND list_max(list_transform(list_distinct(string_split(packed, '')), lambda c: length(packed) - length(replace(packed, c, '')))) > 0.7::DOUBLE * length(packed)))"""
OFF_TOPIC_SQL = f"""(length(trim(clean, ' ')) > 15 AND NOT list_has_any(regexp_extract_all(lower(clean), '[a-z]+'), [{', '.join(lit(w) for w in rules.EDUCATION_WORDS)}])
  AND {any_sql(rules.OFF_TOPIC_PATTERNS)})"""
PII_SQL = f"({matches(rules.EMAIL_PATTERN, 'clean', False)} OR {matches(rules.PHONE_PATTERN, 'clean', False)})"
GIBBERISH_SQL = r"(length(clean) >= 10 AND length(regexp_replace(clean, '[^\pL\s]', '', 'g')) / length(clean)::DOUBLE < 0.4)"
CONTROL_SQL = r"regexp_matches(query, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]|\p{Cf}|\p{Co}')"
REGION_SQL = f"(coalesce(region, '') <> '' AND lower(region) NOT IN {_in(r.lower() for r in REGIONS)})"
DIFFICULTY_SQL = f"(coalesce(difficulty, '') <> '' AND lower(difficulty) NOT IN {_in(d.lower() for d in DIFFICULTIES)})"


def _cleaned(source: str) -> str:
    return f"""cleaned AS (SELECT *, {sanitised_sql('query')} AS clean FROM {source}),
marked AS (SELECT *, {words_apart('clean')} AS w, {NO_SPACE.format('lower(clean)')} AS packed FROM cleaned)"""


REQUEST_BASE = f"{ctes('guard_requests')}, {_cleaned('guard_requests')}"
DOC_BASE = f"WITH docs AS (SELECT doc_id AS query_id, text AS query FROM documents), {_cleaned('docs')}"


def _requests(spark, sf):
    rows = wide_frame(spark, sf, "guard_requests")
    return rows.withColumn("clean", T.sanitised(F.col("query")))


def _documents(spark, sf):
    docs = spread(provided(spark, sf, "documents")).select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))
    return docs.withColumn("clean", T.sanitised(F.col("query")))


def _rule(name: str, sql: str, column, documents: bool = False) -> None:
    """A rule over the guarded requests, or over whole documents."""
    base, rows = (DOC_BASE, _documents) if documents else (REQUEST_BASE, _requests)

    @query(name, f"{base} SELECT query_id, {sql} AS broken FROM marked")
    def run(spark, sf):
        return rows(spark, sf).select("query_id", column().alias("broken"))


_clean = F.col
_rule("guard_empty", "clean = ''", lambda: G.empty(_clean("clean")))
_rule("guard_short", f"length({NO_SPACE.format('clean')}) < 2", lambda: G.too_short(_clean("clean")))
_rule("guard_long", "length(clean) > 500", lambda: G.too_long(_clean("clean")))
_rule("guard_control", CONTROL_SQL, lambda: G.control_chars(_clean("query")))
_rule("guard_repeat", REPEAT_SQL, lambda: G.excessive_repeat(_clean("clean")))
_rule("guard_prompt_injection", injection_sql(), lambda: G.prompt_injection(_clean("clean")))
_rule("guard_script", any_sql(rules.SCRIPT_PATTERNS), lambda: G.script_injection(_clean("clean")))
_rule("guard_offtopic", OFF_TOPIC_SQL, lambda: G.off_topic(_clean("clean")))
_rule("guard_pii", PII_SQL, lambda: G.personal_data(_clean("clean")), documents=True)
_rule("guard_gibberish", GIBBERISH_SQL, lambda: G.gibberish(_clean("clean")))
_rule("guard_short_documents", f"length({NO_SPACE.format('clean')}) < 2 OR length(clean) > 500",
      lambda: G.too_short(_clean("clean")) | G.too_long(_clean("clean")), documents=True)


@query("guard_repeat_documents", f"""{DOC_BASE}, words AS (SELECT query_id, unnest(string_split_regex(trim(lower(clean), ' '), '\\s+')) AS t FROM marked),
chars AS (SELECT query_id, unnest(string_split(packed, '')) AS c FROM marked), word_max AS (SELECT query_id, max(n) AS n FROM (SELECT query_id, t, count(*) AS n FROM words WHERE t <> '' GROUP BY 1, 2) GROUP BY 1),
char_max AS (SELECT query_id, max(n) AS n FROM (SELECT query_id, c, count(*) AS n FROM chars GROUP BY 1, 2) GROUP BY 1)
SELECT m.query_id, coalesce(w.n, 0) > 6 OR (length(packed) > 8 AND coalesce(c.n, 0) > 0.7::DOUBLE * length(packed)) AS broken
FROM marked m LEFT JOIN word_max w USING (query_id) LEFT JOIN char_max c USING (query_id)""")
def guard_repeat_documents(spark, sf):
    return _documents(spark, sf).select("query_id", G.excessive_repeat(F.col("clean")).alias("broken"))


@query("guard_filters", f"""{ctes('guard_requests')} SELECT query_id, {REGION_SQL} AS bad_region, {DIFFICULTY_SQL} AS bad_difficulty,
  coalesce(length(category) > 80, false) AS bad_category FROM guard_requests""")
def guard_filters(spark, sf):
    return wide_frame(spark, sf, "guard_requests").select(
        "query_id", G.invalid_region(F.col("region")).alias("bad_region"),
        G.invalid_difficulty(F.col("difficulty")).alias("bad_difficulty"), G.invalid_category(F.col("category")).alias("bad_category"),
    )


_BLOCKS = {
    "EMPTY_QUERY": "clean = ''", "QUERY_TOO_SHORT": f"length({NO_SPACE.format('clean')}) < 2", "QUERY_TOO_LONG": "length(clean) > 500",
    "CONTROL_CHARS": CONTROL_SQL, "EXCESSIVE_REPEAT": REPEAT_SQL, "PROMPT_INJECTION": injection_sql(),
    "SCRIPT_INJECTION": any_sql(rules.SCRIPT_PATTERNS), "OFF_TOPIC": OFF_TOPIC_SQL, "GIBBERISH": GIBBERISH_SQL,
    "INVALID_REGION": REGION_SQL, "INVALID_DIFFICULTY": DIFFICULTY_SQL, "INVALID_CATEGORY": "length(category) > 80",
}
_SEVERITY = "CASE code " + " ".join(f"WHEN '{c}' THEN '{s}'" for c, s in rules.INPUT_BLOCKS) + " WHEN 'PII_DETECTED' THEN 'low' END"
VERDICT_SQL = f"""{REQUEST_BASE}, blocked AS (SELECT *, CASE {' '.join(f"WHEN {sql} THEN '{code}'" for code, sql in _BLOCKS.items())} END AS block, {PII_SQL} AS pii FROM marked),
verdicts AS (SELECT *, CASE WHEN block IS NOT NULL THEN 'block' WHEN pii THEN 'warn' ELSE 'pass' END AS action,
  coalesce(block, CASE WHEN pii THEN 'PII_DETECTED' END) AS code FROM blocked)"""


@query("guard_verdict", f"""{VERDICT_SQL} SELECT query_id, action, code, {_SEVERITY} AS severity,
  CASE WHEN action <> 'block' AND clean <> query THEN clean END AS sanitised_query FROM verdicts""")
def guard_verdict(spark, sf):
    return quality.check_input(wide_frame(spark, sf, "guard_requests")).select("query_id", "action", "code", "severity", "sanitised_query")


GUARDED = ctes("guarded_listing")
_RUN7 = " OR ".join(f"contains(name, '{c * 7}')" for c in "abcdefghijklmnopqrstuvwxyz0123456789 !#-")
_NAME_SQL = "(" + " OR ".join(
    f"({_RUN7})" if r"\1" in p else matches(p, "name", ignore) for p, ignore in rules.BAD_NAME_PATTERNS
) + ")"
_MISSING_SQL = "CASE " + " ".join(f"WHEN trim(coalesce({c}, ''), ' ') = '' THEN '{c}'" for c in ("name", "org", "category")) + " END"
_COST_SQL = matches(rules.BAD_COST_PATTERN, "coalesce(cost, '')", False)
_URL_SQL = f"(coalesce(website, '') <> '' AND NOT {matches(rules.URL_PATTERN, 'website', False)})"
_THIN_SQL = "(coalesce(description, '') <> '' AND length(trim(description, ' ')) < 20)"


def _output_rule(name: str, sql: str, column) -> None:
    @query(name, f"{GUARDED} SELECT ord, {sql} AS broken FROM guarded_listing")
    def run(spark, sf):
        return wide_frame(spark, sf, "guarded_listing").select("ord", column().alias("broken"))


_output_rule("out_required", _MISSING_SQL, lambda: G.missing_required(F.col("name"), F.col("org"), F.col("category")))
_output_rule("out_name", f"{_NAME_SQL} OR length(trim(name, ' ')) NOT BETWEEN 2 AND 200", lambda: G.bad_name_pattern(F.col("name")) | G.bad_name_length(F.col("name")))
_output_rule("out_vocab", f"region NOT IN {_in(REGIONS)} OR difficulty NOT IN {_in(DIFFICULTIES)}", lambda: ~F.col("region").isin(REGIONS) | ~F.col("difficulty").isin(DIFFICULTIES))
_output_rule("out_cost", f"CASE WHEN {_COST_SQL} THEN 'block' WHEN length(cost) > 100 THEN 'warn' END",
             lambda: F.when(G.bad_cost(F.col("cost")), F.lit("block")).when(G.long_cost(F.col("cost")), F.lit("warn")))
_output_rule("out_url", _URL_SQL, lambda: G.malformed_url(F.col("website")))
_output_rule("out_description", _THIN_SQL, lambda: G.thin_description(F.col("description")))

_DUPLICATE = "row_number() OVER (PARTITION BY trim(lower(name), ' '), trim(lower(org), ' ') ORDER BY ord) > 1"


@query("out_duplicate", f"{GUARDED} SELECT ord, {_DUPLICATE} AS duplicate FROM guarded_listing")
def out_duplicate(spark, sf):
    return quality.mark_duplicates(wide_frame(spark, sf, "guarded_listing")).select("ord", "duplicate")


_CHECKED = f"""{GUARDED}, dup AS (SELECT *, {_DUPLICATE} AS duplicate, {_MISSING_SQL} AS missing FROM guarded_listing),
checked AS (SELECT ord, name, CASE WHEN duplicate THEN 'DUPLICATE_IN_RESULTS' WHEN missing IS NOT NULL THEN 'MISSING_REQUIRED_FIELDS'
  WHEN {_NAME_SQL} OR length(trim(name, ' ')) NOT BETWEEN 2 AND 200 THEN 'SUSPICIOUS_NAME' WHEN region NOT IN {_in(REGIONS)} THEN 'INVALID_REGION'
  WHEN difficulty NOT IN {_in(DIFFICULTIES)} THEN 'INVALID_DIFFICULTY' WHEN {_COST_SQL} THEN 'IMPLAUSIBLE_COST' END AS block,
  list_filter([CASE WHEN length(cost) > 100 THEN 'IMPLAUSIBLE_COST' END, CASE WHEN {_URL_SQL} THEN 'MALFORMED_URL' END, CASE WHEN {_THIN_SQL} THEN 'THIN_DESCRIPTION' END], lambda x: x IS NOT NULL) AS warns FROM dup)"""


@query("out_violations", f"""{_CHECKED} SELECT ord, unnest(CASE WHEN block IS NOT NULL THEN [block] ELSE warns END) AS code,
  CASE WHEN block IS NOT NULL THEN 'block' ELSE 'warn' END AS action FROM checked""")
def out_violations(spark, sf):
    checked = quality.check_output(wide_frame(spark, sf, "guarded_listing"))
    return quality.output_violations(checked).select("ord", "code", "action")


@query("out_summary", f"""{_CHECKED} SELECT count(*) AS total_input, count(*) FILTER (WHERE block IS NULL AND len(warns) = 0) AS total_passed,
  count(*) FILTER (WHERE block IS NOT NULL) AS total_blocked, count(*) FILTER (WHERE block IS NULL AND len(warns) > 0) AS total_warned,
  CAST(sum(CASE WHEN block IS NOT NULL THEN 1 ELSE len(warns) END) AS BIGINT) AS total_violations FROM checked""")
def out_summary(spark, sf):
    return quality.output_summary(quality.check_output(wide_frame(spark, sf, "guarded_listing")))


REQUEST_FIELD_SQL = f"""CASE WHEN query IS NULL OR length(trim(query, ' ')) < 1 OR length(query) > 500 OR regexp_matches(query, '<[^>]+>') THEN 'query'
  WHEN region NOT IN {_in(REGIONS)} THEN 'region' WHEN category NOT IN {_in(CATEGORIES)} THEN 'category'
  WHEN difficulty NOT IN {_in(DIFFICULTIES)} THEN 'difficulty' WHEN sort_by NOT IN {_in(SORT_MODES)} THEN 'sort_by'
  WHEN page NOT BETWEEN 1 AND 100 THEN 'page' WHEN page_size NOT BETWEEN 1 AND 50 THEN 'page_size' WHEN year NOT BETWEEN 2020 AND 2035 THEN 'year'
  WHEN month NOT IN {_in(MONTHS)} THEN 'month' WHEN len(countries) > 20 OR len(list_filter(countries, lambda c: length(c) > 60)) > 0 THEN 'countries' END"""


@query("request_schema", f"{ctes('requests')} SELECT query_id, {REQUEST_FIELD_SQL} AS invalid_field FROM requests")
def request_schema(spark, sf):
    return quality.check_requests(wide_frame(spark, sf, "requests")).select("query_id", "invalid_field")
