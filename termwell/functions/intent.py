"""Query understanding: structured signals and rule-based expansion of a query.

Every rule is evaluated inside the row, so a whole query table is one narrow
projection without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from termwell.functions.literals import no_texts, sql_text, text_array, text_map
from termwell.functions.patterns import FLAGS_IGNORE_CASE, first_matching, matching, matching_all, words, words_found
from termwell.functions.text import tokens
from termwell.vocab import query_rules as rules
from termwell.vocab.listing import MONTHS

def sort_hint(query: Column) -> Column:
    return first_matching(query, rules.SORT_RULES, "relevance")


def free_hint(query: Column) -> Column:
    return words_found(query, rules.FREE_PATTERN)


def year_hint(query: Column) -> Column:
    return F.nullif(F.regexp_extract(query, FLAGS_IGNORE_CASE + rules.YEAR_PATTERN, 1), F.lit("")).cast("int")


def month_hint(query: Column) -> Column:
    """Full name of the first month named in the query."""
    names = {}
    for month in MONTHS:
        names[month.lower()] = month
        names[month[:3].lower()] = month
    mention = F.lower(F.regexp_extract(query, FLAGS_IGNORE_CASE + rules.MONTH_PATTERN, 1))
    return F.try_element_at(text_map(names), mention)


def country_hints(query: Column) -> Column:
    """Countries named anywhere in the query, sorted."""
    table = F.expr("array(" + ", ".join(
        f"named_struct('part', {sql_text(country)}, 'shown', {sql_text(country.title())})"
        for country in sorted(rules.COUNTRIES)
    ) + ")")
    named = F.transform(
        F.array(F.lower(query)), lambda low: F.filter(table, lambda country: F.contains(low, country["part"]))
    )
    return named[0]["shown"]


def category_hint(query: Column) -> Column:
    return first_matching(query, rules.CATEGORY_RULES)


def acronyms_found(query: Column) -> Column:
    known = F.filter(words(query), lambda word: F.array_contains(text_array(rules.ACRONYMS), word))
    return F.transform(known, F.upper)


def phrase_matches(query: Column) -> Column:
    """The patterns of the matching phrase rules, shown up to 40 characters."""
    return matching(query, [(pattern, pattern[:40]) for pattern, _ in rules.PHRASE_RULES])


def intent(query: Column) -> Column:
    """All signals of a query as one struct."""
    return F.struct(
        sort_hint(query).alias("sort_hint"),
        free_hint(query).alias("free_hint"),
        year_hint(query).alias("year_hint"),
        month_hint(query).alias("month_hint"),
        country_hints(query).alias("country_hints"),
        category_hint(query).alias("category_hint"),
        acronyms_found(query).alias("acronyms_found"),
        phrase_matches(query).alias("phrase_matches"),
    )


def strip_noise(query: Column) -> Column:
    kept = F.trim(F.regexp_replace(query, FLAGS_IGNORE_CASE + rules.NOISE_PATTERN, ""))
    return F.regexp_replace(kept, r"(?U)\s+", " ")


def phrase_expansions(query: Column) -> Column:
    return matching(query, rules.PHRASE_RULES)


def synonym_expansions(query: Column) -> Column:
    """Expansions of the synonym words in the query, in table order."""
    present = F.array_intersect(text_array(rules.SYNONYMS), words(query))
    return F.transform(present, lambda word: F.element_at(text_map(rules.SYNONYMS), word))


def acronym_expansions(query: Column) -> Column:
    """Long forms of the acronyms in the query, in order of appearance."""
    return F.transform(
        acronyms_found(query), lambda name: F.element_at(text_map(rules.ACRONYMS), F.lower(name))
    )


def combo_expansions(query: Column) -> Column:
    return matching_all(query, rules.PLACE_SUBJECT_RULES)


def category_expansions(query: Column) -> Column:
    return F.array_compact(F.array(category_hint(query)))


def expand_query(query: Column) -> Column:
    """The query without noise words, followed by every expansion that adds a word.

    Expansions are tried in layer order. One is appended whole when at least one
    of its words has not been seen yet; its words then count as seen.
    """
    base = strip_noise(query)
    candidates = F.concat(
        phrase_expansions(query), synonym_expansions(query), acronym_expansions(query),
        combo_expansions(query), category_expansions(query),
    )
    start = F.struct(
        F.array_distinct(tokens(base)).alias("seen"),
        no_texts().alias("added"),
    )

    def visit(state: Column, text: Column) -> Column:
        unseen = F.array_except(F.split(F.lower(text), " "), state["seen"])
        return F.when(F.size(unseen) > 0, F.struct(
            F.concat(state["seen"], unseen).alias("seen"),
            F.concat(state["added"], F.array(text)).alias("added"),
        )).otherwise(state)

    added = F.aggregate(candidates, start, visit)["added"]
    joined = F.concat_ws(" ", base, F.array_join(added, " "))
    return F.trim(F.regexp_replace(joined, r"(?U)\s+", " "))


def expansion_ratio(query: Column, expanded: Column) -> Column:
    return F.length(expanded) / F.greatest(F.length(query), F.lit(1))


def detect_domains(text: Column) -> Column:
    found_domains = matching(text, rules.DOMAIN_RULES)
    return F.when(F.size(found_domains) > 0, found_domains).otherwise(F.array(F.lit(rules.UNKNOWN_DOMAIN)))


def effective(explicit: Column, inferred: Column) -> Column:
    """An explicit text setting wins over the inferred one unless it is blank."""
    return F.coalesce(F.nullif(explicit, F.lit("")), inferred)


def effective_params(row: dict[str, Column], signals: Column) -> dict[str, Column]:
    """Settings a search runs with: explicit ones, else those read from the query."""
    asked_year = F.nullif(row["year"], F.lit(0))
    return {
        "sort_by": F.when(row["sort_by"] != "relevance", row["sort_by"]).otherwise(signals["sort_hint"]),
        "free_only": row["free_only"] | signals["free_hint"],
        "year": F.coalesce(asked_year, signals["year_hint"]),
        "month": effective(row["month"], signals["month_hint"]),
        "countries": F.when(F.size(row["countries"]) > 0, row["countries"]).otherwise(signals["country_hints"]),
        "category": effective(row["category"], signals["category_hint"]),
    }


def filters_applied(row: dict[str, Column]) -> Column:
    """Map of the filters in force, as texts."""
    shown = {
        "region": row["region"],
        "category": row["category"],
        "difficulty": row["difficulty"],
        "year": row["year"].cast("string"),
        "month": row["month"],
        "countries": F.array_join(row["countries"], ", "),
        "free_only": F.when(row["free_only"], F.lit("true")),
    }
    pairs = F.create_map(*[part for key, value in shown.items() for part in (F.lit(key), value)])
    return F.map_filter(pairs, lambda _, value: F.coalesce(value, F.lit("")) != "")


def active_signals(signals: Column) -> Column:
    """Map of the signals that are set, as texts."""
    shown = {
        "sort_hint": F.nullif(signals["sort_hint"], F.lit("relevance")),
        "free_hint": F.when(signals["free_hint"], F.lit("true")),
        "year_hint": signals["year_hint"].cast("string"),
        "month_hint": signals["month_hint"],
        "country_hints": F.array_join(signals["country_hints"], ", "),
        "category_hint": signals["category_hint"],
        "acronyms_found": F.array_join(signals["acronyms_found"], ", "),
        "phrase_matches": F.array_join(signals["phrase_matches"], ", "),
    }
    pairs = F.create_map(*[part for key, value in shown.items() for part in (F.lit(key), value)])
    return F.map_filter(pairs, lambda _, value: F.coalesce(value, F.lit("")) != "")
