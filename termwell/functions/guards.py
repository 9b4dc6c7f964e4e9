"""Data-quality rules of queries and listing rows as boolean columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from termwell.functions.literals import text_array
from termwell.functions.patterns import any_found, found
from termwell.functions.text import text_or_empty
from termwell.vocab import guard_rules as rules
from termwell.vocab.listing import CATEGORIES, DIFFICULTIES, MONTHS, REGIONS, SORT_MODES

MAX_TOKEN_REPEATS = 6
MAX_CHAR_SHARE = 0.7


def without_space(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", "")


def empty(clean: Column) -> Column:
    return clean == ""


def too_short(clean: Column) -> Column:
    return F.length(without_space(clean)) < rules.MIN_QUERY_CHARS


def too_long(clean: Column) -> Column:
    return F.length(clean) > rules.MAX_QUERY_CHARS


def control_chars(raw: Column) -> Column:
    return raw.rlike(r"[\p{C}&&[^\t\n\r]]")


def excessive_repeat(clean: Column) -> Column:
    """One word more than six times, or one character in over 70 % of the text.

    Sorting puts equal words side by side, so a word is too frequent exactly if
    it equals the word six places on. A character with a share above one half
    must stand in the middle of the sorted characters, so only that one is counted.
    """
    lowered = F.lower(clean)
    words = F.sort_array(F.filter(F.split(lowered, r"(?U)\s+"), lambda word: word != ""))
    shifted = F.slice(words, MAX_TOKEN_REPEATS + 1, F.greatest(F.size(words) - MAX_TOKEN_REPEATS, F.lit(0)))
    repeated_word = F.exists(F.zip_with(words, shifted, lambda word, later: word == later), lambda same: same)
    packed = without_space(lowered)
    length = F.length(packed)
    chars = F.sort_array(F.filter(F.split(packed, ""), lambda char: char != ""))
    middle = F.try_element_at(chars, F.floor(F.size(chars) / 2).cast("int") + 1)
    others = F.length(F.replace(packed, middle, F.lit("")))
    repeated_char = (length > 8) & ((length - others) / length > MAX_CHAR_SHARE)
    # Over 20 characters such a share puts one character three times in a row
    # somewhere, so other texts need no sorting.
    unlikely = (length > 20) & ~packed.rlike(r"(?s)(.)\1\1")
    too_much = F.when(unlikely, F.lit(False)).otherwise(repeated_char)
    return F.coalesce(repeated_word, F.lit(False)) | F.coalesce(too_much, F.lit(False))


def prompt_injection(clean: Column) -> Column:
    return any_found(clean, rules.INJECTION_PATTERNS)


def script_injection(clean: Column) -> Column:
    return any_found(clean, rules.SCRIPT_PATTERNS)


def off_topic(clean: Column) -> Column:
    words = F.regexp_extract_all(F.lower(clean), F.lit("[a-z]+"), F.lit(0))
    educational = F.arrays_overlap(words, text_array(rules.EDUCATION_WORDS))
    return (F.length(F.trim(clean)) > 15) & ~educational & any_found(clean, rules.OFF_TOPIC_PATTERNS)


def has_email(clean: Column) -> Column:
    return found(clean, rules.EMAIL_PATTERN, ignore_case=False)


def has_phone(clean: Column) -> Column:
    return found(clean, rules.PHONE_PATTERN, ignore_case=False)


def personal_data(clean: Column) -> Column:
    return has_email(clean) | has_phone(clean)


def gibberish(clean: Column) -> Column:
    letters = F.length(F.regexp_replace(clean, r"(?U)[^\p{L}\s]", ""))
    return (F.length(clean) >= 10) & (letters / F.length(clean) < 0.4)


def invalid_region(region: Column) -> Column:
    return (text_or_empty(region) != "") & ~F.lower(region).isin([r.lower() for r in REGIONS])


def invalid_difficulty(difficulty: Column) -> Column:
    return (text_or_empty(difficulty) != "") & ~F.lower(difficulty).isin([d.lower() for d in DIFFICULTIES])


def invalid_category(category: Column) -> Column:
    return F.coalesce(F.length(category) > rules.MAX_CATEGORY_CHARS, F.lit(False))


def blank(value: Column) -> Column:
    return F.trim(text_or_empty(value)) == ""


def missing_required(name: Column, org: Column, category: Column) -> Column:
    """Name of the first required field that is blank."""
    return F.when(blank(name), F.lit("name")).when(blank(org), F.lit("org")).when(blank(category), F.lit("category"))


def bad_name_pattern(name: Column) -> Column:
    hit = F.lit(False)
    for pattern, ignore_case in rules.BAD_NAME_PATTERNS:
        hit = hit | found(name, pattern, ignore_case)
    return hit


def bad_name_length(name: Column) -> Column:
    return ~F.length(F.trim(name)).between(2, 200)


def bad_cost(cost: Column) -> Column:
    return found(text_or_empty(cost), rules.BAD_COST_PATTERN, ignore_case=False)


def long_cost(cost: Column) -> Column:
    return F.length(text_or_empty(cost)) > 100


def malformed_url(website: Column) -> Column:
    return (text_or_empty(website) != "") & ~found(text_or_empty(website), rules.URL_PATTERN, ignore_case=False)


def thin_description(description: Column) -> Column:
    given = text_or_empty(description)
    return (given != "") & (F.length(F.trim(given)) < rules.MIN_DESCRIPTION_CHARS)


def invalid_request_field(row: dict[str, Column]) -> Column:
    """Name of the first field of a request that breaks its schema; null if none."""
    def outside(value: Column, allowed: list[str]) -> Column:
        return value.isNotNull() & ~value.isin(allowed)

    def outside_range(value: Column, low: int, high: int) -> Column:
        return value.isNotNull() & ~value.between(low, high)

    query = row["query"]
    countries = row["countries"]
    checks = [
        ("query", query.isNull() | (F.length(F.trim(query)) < 1)),
        ("query", F.length(query) > rules.MAX_QUERY_CHARS),
        ("query", found(query, r"<[^>]+>", ignore_case=False)),
        ("region", outside(row["region"], REGIONS)),
        ("category", outside(row["category"], CATEGORIES)),
        ("difficulty", outside(row["difficulty"], DIFFICULTIES)),
        ("sort_by", outside(row["sort_by"], SORT_MODES)),
        ("page", outside_range(row["page"], 1, 100)),
        ("page_size", outside_range(row["page_size"], 1, 50)),
        ("year", outside_range(row["year"], 2020, 2035)),
        ("month", outside(row["month"], MONTHS)),
        ("countries", F.size(countries) > 20),
        ("countries", F.exists(countries, lambda country: F.length(country) > 60)),
    ]
    return F.coalesce(*[F.when(broken, F.lit(field)) for field, broken in checks])
