"""Regular-expression rules as column expressions.

Patterns follow Unicode word boundaries and see only ``\\n`` as a line end, so
one pattern text means the same in every language of the corpus.

Most rules are lists of whole words. Those are looked up among the words of the
text, which are taken apart once per row for all rules. Only an alternative of
several words runs as a regular expression, and only on texts that contain its
longest literal part. A rule table is one constant array filtered by a lambda,
which keeps plans small whatever the number of rules.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from termwell.functions.literals import sql_array, sql_text

FLAGS = "(?dU)"
FLAGS_IGNORE_CASE = "(?idU)"


def found(text: Column, pattern: str, ignore_case: bool = True) -> Column:
    """True where the pattern occurs anywhere in the text."""
    return text.rlike((FLAGS_IGNORE_CASE if ignore_case else FLAGS) + pattern)


def any_found(text: Column, patterns: list[str]) -> Column:
    """True where at least one pattern occurs; later patterns are not tried."""
    hit = F.lit(False)
    for pattern in reversed(patterns):
        hit = F.when(found(text, pattern), F.lit(True)).otherwise(hit)
    return hit


def words(text: Column) -> Column:
    """Lower-case words of a text, repeats and order kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), F.lit(0))


def alternatives(pattern: str) -> list[str]:
    """The alternatives of a whole-word rule, without their word boundaries."""
    grouped = re.fullmatch(r"\\b\(([^()]*)\)\\b", pattern)
    parts = (grouped.group(1) if grouped else pattern).split("|")
    return [part.replace(r"\b", "") for part in parts]


def longest_literal(alternative: str) -> str:
    """Longest run of letters that every match must contain."""
    certain = re.sub(r"\\.|\(\?:[^()]*\)\?|.\?", " ", alternative)
    return max(re.findall("[a-z]+", certain), key=len)


def _sql_rule(pattern: str) -> str:
    """A whole-word rule ``\\b(a|b c)\\b`` or ``\\ba\\b|\\bb c\\b`` as a constant."""
    single, several = [], []
    for alternative in alternatives(pattern):
        (single if re.fullmatch("[a-z]+", alternative) else several).append(alternative)
    phrases = ", ".join(
        f"named_struct('part', {sql_text(longest_literal(a))}, "
        f"'regex', {sql_text(FLAGS_IGNORE_CASE + rf'\b(?:{a})\b')})"
        for a in several
    )
    listed = f"array({phrases})" if phrases else "CAST(array() AS ARRAY<STRUCT<part: STRING, regex: STRING>>)"
    return f"named_struct('words', {sql_array(single)}, 'phrases', {listed})"


def _applies(context: Column, rule: Column) -> Column:
    several = F.exists(
        rule["phrases"],
        lambda phrase: F.contains(context["low"], phrase["part"]) & F.rlike(context["text"], phrase["regex"]),
    )
    return F.arrays_overlap(context["words"], rule["words"]) | several


def _in_context(text: Column, patterns: list[str], result: Callable[[Column], Column]) -> Column:
    """Evaluate with the text, its lower-case form and its words computed once.

    Only the words that stand in a rule are kept, mostly none.
    """
    known = sorted({a for pattern in patterns for a in alternatives(pattern) if re.fullmatch("[a-z]+", a)})
    kept = F.array_intersect(words(text), F.expr(sql_array(known)))
    context = F.struct(text.alias("text"), F.lower(text).alias("low"), kept.alias("words"))
    return F.transform(F.array(context), result)[0]


def words_found(text: Column, pattern: str) -> Column:
    """True where one alternative of a whole-word rule occurs, letter case aside."""
    rule = F.expr(f"array({_sql_rule(pattern)})")
    return _in_context(text, [pattern], lambda context: F.exists(rule, lambda r: _applies(context, r)))


def matching(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Array with the values of all rules whose pattern occurs, in rule order."""
    return matching_all(text, [(pattern, None, value) for pattern, value in rules])


def matching_all(text: Column, rules: list[tuple[str, str | None, str]]) -> Column:
    """Values of the rules of which both patterns occur; the second may be missing."""
    table = F.expr("array(" + ", ".join(
        f"named_struct('first', {_sql_rule(first)}, 'second', {_sql_rule(second or first)}, 'value', {sql_text(value)})"
        for first, second, value in rules
    ) + ")")
    paired = any(second for _, second, _ in rules)

    def applies(context: Column, rule: Column) -> Column:
        hit = _applies(context, rule["first"])
        return hit & _applies(context, rule["second"]) if paired else hit

    patterns = [pattern for first, second, _ in rules for pattern in (first, second) if pattern]
    kept = _in_context(text, patterns, lambda context: F.filter(table, lambda rule: applies(context, rule)))
    return kept["value"]


def first_matching(text: Column, rules: list[tuple[str, str]], default: str | None = None) -> Column:
    """Value of the first rule whose pattern occurs."""
    first = F.try_element_at(matching(text, rules), F.lit(1))
    return first if default is None else F.coalesce(first, F.lit(default))
