"""Query understanding on the published example queries."""

import pytest
from pyspark.sql import functions as F

from termwell.functions import intent as I
from termwell.vocab import query_rules as rules

SORTS = {
    "upcoming medical exams": "deadline",
    "next engineering exam in India": "deadline",
    "cheapest language tests": "cost_asc",
    "affordable MBA exams globally": "cost_asc",
    "free engineering exams Asia": "cost_asc",
    "free upcoming exams": "cost_asc",
    "hardest exams in the world": "difficulty",
    "toughest entrance test India": "difficulty",
    "GRE exam prep": "relevance",
    "": "relevance",
}
FREE = {
    "free upcoming exams": True,
    "no fee government exams India": True,
    "zero cost certification tests": True,
    "law exams without fee USA": True,
    "medical entrance exams": False,
}
YEARS = {"medical entrance exams India 2025": 2025, "upcoming exams 2026 Asia": 2026, "history of exams in 2010": None}
CATEGORIES = {
    "MBBS entrance exam": "Medical Admissions",
    "MBA admissions tests globally": "Business School",
    "engineering entrance exams": "Engineering Admissions",
    "law school admission test USA": "Law School",
    "English proficiency IELTS": "Language Proficiency",
    "GRE graduate programs": "Graduate Admissions",
    "CFA exam finance": "Finance Certification",
    "UPSC civil services exam": "Government",
    "competitive examination": None,
}
ACRONYMS = {"GRE and GMAT for MBA": ["GRE", "GMAT"], "GRE": ["GRE"], "HELLO WORLD exam": []}
COUNTRIES = {"exams in india and uk": ["India", "Uk"], "graduate admissions test": [], "ukraine": ["Uk"]}


def evaluate(spark, texts, column):
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    return {row["text"]: row["v"] for row in frame.select("text", column(F.col("text")).alias("v")).collect()}


@pytest.mark.parametrize("column,expected", [
    (I.sort_hint, SORTS), (I.free_hint, FREE), (I.year_hint, YEARS), (I.category_hint, CATEGORIES),
    (I.acronyms_found, ACRONYMS), (I.country_hints, COUNTRIES),
])
def test_signals(spark, column, expected):
    assert evaluate(spark, list(expected), column) == expected


def test_months(spark):
    found = evaluate(spark, ["exams in sep or Oct", "May tests", "market share"], I.month_hint)
    assert found == {"exams in sep or Oct": "September", "May tests": "May", "market share": None}


def test_expansion(spark):
    texts = ["best GRE exam preparation guide", "GRE preparation", "IELTS band score", "NEET exam India", "exam", "become a doctor India"]
    out = evaluate(spark, texts, I.expand_query)
    assert "best" not in out["best GRE exam preparation guide"].lower().split()
    assert "graduate" in out["GRE preparation"].lower()
    assert "language" in out["IELTS band score"].lower()
    assert "medical" in out["NEET exam India"].lower()
    assert out["exam"] == "exam"
    assert all(word in out["become a doctor India"] for word in ("NEET", "AIIMS", "MBBS", "medical admissions"))
    # The category adds no new word here, so it is not appended.
    assert "Medical Admissions" not in out["become a doctor India"]


def expanded_by_hand(query):
    """The expansion written out step by step, for comparison."""
    import re

    base = re.sub(r"\s+", " ", re.sub(rules.NOISE_PATTERN, "", query, flags=re.I).strip())
    words = re.findall(r"\b[a-z]+\b", query.lower())
    candidates = [text for pattern, text in rules.PHRASE_RULES if re.search(pattern, query, re.I)]
    candidates += [text for word, text in rules.SYNONYMS.items() if word in words]
    candidates += [rules.ACRONYMS[word] for word in words if word in rules.ACRONYMS]
    candidates += [
        text for place, subject, text in rules.PLACE_SUBJECT_RULES
        if re.search(place, query, re.I) and re.search(subject, query, re.I)
    ]
    candidates += [text for pattern, text in rules.CATEGORY_RULES if re.search(pattern, query, re.I)][:1]
    seen, parts = set(re.findall("[a-z0-9]+", base.lower())), [base]
    for text in candidates:
        fresh = {word.lower() for word in text.split()} - seen
        if fresh:
            parts.append(text)
            seen |= fresh
    return re.sub(r"\s+", " ", " ".join(parts)).strip()


def test_expansion_step_by_step(spark):
    texts = [f"{a} {b}" for a in list(SORTS) + list(CATEGORIES) for b in ("", "India", "university abroad cybersecurity", "best of usa")]
    out = evaluate(spark, texts, I.expand_query)
    assert out == {text: expanded_by_hand(text) for text in texts}


def test_domains(spark):
    out = evaluate(spark, ["compare NEET and JEE", "GRE exam", "nothing here"], I.detect_domains)
    assert out == {"compare NEET and JEE": ["Medical", "Engineering"], "GRE exam": ["Graduate"], "nothing here": ["Unknown"]}


def test_rule_counts():
    assert [len(t) for t in (rules.PHRASE_RULES, rules.SYNONYMS, rules.ACRONYMS, rules.PLACE_SUBJECT_RULES)] == [58, 67, 69, 16]
