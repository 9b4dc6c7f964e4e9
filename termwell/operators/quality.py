"""Bulk data-quality jobs: verdicts, violation tables and good/rejected splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termwell.functions import guards as G
from termwell.functions.text import sanitised
from termwell.vocab import guard_rules as rules
from termwell.vocab.listing import DIFFICULTIES, REGIONS

REASONS = {
    "EMPTY_QUERY": "Query cannot be empty or contain only whitespace.",
    "QUERY_TOO_SHORT": "Query must contain at least 2 characters.",
    "QUERY_TOO_LONG": "Query must be 500 characters or fewer.",
    "CONTROL_CHARS": "Query contains non-printable or control characters.",
    "EXCESSIVE_REPEAT": "Query contains excessive repetition.",
    "PROMPT_INJECTION": "Query contains patterns that attempt to override AI instructions.",
    "SCRIPT_INJECTION": "Query contains code or script injection patterns.",
    "OFF_TOPIC": "Query does not appear to be related to examinations or education.",
    "GIBBERISH": "Query does not appear to contain readable text.",
    "INVALID_REGION": "Region is not valid.",
    "INVALID_DIFFICULTY": "Difficulty is not valid.",
    "INVALID_CATEGORY": "Category filter must be 80 characters or fewer.",
    "PII_DETECTED": "Query may contain personal information (email or phone).",
}


def input_rules(raw: Column, clean: Column, region: Column, category: Column,
                difficulty: Column) -> dict[str, Column]:
    """Condition of every blocking rule, by code."""
    return {
        "EMPTY_QUERY": G.empty(clean),
        "QUERY_TOO_SHORT": G.too_short(clean),
        "QUERY_TOO_LONG": G.too_long(clean),
        "CONTROL_CHARS": G.control_chars(raw),
        "EXCESSIVE_REPEAT": G.excessive_repeat(clean),
        "PROMPT_INJECTION": G.prompt_injection(clean),
        "SCRIPT_INJECTION": G.script_injection(clean),
        "OFF_TOPIC": G.off_topic(clean),
        "GIBBERISH": G.gibberish(clean),
        "INVALID_REGION": G.invalid_region(region),
        "INVALID_DIFFICULTY": G.invalid_difficulty(difficulty),
        "INVALID_CATEGORY": G.invalid_category(category),
    }


def check_input(requests: DataFrame) -> DataFrame:
    """Add a verdict to ``(query, region, category, difficulty)`` rows.

    The first broken rule blocks and later rules are not evaluated. Personal
    data only warns. ``sanitised_query`` is set where cleaning changed the text.
    """
    raw, clean = F.coalesce("query", F.lit("")), F.col("_clean")
    rows = requests.withColumn("_clean", sanitised(raw))
    conditions = input_rules(raw, clean, F.col("region"), F.col("category"), F.col("difficulty"))
    block = F
    for code, _ in rules.INPUT_BLOCKS:
        block = block.when(conditions[code], F.lit(code))
    severity = F.create_map(*[F.lit(x) for pair in rules.INPUT_BLOCKS for x in pair], F.lit("PII_DETECTED"), F.lit("low"))
    reason = F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair])
    blocked = F.col("_block").isNotNull()
    code = F.coalesce("_block", F.when(F.col("_pii"), F.lit("PII_DETECTED")))
    return (
        rows.withColumn("_block", block.otherwise(F.lit(None)))
        .withColumn("_pii", F.col("_block").isNull() & G.personal_data(clean))
        .select(
            *requests.columns,
            F.when(blocked, F.lit("block")).when(F.col("_pii"), F.lit("warn")).otherwise(F.lit("pass")).alias("action"),
            code.alias("code"),
            F.try_element_at(severity, code).alias("severity"),
            F.try_element_at(reason, code).alias("reason"),
            F.when(~blocked & (clean != raw), clean).alias("sanitised_query"),
        )
    )


def listing_violations() -> Column:
    """Violations of one listing row: the first blocking one, else all warnings."""
    name, cost = F.col("name"), F.col("cost")

    def entry(code: str, reason: Column, action: str) -> Column:
        return F.struct(F.lit(code).alias("code"), reason.alias("reason"), F.lit(action).alias("action"))

    def block(code: str, reason: Column) -> Column:
        return F.array(entry(code, reason, "block"))

    shown = F.concat(F.lit("Name '"), F.substring(name, 1, 60), F.lit("' contains suspicious patterns."))
    length = F.concat(F.lit("Name length "), F.length(name).cast("string"), F.lit(" is implausible."))
    missing = G.missing_required(name, F.col("org"), F.col("category"))
    warnings = F.array_compact(F.array(
        F.when(G.long_cost(cost), entry("IMPLAUSIBLE_COST", F.lit("Cost field is unusually long."), "warn")),
        F.when(
            G.malformed_url(F.col("website")),
            entry("MALFORMED_URL", F.concat(
                F.lit("Website '"), F.substring("website", 1, 80), F.lit("' is not a valid URL.")), "warn"),
        ),
        F.when(
            G.thin_description(F.col("description")),
            entry("THIN_DESCRIPTION", F.lit("Description is too short to be useful."), "warn"),
        ),
    ))
    return (
        F.when(missing.isNotNull(), block(
            "MISSING_REQUIRED_FIELDS", F.concat(F.lit("Exam missing required field '"), missing, F.lit("'."))))
        .when(G.bad_name_pattern(name), block("SUSPICIOUS_NAME", shown))
        .when(G.bad_name_length(name), block("SUSPICIOUS_NAME", length))
        .when(~F.col("region").isin(REGIONS), block(
            "INVALID_REGION", F.concat(F.lit("Region '"), F.col("region"), F.lit("' not in canonical set."))))
        .when(~F.col("difficulty").isin(DIFFICULTIES), block(
            "INVALID_DIFFICULTY", F.concat(F.lit("Difficulty '"), F.col("difficulty"), F.lit("' not in canonical set."))))
        .when(G.bad_cost(cost), block("IMPLAUSIBLE_COST", F.concat(
            F.lit("Cost field contains suspicious characters: '"), F.substring(cost, 1, 40), F.lit("'."))))
        .otherwise(warnings)
    )


def mark_duplicates(rows: DataFrame, within: list[str] | None = None) -> DataFrame:
    """Add ``duplicate``: true for every row but the first of its name and organiser.

    The first rows are found by aggregation and joined back on the unique
    ``ord``, so a name of any share is spread evenly.
    """
    within = within or []
    key = F.concat(F.trim(F.lower("name")), F.lit("|"), F.trim(F.lower("org")))
    first = rows.groupBy(*within, key.alias("_fp")).agg(F.min("ord").alias("ord")).select(
        *within, "ord", F.lit(True).alias("_first")
    )
    return rows.join(first, [*within, "ord"], "left").select(
        *rows.columns, F.col("_first").isNull().alias("duplicate")
    )


def check_output(rows: DataFrame) -> DataFrame:
    """Add violations and an action to listing rows; duplicates are decided first."""
    repeated = F.array(F.struct(
        F.lit("DUPLICATE_IN_RESULTS").alias("code"),
        F.concat(F.lit("'"), F.col("name"), F.lit("' appears more than once.")).alias("reason"),
        F.lit("block").alias("action"),
    ))
    checked = mark_duplicates(rows).withColumn(
        "violations", F.when(F.col("duplicate"), repeated).otherwise(listing_violations())
    )
    blocked = F.exists("violations", lambda violation: violation["action"] == "block")
    action = F.when(F.size("violations") == 0, "pass").when(blocked, "block").otherwise("warn")
    return checked.withColumn("guard_action", action)


def output_violations(checked: DataFrame) -> DataFrame:
    """One row per violation of a checked listing."""
    return checked.select("ord", "name", F.inline("violations"))


def output_summary(checked: DataFrame) -> DataFrame:
    return checked.agg(
        F.count(F.lit(1)).alias("total_input"),
        F.count_if(F.col("guard_action") == "pass").alias("total_passed"),
        F.count_if(F.col("guard_action") == "block").alias("total_blocked"),
        F.count_if(F.col("guard_action") == "warn").alias("total_warned"),
        F.sum(F.size("violations")).alias("total_violations"),
    )


def check_requests(requests: DataFrame) -> DataFrame:
    """Add the first field that breaks the request schema; null for good requests."""
    row = {column: F.col(column) for column in requests.columns}
    return requests.withColumn("invalid_field", G.invalid_request_field(row))


def split_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good requests with trimmed query, and rejected ones with the broken field."""
    checked = check_requests(requests)
    good = checked.filter(F.col("invalid_field").isNull()).drop("invalid_field")
    return good.withColumn("query", F.trim("query")), checked.filter(F.col("invalid_field").isNotNull())
