"""Merging records of the same exam that disagree field by field.

Everything is aggregated per identity; no list of members or values is ever
gathered, so an identity may have any number of records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termwell.functions.text import identity_key

FIELDS = ["cost", "deadline", "date", "website", "description", "difficulty"]
UNKNOWN_COSTS = ["unknown", "n/a", "tbd", ""]
FLAG_BELOW = 0.5


def with_key(rows: DataFrame) -> DataFrame:
    return rows.withColumn("key", identity_key(F.col("name"), F.col("org")))


def identity_groups(rows: DataFrame) -> DataFrame:
    """Number of records per identity."""
    return with_key(rows).groupBy("key").agg(F.count(F.lit(1)).alias("records"))


def _preference() -> Column:
    """Records rank by score; the earlier one goes first on ties."""
    return F.struct(F.col("score").alias("score"), (-F.col("ord")).alias("order"))


def _given(field: str) -> Column:
    return F.nullif(F.col(field), F.lit(""))


def _first_where(field: str, condition: Column) -> Column:
    """Value of the preferred record among those that meet the condition."""
    return F.max_by(F.when(condition, F.col(field)), F.when(condition, _preference()))


def base_record(rows: DataFrame) -> DataFrame:
    """The record with the highest score per identity."""
    columns = rows.columns
    return with_key(rows).groupBy("key").agg(
        F.max_by(F.struct(*columns), _preference()).alias("base"), F.max("score").alias("best_score")
    ).select("key", *[F.col(f"base.{c}").alias(c) for c in columns], "best_score")


def _any_given(field: str) -> Column:
    return _first_where(field, _given(field).isNotNull())


def _description() -> Column:
    given = _given("description").isNotNull()
    length = F.when(given, F.struct(F.length("description"), _preference()))
    return F.max_by(F.when(given, F.col("description")), length)


def _votes(rows: DataFrame) -> DataFrame:
    """Most frequent difficulty per identity and its share of the votes."""
    counted = rows.filter(_given("difficulty").isNotNull()).groupBy("key", "difficulty").agg(
        F.count(F.lit(1)).alias("votes"), F.max(_preference()).alias("preference")
    )
    return counted.groupBy("key").agg(
        F.max_by("difficulty", F.struct("votes", "preference")).alias("difficulty_pick"),
        (F.max("votes") / F.sum("votes")).alias("difficulty_share"),
    )


def field_picks(rows: DataFrame) -> DataFrame:
    """Per identity: whether each field conflicts, and the candidate values."""
    keyed = with_key(rows)
    known_cost = _given("cost").isNotNull() & ~F.lower("cost").isin(UNKNOWN_COSTS)
    url = F.startswith(F.col("website"), F.lit("http"))
    fixed = _given("deadline").isNotNull() & ~F.contains(F.lower("deadline"), F.lit("rolling"))
    picks = keyed.groupBy("key").agg(
        F.count(F.lit(1)).alias("records"),
        F.max_by("name", _preference()).alias("name"),
        *[(F.min(_given(f)) != F.max(_given(f))).alias(f"{f}_conflict") for f in FIELDS],
        _description().alias("longest_description"),
        _first_where("cost", known_cost).alias("known_cost"),
        _any_given("cost").alias("any_cost"),
        _first_where("website", url).alias("url_website"),
        _any_given("website").alias("any_website"),
        _first_where("deadline", fixed).alias("fixed_deadline"),
        _any_given("deadline").alias("any_deadline"),
        F.max_by(_given("date"), _preference()).alias("base_date"),
        _any_given("date").alias("any_date"),
    )
    return picks.join(_votes(keyed), "key", "left")


def _choice(preferred: str, strategy: str, confidence: float,
            other: str, other_strategy: str, other_confidence: float) -> tuple[Column, Column, Column]:
    has = F.col(preferred).isNotNull()
    return (
        F.coalesce(preferred, other),
        F.when(has, F.lit(strategy)).otherwise(F.lit(other_strategy)),
        F.when(has, F.lit(confidence)).otherwise(F.lit(other_confidence)),
    )


def choices() -> dict[str, tuple[Column, Column, Column]]:
    """Chosen value, strategy and confidence per field over ``field_picks`` columns."""
    return {
        "cost": _choice("known_cost", "prefer_known_cost", 0.75, "any_cost", "best_available", 0.40),
        "deadline": _choice("fixed_deadline", "prefer_specific_deadline", 0.70,
                            "any_deadline", "rolling_fallback", 0.60),
        "date": _choice("base_date", "highest_score_wins", 0.65, "any_date", "first_available", 0.50),
        "website": _choice("url_website", "prefer_valid_url", 0.90, "any_website", "best_available", 0.40),
        "description": (F.col("longest_description"), F.lit("longest_description"), F.lit(0.85)),
        "difficulty": (F.col("difficulty_pick"), F.lit("majority_vote"), F.round("difficulty_share", 3)),
    }


def conflicts(rows: DataFrame) -> DataFrame:
    """One row per identity and conflicting field: chosen value, strategy, confidence.

    A choice below confidence 0.5 is flagged for review.
    """
    entries = F.array(*[
        F.struct(
            F.lit(field).alias("field"), F.col(f"{field}_conflict").alias("conflict"),
            value.alias("resolved"), strategy.alias("strategy"), confidence.alias("confidence"),
        )
        for field, (value, strategy, confidence) in choices().items()
    ])
    listed = field_picks(rows).select("key", "name", F.inline(entries)).filter("conflict")
    return listed.select(
        "key", "name", "field", "resolved", "strategy", "confidence",
        (F.col("confidence") < FLAG_BELOW).alias("flagged"),
    )


def conflict_values(rows: DataFrame) -> DataFrame:
    """All values seen for each conflicting field, one row each, with their counts."""
    seen = F.inline(F.array(*[
        F.struct(F.lit(field).alias("field"), F.col(field).alias("value")) for field in FIELDS
    ]))
    counted = (
        with_key(rows).select("key", seen).filter(F.col("value") != "")
        .groupBy("key", "field", "value").agg(F.count(F.lit(1)).alias("records"))
    )
    disputed = conflicts(rows).select("key", "field")
    return counted.join(disputed, ["key", "field"], "left_semi")


def merged_reasons(rows: DataFrame) -> DataFrame:
    """The distinct match reasons per identity, one row each."""
    return with_key(rows).select("key", F.explode("match_reasons").alias("reason")).distinct()


def conflict_report(rows: DataFrame) -> DataFrame:
    """One row: input rows, conflicts found, resolved and flagged."""
    found = conflicts(rows).agg(
        F.count(F.lit(1)).alias("conflicts_found"),
        F.count_if(~F.col("flagged")).alias("conflicts_resolved"),
        F.count_if("flagged").alias("flagged_for_review"),
    )
    total = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    return found.select(total.alias("total_rows"), "*")


def resolve_conflicts(rows: DataFrame) -> DataFrame:
    """One authoritative record per identity, best score first.

    Disputed fields of the base record take the chosen value. Identities with a
    single record pass unchanged.
    """
    base = base_record(rows)
    picks = field_picks(rows).select(
        "key", "records",
        *[F.col(f"{f}_conflict") for f in FIELDS],
        *[value.alias(f"{f}_value") for f, (value, _, _) in choices().items()],
    )
    reason_counts = merged_reasons(rows).groupBy("key").agg(F.count(F.lit(1)).alias("n_reasons"))
    merged = base.join(picks, "key").join(reason_counts, "key", "left")
    fields = {
        f: F.when(F.coalesce(f"{f}_conflict", F.lit(False)), F.col(f"{f}_value")).otherwise(F.col(f)) for f in FIELDS
    }
    return (
        merged.withColumns(fields).withColumn("score", F.col("best_score"))
        .withColumn("n_reasons", F.coalesce("n_reasons", F.lit(0)))
        .select("key", *[c for c in rows.columns if c != "match_reasons"], "records", "n_reasons")
        .orderBy(F.desc("score"), "key")
    )
