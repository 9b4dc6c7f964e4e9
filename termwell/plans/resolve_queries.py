"""Conflict resolution between catalog rows with the same name and organiser."""

from __future__ import annotations

from pyspark.sql import functions as F

from termwell.operators import resolve as X
from termwell.plans.registry import query
from termwell.plans.tables import frame
from termwell.plans.text_queries import LISTING, squeezed_sql

_KEY = f"{squeezed_sql('name')} || '|' || {squeezed_sql('org')}"
_KEYED = f"{LISTING}, keyed AS (SELECT *, {_KEY} AS key FROM listing)"
_PREF = "ORDER BY score DESC, ord"


def _first(column: str, condition: str) -> str:
    return f"first({column} {_PREF}) FILTER (WHERE {condition})"


def _picks() -> str:
    conflicts = ", ".join(
        f"count(DISTINCT nullif({f}, '')) > 1 AS {f}_conflict" for f in X.FIELDS
    )
    return f"""{_KEYED}, votes AS (SELECT key, difficulty, count(*) AS votes, max(score) AS best, arg_min(ord, struct_pack(s := -score, o := ord)) AS pos FROM keyed WHERE coalesce(difficulty, '') <> '' GROUP BY 1, 2),
voted AS (SELECT key, first(difficulty ORDER BY votes DESC, best DESC, pos) AS difficulty_pick, max(votes) / sum(votes)::DOUBLE AS difficulty_share FROM votes GROUP BY 1),
picks AS (SELECT key, count(*) AS records, first(name {_PREF}) AS name, max(score) AS best_score, {conflicts},
  first(description ORDER BY length(description) DESC, score DESC, ord) FILTER (WHERE coalesce(description, '') <> '') AS longest,
  {_first('cost', "coalesce(cost, '') <> '' AND lower(cost) NOT IN ('unknown', 'n/a', 'tbd', '')")} AS known_cost, {_first('cost', "coalesce(cost, '') <> ''")} AS any_cost,
  {_first('website', "starts_with(website, 'http')")} AS url, {_first('website', "coalesce(website, '') <> ''")} AS any_site,
  {_first('deadline', "coalesce(deadline, '') <> '' AND NOT contains(lower(deadline), 'rolling')")} AS fixed, {_first('deadline', "coalesce(deadline, '') <> ''")} AS any_due,
  nullif(first(date {_PREF}), '') AS base_date, {_first('date', "coalesce(date, '') <> ''")} AS any_date
  FROM keyed GROUP BY key),
chosen AS (SELECT *, coalesce(known_cost, any_cost) AS cost_v, CASE WHEN known_cost IS NOT NULL THEN 'prefer_known_cost' ELSE 'best_available' END AS cost_s, CASE WHEN known_cost IS NOT NULL THEN 0.75::DOUBLE ELSE 0.4 END AS cost_c,
  coalesce(fixed, any_due) AS deadline_v, CASE WHEN fixed IS NOT NULL THEN 'prefer_specific_deadline' ELSE 'rolling_fallback' END AS deadline_s, CASE WHEN fixed IS NOT NULL THEN 0.7::DOUBLE ELSE 0.6 END AS deadline_c,
  coalesce(base_date, any_date) AS date_v, CASE WHEN base_date IS NOT NULL THEN 'highest_score_wins' ELSE 'first_available' END AS date_s, CASE WHEN base_date IS NOT NULL THEN 0.65::DOUBLE ELSE 0.5 END AS date_c,
  coalesce(url, any_site) AS website_v, CASE WHEN url IS NOT NULL THEN 'prefer_valid_url' ELSE 'best_available' END AS website_s, CASE WHEN url IS NOT NULL THEN 0.9::DOUBLE ELSE 0.4 END AS website_c,
  longest AS description_v, 'longest_description' AS description_s, 0.85::DOUBLE AS description_c,
  difficulty_pick AS difficulty_v, 'majority_vote' AS difficulty_s, round(difficulty_share, 3) AS difficulty_c
  FROM picks LEFT JOIN voted USING (key)),
conflicts AS ({' UNION ALL '.join(f"SELECT key, name, '{f}' AS field, {f}_v AS resolved, {f}_s AS strategy, {f}_c AS confidence, {f}_c < 0.5 AS flagged FROM chosen WHERE {f}_conflict" for f in X.FIELDS)})"""


_PICKS = _picks()


def _rows(spark, sf):
    return frame(spark, sf, "listing").select(
        "ord", "name", "org", "cost", "deadline", "date", "website", "description", "difficulty", "score", "match_reasons"
    )


@query("identity_groups", f"{_KEYED} SELECT key, count(*) AS records FROM keyed GROUP BY key")
def identity_groups(spark, sf):
    return X.identity_groups(_rows(spark, sf))


@query("base_record", f"{_KEYED} SELECT key, ord, score AS best_score FROM keyed QUALIFY row_number() OVER (PARTITION BY key {_PREF}) = 1")
def base_record(spark, sf):
    return X.base_record(_rows(spark, sf)).select("key", "ord", "best_score")


@query("field_conflicts", f"{_PICKS} SELECT key, field, resolved, strategy, confidence, flagged FROM conflicts")
def field_conflicts(spark, sf):
    return X.conflicts(_rows(spark, sf)).drop("name")


@query("conflict_values", f"""{_PICKS}, seen AS ({' UNION ALL '.join(f"SELECT key, '{f}' AS field, {f} AS value FROM keyed" for f in X.FIELDS)})
SELECT key, field, value, count(*) AS records FROM seen JOIN conflicts c USING (key, field) WHERE coalesce(value, '') <> '' GROUP BY 1, 2, 3""")
def conflict_values(spark, sf):
    return X.conflict_values(_rows(spark, sf))


def _field(name: str, field: str) -> None:
    @query(name, f"{_PICKS} SELECT key, {field}_v AS value, {field}_s AS strategy, {field}_c AS confidence FROM chosen WHERE {field}_conflict")
    def run(spark, sf):
        return X.conflicts(_rows(spark, sf)).filter(F.col("field") == field).select(
            "key", F.col("resolved").alias("value"), "strategy", "confidence"
        )


for _name, _of in (
    ("pick_description", "description"), ("pick_cost", "cost"), ("pick_website", "website"),
    ("pick_deadline", "deadline"), ("pick_difficulty", "difficulty"), ("pick_default", "date"),
):
    _field(_name, _of)


@query("merge_reasons", f"{_KEYED} SELECT DISTINCT key, reason FROM (SELECT key, unnest(match_reasons) AS reason FROM keyed)")
def merge_reasons(spark, sf):
    return X.merged_reasons(_rows(spark, sf))


@query("conflict_report", f"""{_PICKS} SELECT (SELECT count(*) FROM listing) AS total_rows, count(*) AS conflicts_found,
  count(*) FILTER (WHERE NOT flagged) AS conflicts_resolved, count(*) FILTER (WHERE flagged) AS flagged_for_review FROM conflicts""")
def conflict_report(spark, sf):
    return X.conflict_report(_rows(spark, sf))


@query("resolve_conflicts", f"""{_PICKS}, reasons AS (SELECT key, count(DISTINCT reason) AS n_reasons FROM (SELECT key, unnest(match_reasons) AS reason FROM keyed) GROUP BY key),
base AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY key {_PREF}) = 1)
SELECT key, ord, b.name, org, {', '.join(f"CASE WHEN {f}_conflict THEN {f}_v ELSE b.{f} END AS {f}" for f in X.FIELDS)}, best_score AS score, records, n_reasons
FROM base b JOIN chosen USING (key) JOIN reasons USING (key)""")
def resolve_conflicts(spark, sf):
    return X.resolve_conflicts(_rows(spark, sf))
