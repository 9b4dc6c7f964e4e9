"""Checks of plans, result sets and summaries, one row per run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termwell.functions.intent import detect_domains
from termwell.functions.numbers import rounded
from termwell.functions.patterns import matching
from termwell.operators.scan import previous
from termwell.vocab.query_rules import DOMAIN_RULES
from termwell.vocab.runs import STAGES

DOMAIN_NAMES = [domain for _, domain in DOMAIN_RULES]


def plan_rules(queries: DataFrame) -> DataFrame:
    """Domains and thresholds for each ``(query_id, text)``."""
    cross = F.size("domains") > 1
    return queries.withColumn("domains", detect_domains(F.col("text"))).select(
        "query_id", "domains", cross.alias("is_cross_domain"),
        F.when(cross, 3).otherwise(2).alias("min_items"),
        F.when(cross, 0.6).otherwise(0.0).alias("min_coverage"),
        F.when(cross, 0.35).otherwise(0.45).alias("min_result_quality"),
    )


def stage_rows(plans: DataFrame) -> DataFrame:
    """The five stages of every plan with their recovery rules."""
    stages = F.array(*[
        F.struct(
            F.lit(number).alias("stage_no"), F.lit(stage).alias("stage"), F.lit(agent).alias("agent"),
            F.lit(strategy).alias("rollback_strategy"), F.lit(retries).alias("max_retries"),
        )
        for number, (stage, agent, strategy, retries) in enumerate(STAGES, start=1)
    ])
    return plans.select("*", F.inline(stages))


def validate_plan(runs: DataFrame, shards: DataFrame, min_items: int = 1) -> DataFrame:
    """``runs(run_id)`` checked on their ``shards(run_id, query)``."""
    counted = shards.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("query").alias("distinct_queries")
    )
    n = F.coalesce("n", F.lit(0))
    return runs.select("run_id").join(counted, "run_id", "left").select(
        "run_id", n.alias("shards"),
        (n >= max(min_items, 1)).alias("passed"),
        F.round(F.least(F.lit(1.0), n / max(min_items, 1)), 3).alias("quality_score"),
        (F.coalesce("distinct_queries", F.lit(0)) < n).alias("duplicate_queries"),
    )


def _domain_text() -> Column:
    return F.lower(F.concat_ws(" ", "name", "category", F.array_join("tags", " ")))


def with_row_domains(catalog: DataFrame) -> DataFrame:
    """Catalog rows with ``row_domains``, the domains their texts name."""
    return catalog.withColumn("row_domains", matching(_domain_text(), DOMAIN_RULES))


def domain_flags(rows: DataFrame, within: str = "run_id") -> DataFrame:
    """Row count, distinct names and the domains the rows of a run cover.

    The rules need not run on every row: rows that bring ``row_domains``, found
    once per catalog row, are taken at their word. The aggregate keeps a flag per
    domain, so nothing is multiplied out and the groups combine inside each partition.
    """
    known = rows if "row_domains" in rows.columns else with_row_domains(rows)
    named = known.select(within, F.trim(F.lower("name")).alias("_name"), F.col("row_domains").alias("_found"))
    return named.groupBy(within).agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("_name").alias("distinct_names"),
        *[F.bool_or(F.array_contains("_found", domain)).alias(f"_has_{domain}") for domain in DOMAIN_NAMES],
    ).select(
        within, "n", "distinct_names",
        F.array_compact(F.array(*[F.when(F.col(f"_has_{d}"), F.lit(d)) for d in DOMAIN_NAMES])).alias("found_domains"),
    )


def covered_domains(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """Expected domains of ``plans(run_id, domains)`` that the rows represent."""
    flags = domain_flags(rows).select("run_id", "found_domains")
    none = F.array().cast("array<string>")
    return plans.join(flags, "run_id", "left").select(
        "run_id", "domains",
        F.array_intersect("domains", F.coalesce("found_domains", none)).alias("covered"),
    )


def cross_domain(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """Missing expected domains and the covered share."""
    share = F.size("covered") / F.size("domains")
    return covered_domains(rows, plans).select(
        "run_id", F.array_except("domains", "covered").alias("missing"),
        F.round(share, 3).alias("quality_score"), (F.size("covered") == F.size("domains")).alias("passed"),
    )


def validate_search(rows: DataFrame, plans: DataFrame, max_duplicates: int = 5) -> DataFrame:
    """Rows found per run against its plan's thresholds."""
    flags = domain_flags(rows)
    none = F.array().cast("array<string>")
    n = F.coalesce("n", F.lit(0))
    covered = F.size(F.array_intersect("domains", F.coalesce("found_domains", none))) / F.size("domains")
    duplicates = n - F.coalesce("distinct_names", F.lit(0))
    thin = F.col("is_cross_domain") & (F.col("min_coverage") > 0) & (covered < F.col("min_coverage"))
    return plans.join(flags, "run_id", "left").select(
        "run_id", n.alias("rows"), duplicates.alias("duplicates"),
        F.round(covered, 3).alias("coverage"),
        ((n > 0) & (n >= F.col("min_items")) & ~thin).alias("passed"),
        (duplicates > max_duplicates).alias("many_duplicates"),
        F.round(F.least(F.lit(1.0), n / F.greatest(F.col("min_items") * 3, F.lit(1))), 3).alias("quality_score"),
    )


def validate_ranking(ranked: DataFrame, max_duplicates: int = 3) -> DataFrame:
    """Duplicates and score order of ``ranked(run_id, position, name, score)``.

    Neighbours are compared in slices, which spread a ranking of any length evenly; the ranking is computed once.
    """
    compared = previous(ranked.select("run_id", "position", "name", "score"), ["run_id"], ["position"], ["score"])
    n = F.count(F.lit(1))
    duplicates = n - F.countDistinct(F.lower("name"))
    return compared.groupBy("run_id").agg(
        n.alias("rows"), duplicates.alias("duplicates"),
        (duplicates <= max_duplicates).alias("passed"),
        F.coalesce(F.bool_or(F.col("score") > F.col("prev_score")), F.lit(False)).alias("out_of_order"),
        F.round(1.0 - duplicates / n * 0.5, 3).alias("quality_score"),
    )


def validate_enrichment(enriched: DataFrame) -> DataFrame:
    """Share of enrichments without error in ``(run_id, source)``."""
    errors, n = F.count_if(F.col("source") == "error"), F.count(F.lit(1))
    return enriched.groupBy("run_id").agg(
        n.alias("rows"), errors.alias("errors"), F.round(1.0 - errors / n, 3).alias("quality_score"),
        (errors > 0).alias("warned"),
    )


def validate_summary(summary: Column, required: Column) -> Column:
    """Checks of a summary text as a struct."""
    text = F.coalesce(summary, F.lit(""))
    length = F.length(text)
    return F.struct(
        (~required | (F.trim(text) != "")).alias("passed"),
        F.round(F.least(F.lit(1.0), length / 300), 3).alias("quality_score"),
        ((length > 0) & (length < 50)).alias("very_short"),
        ((length > 0) & ~text.rlike(r"\*\*[^*]+\*\*")).alias("nothing_bold"),
    )


def final_quality(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """Average score and domain coverage against the plan, per run.

    ``rows(run_id, name, category, tags, score)``;
    ``plans(run_id, domains, is_cross_domain, min_result_quality, summary)``.
    """
    scores = rows.groupBy("run_id").agg(F.avg("score").alias("_avg"))
    flags = domain_flags(rows).select("run_id", "n", "found_domains")
    none = F.array().cast("array<string>")
    n = F.coalesce("n", F.lit(0))
    average = F.coalesce("_avg", F.lit(0.0))
    covered = F.size(F.array_intersect("domains", F.coalesce("found_domains", none))) / F.size("domains")
    return plans.join(scores, "run_id", "left").join(flags, "run_id", "left").select(
        "run_id", n.alias("rows"), rounded(average, 6).alias("avg_score"),
        ((n > 0) & (average >= F.col("min_result_quality"))).alias("passed"),
        (F.col("is_cross_domain") & (covered < 0.5)).alias("thin_coverage"),
        (F.length(F.trim(F.coalesce("summary", F.lit("")))) < 30).alias("short_summary"),
        rounded(average * (0.8 + 0.2 * n / F.greatest(n, F.lit(10))), 6).alias("quality_score"),
    )


FALLBACK_SUMMARY = (
    "Found %s examination(s) matching your search. Detailed advisory summary was unavailable — "
    "please review the exam cards below for dates, costs, and preparation resources."
)

# What a retry after each recovery strategy changes.
RECOVERY_EFFECTS = {
    "broaden_shards": "broaden_shards",
    "direct_llm": "skip_rag",
    "bm25_only": "bm25_only",
    "skip_enrichment": "skip_enrichment",
    "truncate_summary": "use_fallback_summary",
}


def recovery_action(failed: DataFrame) -> DataFrame:
    """What to do about each failed ``(run_id, stage, retries_used, found_rows)``."""
    strategy = F.create_map(*[F.lit(x) for s in STAGES for x in (s[0], s[2])])
    retries = F.create_map(*[F.lit(x) for s in STAGES for x in (s[0], s[3])])
    effect = F.create_map(*[F.lit(x) for pair in RECOVERY_EFFECTS.items() for x in pair])
    stage = F.col("stage")
    can_retry = F.col("retries_used") < F.try_element_at(retries, stage)
    action = F.when(can_retry, F.try_element_at(strategy, stage)).otherwise(F.lit("abort"))
    return failed.select(
        "run_id", "stage", "retries_used",
        action.alias("action"),
        F.try_element_at(effect, action).alias("retry_change"),
        F.when(action.isin("broaden_shards", "direct_llm"), 1).otherwise(0).alias("min_results"),
        F.when(action == "truncate_summary", F.format_string(FALLBACK_SUMMARY, "found_rows")).alias("fallback_summary"),
    )


def run_audit(stages: DataFrame) -> DataFrame:
    """One record per run from ``(run_id, stage, status, quality_score, note)`` rows.

    A stage that ran several times keeps its worst status; a run has at most the
    five known stages, so its nested record stays small.
    """
    known = stages.filter(F.col("stage").isin([s[0] for s in STAGES]))
    per_stage = known.groupBy("run_id", "stage").agg(
        F.bool_or(F.col("status") == "failed").alias("failed"),
        F.bool_or(F.col("status") == "rolled_back").alias("rolled_back"),
        F.min("quality_score").alias("quality_score"), F.max("note").alias("note"),
    )
    failed, rolled_back = F.col("failed"), F.col("rolled_back")
    entry = F.struct("stage", F.struct((~failed).alias("passed"), F.col("quality_score")).alias("validation"))
    return per_stage.groupBy("run_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("validations"),
        F.sort_array(F.collect_list(F.when(~failed, F.col("stage")))).alias("done"),
        F.sort_array(F.collect_list(F.when(failed, F.col("stage")))).alias("failed_stages"),
        F.sort_array(F.collect_list(F.when(rolled_back, F.struct("stage", "note")))).alias("rollbacks"),
        F.bool_or(failed | rolled_back).alias("degraded"),
    )
