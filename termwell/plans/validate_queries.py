"""Result-set checks per run, with orders as runs and their lines as results."""

from __future__ import annotations

from pyspark.sql import functions as F

from termwell.operators import validate as V
from termwell.plans.intent_queries import DOMAINS_SQL, all_sql, lit, words_apart
from termwell.plans.registry import query
from termwell.plans.tables import ctes, frame, provided, wide_frame
from termwell.vocab import query_rules as rules
from termwell.vocab.runs import STAGES


@query("validate_plan", """WITH shards AS (SELECT l_orderkey AS run_id, l_shipdate AS query FROM lineitem)
SELECT o_orderkey AS run_id, coalesce(n, 0) AS shards, coalesce(n, 0) >= 2 AS passed, round(least(1.0::DOUBLE, coalesce(n, 0) / 2::DOUBLE), 3) AS quality_score,
  coalesce(d, 0) < coalesce(n, 0) AS duplicate_queries
FROM orders LEFT JOIN (SELECT run_id, count(*) AS n, count(DISTINCT query) AS d FROM shards GROUP BY 1) ON run_id = o_orderkey""")
def validate_plan(spark, sf):
    runs = provided(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"))
    shards = provided(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), F.col("l_shipdate").alias("query")
    )
    return V.validate_plan(runs, shards, 2)


# The run's own rows, and a plan whose domains come from a text per run.
_TOPIC = """CASE o_orderkey % 4 WHEN 0 THEN 'medical doctor exam' WHEN 1 THEN 'compare law and business' WHEN 2 THEN 'cloud certification or language or graduate' ELSE 'other' END"""
_PLANS = f"""q AS (SELECT o_orderkey AS query_id, {_TOPIC} AS text, {_TOPIC} AS w FROM orders),
plans AS (SELECT query_id AS run_id, domains, len(domains) > 1 AS is_cross_domain, CASE WHEN len(domains) > 1 THEN 3 ELSE 2 END AS min_items,
  CASE WHEN len(domains) > 1 THEN 0.6::DOUBLE ELSE 0 END AS min_coverage, CASE WHEN len(domains) > 1 THEN 0.35::DOUBLE ELSE 0.45 END AS min_result_quality
  FROM (SELECT query_id, {DOMAINS_SQL} AS domains FROM q))"""
_DOMAIN_TEXT = words_apart("lower(concat_ws(' ', name, category, array_to_string(tags, ' ')))")
_FLAGS = f"""row_domains AS (SELECT run_id, unnest({all_sql(rules.DOMAIN_RULES)}) AS domain FROM (SELECT run_id, {_DOMAIN_TEXT} AS w FROM ranked)),
found AS (SELECT run_id, list(DISTINCT domain) AS found FROM row_domains GROUP BY 1),
counts AS (SELECT run_id, count(*) AS n, count(DISTINCT trim(lower(name), ' ')) AS names, avg(score) AS avg_score FROM ranked GROUP BY 1)"""
_BASE = f"{ctes('ranked')}, {_PLANS}, {_FLAGS}"
_JOINED = "plans p LEFT JOIN found f USING (run_id) LEFT JOIN counts c USING (run_id)"
_ORDER = "[" + ", ".join(lit(d) for d in V.DOMAIN_NAMES) + "]"


def _covered(expected: str = "p.domains") -> str:
    return f"list_filter({expected}, lambda d: list_contains(coalesce(f.found, []), d))"


def _plans(spark, sf):
    topic = F.expr(_TOPIC)
    orders = provided(spark, sf, "orders").select(F.col("o_orderkey").alias("query_id"), topic.alias("text"))
    return V.plan_rules(orders).withColumnRenamed("query_id", "run_id")


def _rows(spark, sf):
    """Ranked rows with the domains of their catalog rows, which are found before the join."""
    found = V.with_row_domains(wide_frame(spark, sf, "listing")).select("ord", "row_domains")
    return frame(spark, sf, "ranked").join(found, "ord", "left")


@query("covered_domains", f"{_BASE} SELECT run_id, array_to_string(p.domains, ', ') AS domains, array_to_string({_covered()}, ', ') AS covered FROM {_JOINED}")
def covered_domains(spark, sf):
    found = V.covered_domains(_rows(spark, sf), _plans(spark, sf))
    return found.select("run_id", F.array_join("domains", ", ").alias("domains"), F.array_join("covered", ", ").alias("covered"))


@query("cross_domain", f"""{_BASE} SELECT run_id, array_to_string(list_filter(p.domains, lambda d: NOT list_contains(coalesce(f.found, []), d)), ', ') AS missing,
  round(len({_covered()}) / len(p.domains)::DOUBLE, 3) AS quality_score, len({_covered()}) = len(p.domains) AS passed FROM {_JOINED}""")
def cross_domain(spark, sf):
    return V.cross_domain(_rows(spark, sf), _plans(spark, sf)).withColumn("missing", F.array_join("missing", ", "))


_SHARE = f"(len({_covered()}) / len(p.domains)::DOUBLE)"


@query("validate_search", f"""{_BASE} SELECT run_id, coalesce(n, 0) AS rows, coalesce(n - names, 0) AS duplicates, round({_SHARE}, 3) AS coverage,
  coalesce(n, 0) > 0 AND coalesce(n, 0) >= min_items AND NOT (is_cross_domain AND min_coverage > 0 AND {_SHARE} < min_coverage) AS passed,
  coalesce(n - names, 0) > 1 AS many_duplicates, round(least(1.0::DOUBLE, coalesce(n, 0) / (min_items * 3)::DOUBLE), 3) AS quality_score FROM {_JOINED}""")
def validate_search(spark, sf):
    return V.validate_search(_rows(spark, sf), _plans(spark, sf), 1)


@query("validate_ranking", f"""{ctes('ranked')}, shuffled AS (SELECT run_id, position, name, CASE WHEN run_id % 9 = 0 THEN 1 - score ELSE score END AS score FROM ranked),
pairs AS (SELECT *, lead(score) OVER (PARTITION BY run_id ORDER BY position) AS next FROM shuffled)
SELECT run_id, count(*) AS rows, count(*) - count(DISTINCT lower(name)) AS duplicates, count(*) - count(DISTINCT lower(name)) <= 0 AS passed,
  coalesce(bool_or(next > score), false) AS out_of_order, round(1.0::DOUBLE - (count(*) - count(DISTINCT lower(name))) / count(*)::DOUBLE * 0.5::DOUBLE, 3) AS quality_score FROM pairs GROUP BY run_id""")
def validate_ranking(spark, sf):
    score = F.when(F.col("run_id") % 9 == 0, 1 - F.col("score")).otherwise(F.col("score"))
    return V.validate_ranking(frame(spark, sf, "ranked").select("run_id", "position", "name", score.alias("score")), 0)


@query("validate_enrichment", f"""{ctes('sources')} SELECT run_id, count(*) AS rows, count(*) FILTER (WHERE rag_source = 'error') AS errors,
  round(1.0::DOUBLE - count(*) FILTER (WHERE rag_source = 'error') / count(*)::DOUBLE, 3) AS quality_score, count(*) FILTER (WHERE rag_source = 'error') > 0 AS warned FROM sources GROUP BY run_id""")
def validate_enrichment(spark, sf):
    return V.validate_enrichment(frame(spark, sf, "sources").select("run_id", F.col("rag_source").alias("source")))


_SUMMARIES = """summaries AS (SELECT doc_id AS run_id, CASE doc_id % 4 WHEN 0 THEN '**' || substr(text, 1, 20) || '** ' || text ELSE text END AS summary,
  doc_id % 3 <> 0 AS required FROM documents)"""


def _summaries(spark, sf):
    return provided(spark, sf, "documents").selectExpr(
        "doc_id AS run_id",
        "CASE doc_id % 4 WHEN 0 THEN concat('**', substr(text, 1, 20), '** ', text) ELSE text END AS summary",
        "doc_id % 3 <> 0 AS required",
    )


@query("validate_summary", rf"""WITH {_SUMMARIES} SELECT run_id, NOT required OR trim(summary, ' ') <> '' AS passed, round(least(1.0::DOUBLE, length(summary) / 300::DOUBLE), 3) AS quality_score,
  length(summary) > 0 AND length(summary) < 50 AS very_short, length(summary) > 0 AND NOT regexp_matches(summary, '\*\*[^*]+\*\*') AS nothing_bold FROM summaries""")
def validate_summary(spark, sf):
    checked = _summaries(spark, sf).select("run_id", V.validate_summary(F.col("summary"), F.col("required")).alias("v"))
    return checked.select("run_id", "v.*")


@query("final_quality", f"""{_BASE}, {_SUMMARIES} SELECT run_id, coalesce(n, 0) AS rows, CAST(round(CAST(coalesce(avg_score, 0) AS DECIMAL(20, 10)), 6) AS DOUBLE) AS avg_score,
  coalesce(n, 0) > 0 AND coalesce(avg_score, 0) >= min_result_quality AS passed, is_cross_domain AND {_SHARE} < 0.5 AS thin_coverage,
  length(trim(coalesce(summary, ''), ' ')) < 30 AS short_summary,
  CAST(round(CAST(coalesce(avg_score, 0) * (0.8::DOUBLE + 0.2::DOUBLE * coalesce(n, 0) / greatest(coalesce(n, 0), 10)::DOUBLE) AS DECIMAL(20, 10)), 6) AS DOUBLE) AS quality_score
FROM {_JOINED} LEFT JOIN summaries USING (run_id)""")
def final_quality(spark, sf):
    plans = _plans(spark, sf).join(_summaries(spark, sf).select("run_id", "summary"), "run_id", "left")
    return V.final_quality(_rows(spark, sf), plans)


_STAGE_VALUES = ", ".join(f"({lit(s)}, {lit(r)}, {lit(V.RECOVERY_EFFECTS[r])}, {k})" for s, _, r, k in STAGES)


@query("recovery_action", f"""{ctes('sources')}, rules(stage, strategy, effect, retries) AS (VALUES {_STAGE_VALUES}),
failed AS (SELECT run_id, ord, s.stage, CAST(ord % 3 AS INT) AS retries_used, CAST(ord % 50 AS INT) AS found_rows, CASE WHEN ord % 3 < retries THEN strategy ELSE 'abort' END AS action, effect
  FROM sources s JOIN rules USING (stage) WHERE status = 'failed')
SELECT run_id, stage, retries_used, action, CASE WHEN action <> 'abort' THEN effect END AS retry_change, CASE WHEN action IN ('broaden_shards', 'direct_llm') THEN 1 ELSE 0 END AS min_results,
  CASE WHEN action = 'truncate_summary' THEN replace({lit(V.FALLBACK_SUMMARY)}, '%s', CAST(found_rows AS VARCHAR)) END AS fallback_summary FROM failed""")
def recovery_action(spark, sf):
    failed = frame(spark, sf, "sources").filter("status = 'failed'").selectExpr(
        "run_id", "stage", "CAST(ord % 3 AS INT) AS retries_used", "CAST(ord % 50 AS INT) AS found_rows"
    )
    return V.recovery_action(failed)


@query("run_audit", f"""{ctes('sources')}, per_stage AS (SELECT run_id, stage, bool_or(status = 'failed') AS failed, bool_or(status = 'rolled_back') AS rolled_back, min(round(value, 2)) AS q FROM sources GROUP BY 1, 2)
SELECT run_id, count(*) AS stages, coalesce(string_agg(stage, ',' ORDER BY stage) FILTER (WHERE NOT failed), '') AS done, coalesce(string_agg(stage, ',' ORDER BY stage) FILTER (WHERE failed), '') AS failed_stages,
  count(*) FILTER (WHERE rolled_back) AS rollbacks, bool_or(failed OR rolled_back) AS degraded, round(sum(q), 2) AS quality FROM per_stage GROUP BY run_id""")
def run_audit(spark, sf):
    stages = frame(spark, sf, "sources").select(
        "run_id", "stage", "status", F.round("value", 2).alias("quality_score"), F.concat(F.lit("row "), "ord").alias("note")
    )
    audit = V.run_audit(stages)
    total = F.aggregate(F.map_values("validations"), F.lit(0.0), lambda a, v: a + v["quality_score"])
    return audit.select(
        "run_id", F.size("validations").cast("long").alias("stages"), F.array_join("done", ",").alias("done"),
        F.array_join("failed_stages", ",").alias("failed_stages"), F.size("rollbacks").cast("long").alias("rollbacks"), "degraded",
        F.round(total, 2).alias("quality"),
    )
