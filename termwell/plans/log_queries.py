"""Query-log analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from termwell.operators import querylog as L
from termwell.plans.registry import query
from termwell.plans.tables import ctes, frame, wide_frame
from termwell.operators.scan import previous

KEYED = ctes("keyed_log")

_ANCHORS = """anchors AS (
  SELECT key, min(ts) AS a FROM keyed_log GROUP BY key
  UNION ALL
  SELECT r.key, (SELECT min(k.ts) FROM keyed_log k WHERE k.key = r.key AND k.ts >= r.a + INTERVAL 24 HOURS)
  FROM anchors r WHERE EXISTS (SELECT 1 FROM keyed_log k WHERE k.key = r.key AND k.ts >= r.a + INTERVAL 24 HOURS))"""


@query("repeat_queries", f"""{KEYED.replace('WITH', 'WITH RECURSIVE', 1)}, {_ANCHORS}, stored AS (SELECT key, count(*) AS stored FROM anchors GROUP BY key)
SELECT key, count(*) AS uses, max(stored) AS stored, count(*) - max(stored) AS hits FROM keyed_log JOIN stored USING (key) GROUP BY key""")
def repeat_queries(spark, sf):
    return L.repeat_queries(frame(spark, sf, "keyed_log"))


@query("repeat_queries_gap", f"""{KEYED}, gaps AS (SELECT key, ts, lag(ts) OVER (PARTITION BY key ORDER BY ts, event_id) AS prev FROM keyed_log)
SELECT key, count(*) AS uses, count(*) FILTER (WHERE prev IS NULL OR ts >= prev + INTERVAL 3 HOURS) AS starts FROM gaps GROUP BY key""")
def repeat_queries_gap(spark, sf):
    """Cheaper variant: a use within three hours of the previous one is a repeat."""
    scanned = previous(frame(spark, sf, "keyed_log"), ["key"], ["ts", "event_id"], ["ts"])
    starts = F.col("prev_ts").isNull() | (F.col("ts") >= F.col("prev_ts") + F.expr("INTERVAL 3 HOURS"))
    return scanned.groupBy("key").agg(F.count(F.lit(1)).alias("uses"), F.count_if(starts).alias("starts"))


NEAR_SQL = f"""{ctes('query_log')}, used AS (SELECT query_id, ts, region, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS s FROM query_log),
sets AS (SELECT region, s, min(query_id) AS set_first FROM used WHERE len(s) > 0 GROUP BY 1, 2),
log AS (SELECT u.*, len(u.s) AS m, set_first FROM used u JOIN sets USING (region, s)),
pairs AS (SELECT a.query_id, b.set_first, a.s AS sa, b.s AS sb FROM log a JOIN log b ON b.region = a.region AND (b.ts, b.query_id) < (a.ts, a.query_id)
  AND b.ts > a.ts - INTERVAL 24 HOURS AND b.m >= 0.8::DOUBLE * a.m - 1e-9 AND a.m >= 0.8::DOUBLE * b.m - 1e-9),
scored AS (SELECT query_id, set_first, CASE WHEN sa = sb THEN 1.0::DOUBLE ELSE len(list_intersect(sa, sb)) / len(list_distinct(list_concat(sa, sb)))::DOUBLE END AS similarity FROM pairs),
near AS (SELECT query_id, set_first AS match_id, round(similarity, 6) AS similarity FROM scored WHERE similarity >= 0.8
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY scored.similarity DESC, set_first) = 1)"""


def _near(spark, sf):
    return L.near_dup_queries(wide_frame(spark, sf, "query_log").drop("category"), ["region"])


@query("near_dup_queries", f"{NEAR_SQL} SELECT * FROM near")
def near_dup_queries(spark, sf):
    return _near(spark, sf)


@query("query_log_stats", f"""{NEAR_SQL}, outcomes AS (SELECT l.query_id, CASE WHEN n.similarity IS NULL THEN 'miss' WHEN n.similarity = 1 THEN 'hit' ELSE 'near_hit' END AS outcome
  FROM query_log l LEFT JOIN near n USING (query_id)),
counted AS (SELECT count(*) AS lookups, count(*) FILTER (WHERE outcome = 'hit') AS hits, count(*) FILTER (WHERE outcome = 'near_hit') AS near_hits, count(*) FILTER (WHERE outcome = 'miss') AS misses FROM outcomes)
SELECT *, round(hits / greatest(hits + misses, 1)::DOUBLE, 3) AS hit_rate, round((hits + near_hits) / greatest(hits + near_hits + misses, 1)::DOUBLE, 3) AS any_hit_rate FROM counted""")
def query_log_stats(spark, sf):
    looked_up = frame(spark, sf, "query_log").select("query_id").join(_near(spark, sf), "query_id", "left")
    outcome = F.when(F.col("similarity").isNull(), "miss").when(F.col("similarity") == 1.0, "hit").otherwise("near_hit")
    return L.query_log_stats(looked_up.select(outcome.alias("outcome")))


@query("invalidate_keys", f"{KEYED} SELECT event_id, key FROM keyed_log WHERE key NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def invalidate_keys(spark, sf):
    gone = spark.read.parquet(f"{sf}/customer.parquet").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("key"))
    return L.invalidate_keys(frame(spark, sf, "keyed_log"), gone).select("event_id", "key")
