"""Run, cost, failure and traffic analytics over the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from termwell.operators import traces as O
from termwell.plans.registry import query
from termwell.plans.tables import EVENT_TYPES, LOG_END, ctes, frame
from termwell.vocab import runs as rules

RUNS = ctes("runs")
CALLS = ctes("calls")
SECOND = "'%Y-%m-%d %H:%M:%S'"


def _time(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


def _runs(spark, sf):
    return frame(spark, sf, "runs")


def _calls(spark, sf):
    return frame(spark, sf, "calls")


def _log_end():
    return F.lit(LOG_END).cast("timestamp_ntz")


@query("recent_runs", f"{RUNS} SELECT run_id, name, strftime(start_time, {SECOND}) AS start_time FROM runs WHERE run_type = 'chain' ORDER BY runs.start_time DESC, run_id DESC LIMIT 20")
def recent_runs(spark, sf):
    return O.recent_runs(_runs(spark, sf), "chain", 20).select("run_id", "name", _time("start_time"))


_LATENCY = "CAST(floor((epoch_us(end_time) - epoch_us(start_time)) / 1000) AS BIGINT)"


@query("run_format", f"{RUNS} SELECT run_id, status, {_LATENCY} AS latency_ms, 0 AS n_tags, 0 AS n_metadata, error FROM runs")
def run_format(spark, sf):
    bare = _runs(spark, sf).withColumns({
        "tags": F.lit(None).cast("array<string>"), "metadata": F.lit(None).cast("map<string,string>"),
    })
    return O.run_format(bare).select(
        "run_id", "status", "latency_ms", F.size("tags").alias("n_tags"), F.size("metadata").alias("n_metadata"), "error"
    )


@query("run_tree", f"""{RUNS} SELECT run_id AS root_id, 0 AS depth, run_id, name FROM runs WHERE parent_run_id IS NULL
UNION ALL SELECT c.parent_run_id, 1, c.run_id, c.name FROM runs c JOIN runs p ON p.run_id = c.parent_run_id AND p.parent_run_id IS NULL""")
def run_tree(spark, sf):
    return O.run_tree(_runs(spark, sf)).select("root_id", "depth", "run_id", "name")


_DONE = "end_time IS NOT NULL AND start_time IS NOT NULL AND error IS NULL"
_STATS = f"""count(*) AS total_runs, count(*) FILTER (WHERE {_DONE}) AS completed_runs, count(error) AS error_runs,
  round(count(error) / greatest(count(*), 1)::DOUBLE, 3) AS error_rate,
  round(coalesce(avg((epoch_us(end_time) - epoch_us(start_time)) / 1000::DOUBLE) FILTER (WHERE {_DONE}), 0), 3) AS avg_latency_ms,
  CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS total_tokens, round(coalesce(sum(total_tokens), 0) * 0.000006::DOUBLE, 4) AS estimated_cost_usd"""


@query("run_stats", f"{RUNS} SELECT {_STATS} FROM runs WHERE start_time >= TIMESTAMP '{LOG_END}' - INTERVAL 168 HOURS AND start_time <= TIMESTAMP '{LOG_END}'")
def run_stats(spark, sf):
    return O.run_stats(_runs(spark, sf), _log_end(), 168)


@query("run_stats_hourly", f"""{RUNS} SELECT strftime(date_trunc('hour', start_time), {SECOND}) AS hour, {_STATS} FROM runs
WHERE start_time >= TIMESTAMP '{LOG_END}' - INTERVAL 168 HOURS AND start_time <= TIMESTAMP '{LOG_END}' GROUP BY 1""")
def run_stats_hourly(spark, sf):
    return O.run_stats(_runs(spark, sf), _log_end(), 168, by_hour=True).withColumn("hour", _time("hour"))


@query("p95_nearest", """SELECT event_type AS name, count(*) AS n, list_sort(list(value))[CAST(floor(count(*) * 0.95::DOUBLE) AS INT) + 1] AS value FROM events GROUP BY 1""")
def p95_nearest(spark, sf):
    rows = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_type").alias("name"), "value")
    return O.nearest_rank(rows, ["name"], "value")


@query("p95_approximate", "SELECT event_type AS name, count(*) AS n, list_sort(list(value))[CAST(ceil(count(*) * 0.95::DOUBLE) AS INT)] AS value FROM events GROUP BY 1")
def p95_approximate(spark, sf):
    rows = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_type").alias("name"), "value")
    return O.approximate_rank(rows, ["name"], "value")


_PRICE_VALUES = ", ".join(f"({n}, '{m}', {i}::DOUBLE, {o}::DOUBLE)" for n, (m, i, o) in enumerate(rules.PRICES))
_PRICED = f"""prices(pos, model_name, p_in, p_out) AS (VALUES {_PRICE_VALUES}), models AS (SELECT DISTINCT model, lower(model) AS m FROM calls),
alike AS (SELECT model, p_in, p_out FROM models JOIN prices ON m <> '' AND (starts_with(m, model_name) OR starts_with(model_name, substr(m, 1, 20)))
  QUALIFY row_number() OVER (PARTITION BY model ORDER BY (m = model_name) DESC, pos) = 1),
priced AS (SELECT model, coalesce(p_in, 3.0) AS price_in, coalesce(p_out, 15.0) AS price_out FROM models LEFT JOIN alike USING (model)),
costed AS (SELECT *, CAST(coalesce(usage_in, meta_in, 0) AS BIGINT) AS input_tokens, CAST(coalesce(usage_out, meta_out, 0) AS BIGINT) AS output_tokens FROM calls JOIN priced USING (model)),
costs AS (SELECT *, (input_tokens * price_in + output_tokens * price_out) / 1000000 AS cost FROM costed)"""
PRICED = f"{CALLS}, {_PRICED}"


@query("price_lookup", f"{PRICED} SELECT model, price_in, price_out, count(*) AS calls FROM costs GROUP BY ALL")
def price_lookup(spark, sf):
    price_in, price_out = O.price(F.col("model"))
    return _calls(spark, sf).groupBy("model").agg(F.count(F.lit(1)).alias("calls")).select(
        "model", price_in.alias("price_in"), price_out.alias("price_out"), "calls"
    )


@query("token_cost", f"{PRICED} SELECT call_id, round(cost, 9) AS cost_usd FROM costs")
def token_cost(spark, sf):
    return O.call_costs(_calls(spark, sf)).select("call_id", F.round("cost_usd", 9).alias("cost_usd"))


_SIX = "CAST(round(CAST(sum(cost) AS DECIMAL(20, 10)), 6) AS DOUBLE)"


@query("stage_cost", f"""{PRICED} SELECT run_id, agent, count(*) AS call_count, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
  CAST(sum(input_tokens + output_tokens) AS BIGINT) AS total_tokens, {_SIX} AS cost_usd FROM costs GROUP BY ALL""")
def stage_cost(spark, sf):
    return O.stage_cost(_calls(spark, sf))


@query("stage_calls", f"""{PRICED} SELECT run_id, agent, call_id, model, input_tokens, output_tokens, CAST(round(CAST(cost AS DECIMAL(20, 10)), 6) AS DOUBLE) AS cost_usd,
  row_number() OVER (PARTITION BY run_id, agent ORDER BY call_id) AS call_no FROM costs""")
def stage_calls(spark, sf):
    return O.stage_calls(_calls(spark, sf))


@query("run_cost_total", f"{PRICED} SELECT run_id, agent, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS total_tokens, {_SIX} AS cost_usd FROM costs GROUP BY ROLLUP (run_id, agent)")
def run_cost_total(spark, sf):
    return O.run_cost_total(_calls(spark, sf))


SOURCES = ctes("sources")


@query("calls_saved", f"{SOURCES} SELECT run_id, count(*) FILTER (WHERE rag_source IN ('rag', 'bm25')) AS llm_calls_saved FROM sources GROUP BY run_id")
def calls_saved(spark, sf):
    return O.calls_saved(frame(spark, sf, "sources"))


@query("source_rollup", f"{SOURCES} SELECT run_id, stage, CASE WHEN bool_and(rag_source = 'rag') THEN 'rag' ELSE 'mixed' END AS rag_source FROM sources GROUP BY 1, 2")
def source_rollup(spark, sf):
    """All parts of each stage of a run."""
    return O.source_rollup(frame(spark, sf, "sources"))


@query("source_label", f"""{SOURCES}, firsts AS (SELECT run_id, rag_source, min(ord) AS pos FROM sources GROUP BY 1, 2)
SELECT run_id, coalesce(nullif(string_agg(rag_source, '+' ORDER BY pos), ''), 'mixed') AS label FROM firsts GROUP BY run_id""")
def source_label(spark, sf):
    return O.source_label(frame(spark, sf, "sources"))


_COUNTERS = ", ".join(
    f"count(*) FILTER (WHERE outcome = '{o}') AS {n}" for n, o in (
        ("total_successes", "success"), ("total_failures", "failure"), ("total_timeouts", "timeout"),
        ("total_fallbacks", "fallback"), ("total_blocked", "blocked"), ("total_cache_hits", "cache_hit"))
)


@query("gateway_stats", f"{SOURCES} SELECT count(*) AS total_dispatches, {_COUNTERS}, round(count(*) FILTER (WHERE outcome = 'success') / greatest(count(*), 1)::DOUBLE, 3) AS success_rate FROM sources")
def gateway_stats(spark, sf):
    return O.gateway_stats(frame(spark, sf, "sources"))


@query("deadline_exceeded", f"""SELECT event_id, round((epoch_us(TIMESTAMP '{LOG_END}') - epoch_us(ts)) / 1000000::DOUBLE, 6) AS elapsed_s,
  round(greatest(0.0::DOUBLE, value * 10000 - (epoch_us(TIMESTAMP '{LOG_END}') - epoch_us(ts)) / 1000000::DOUBLE), 6) AS remaining_s,
  (epoch_us(TIMESTAMP '{LOG_END}') - epoch_us(ts)) / 1000000::DOUBLE >= value * 10000 AS timed_out FROM events""")
def deadline_exceeded(spark, sf):
    requests = spark.read.parquet(f"{sf}/events.parquet").select(
        "event_id", F.col("ts").alias("created_at"), (F.col("value") * 10000).alias("timeout_s")
    )
    return O.deadline_exceeded(requests, _log_end()).drop("created_at", "timeout_s")


@query("failure_runs", f"""{CALLS}, marked AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY agent ORDER BY ts, call_id) AS island FROM calls)
SELECT agent, CAST(island AS BIGINT) AS island, count(*) AS failures, strftime(min(ts), {SECOND}) AS first_failure_at, strftime(max(ts), {SECOND}) AS last_failure_at, count(*) >= 5 AS flagged
FROM marked WHERE failed GROUP BY 1, 2""")
def failure_runs(spark, sf):
    found = O.failure_runs(_calls(spark, sf))
    return found.withColumns({"first_failure_at": _time("first_failure_at"), "last_failure_at": _time("last_failure_at")})


# The breaker call by call: times in seconds, one row of state per agent.
BREAKER_SQL = f"""{CALLS.replace('WITH', 'WITH RECURSIVE', 1)}, steps AS (SELECT agent, call_id, ts, failed, epoch_us(ts) AS t, row_number() OVER (PARTITION BY agent ORDER BY ts, call_id) AS n FROM calls),
machine AS (
  SELECT agent, CAST(0 AS BIGINT) AS n, CAST(-1 AS BIGINT) AS call_id, 'closed' AS state, CAST(0 AS BIGINT) AS failures, CAST(0 AS BIGINT) AS wins, CAST(0 AS BIGINT) AS open_at FROM steps GROUP BY agent
  UNION ALL
  SELECT agent, n, call_id,
    CASE WHEN failed AND before_state <> 'open' AND failures >= 5 THEN 'open' WHEN NOT failed AND before_state = 'half_open' AND wins >= 2 THEN 'closed' ELSE before_state END,
    failures, CASE WHEN NOT failed AND before_state = 'half_open' AND wins >= 2 THEN 0 ELSE wins END,
    CASE WHEN failed AND before_state <> 'open' AND failures >= 5 THEN t ELSE open_at END
  FROM (SELECT s.agent, s.n, s.call_id, s.failed, s.t, m.open_at,
      CASE WHEN m.state = 'open' AND s.t - m.open_at >= 3600000000 THEN 'half_open' ELSE m.state END AS before_state,
      CASE WHEN s.failed THEN m.failures + 1 ELSE 0 END AS failures,
      CASE WHEN s.failed THEN 0 WHEN m.state = 'open' AND s.t - m.open_at >= 3600000000 THEN 1 ELSE m.wins + 1 END AS wins
    FROM machine m JOIN steps s ON s.agent = m.agent AND s.n = m.n + 1)),
states AS (SELECT m.agent, m.call_id, m.failures AS in_a_row, m.state, m.open_at, s.ts, s.failed FROM machine m JOIN steps s USING (agent, n))"""
RECOVERY_S = 3600


@query("breaker_states", f"{BREAKER_SQL} SELECT agent, call_id, in_a_row, state FROM states")
def breaker_states(spark, sf):
    states = O.breaker_states(_calls(spark, sf), recovery_s=RECOVERY_S)
    return states.select("agent", "call_id", "in_a_row", "state")


@query("health_rollup", f"""{BREAKER_SQL}, agents AS (SELECT agent, last(state ORDER BY ts, call_id) AS state, last(in_a_row ORDER BY ts, call_id) AS consecutive_failures, last(open_at ORDER BY ts, call_id) AS open_at, count(*) AS total_calls,
  count(*) FILTER (WHERE failed) AS total_failures, count(*) FILTER (WHERE NOT failed) AS total_successes, strftime(max(ts) FILTER (WHERE failed), {SECOND}) AS last_failure_at FROM states GROUP BY agent),
now_states AS (SELECT * REPLACE (CASE WHEN state = 'open' AND epoch_us(TIMESTAMP '{LOG_END}') - open_at >= 3600000000 THEN 'half_open' ELSE state END AS state) FROM agents)
SELECT agent, state, consecutive_failures, total_calls, total_failures, total_successes, last_failure_at, (SELECT bool_or(state = 'open') FROM now_states) AS degraded FROM now_states""")
def health_rollup(spark, sf):
    states = O.breaker_states(_calls(spark, sf), recovery_s=RECOVERY_S)
    return O.health_rollup(states, _log_end(), RECOVERY_S).withColumn("last_failure_at", _time("last_failure_at"))


HTTP = ctes("http_requests")


@query("client_rate", f"""{HTTP} SELECT client, strftime(time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01 00:00:00'), {SECOND}) AS window_start, count(*) AS requests, count(*) > 1 AS limited FROM http_requests GROUP BY 1, 2""")
def client_rate(spark, sf):
    """Hourly windows and a limit of one, as the events are sparse."""
    return O.client_rate(frame(spark, sf, "http_requests"), 1, 3600).withColumn("window_start", _time("window_start"))


@query("log_levels", f"""{HTTP} SELECT path, CASE WHEN status_code >= 400 THEN 'WARNING' ELSE 'INFO' END AS level, count(*) AS requests, round(avg(duration_ms), 3) AS avg_duration_ms,
  max(duration_ms) AS max_duration_ms FROM http_requests WHERE path NOT IN ({', '.join(f"'{p}'" for p in rules.SKIPPED_PATHS)}) GROUP BY 1, 2""")
def log_levels(spark, sf):
    return O.log_levels(frame(spark, sf, "http_requests"))


PROGRESS_SQL = f"""{ctes('stage_events')} SELECT run_id, {', '.join(f"strftime(max(ts) FILTER (WHERE event_type = '{k}'), {SECOND}) AS last_{k}" for k in EVENT_TYPES)},
  last(event_type ORDER BY ts, event_id) AS last_event, count(*) FILTER (WHERE event_type = 'click') AS shards_planned,
  count(*) FILTER (WHERE event_type = 'purchase') AS shards_finished, count(*) AS events, bool_or(event_type = 'error') AS has_error FROM stage_events GROUP BY run_id"""


@query("run_progress", PROGRESS_SQL)
def run_progress(spark, sf):
    progress = O.run_progress(frame(spark, sf, "stage_events"), EVENT_TYPES, "click", "purchase")
    return progress.withColumns({f"last_{k}": _time(f"last_{k}") for k in EVENT_TYPES})


_DURATIONS = f"""{ctes('stage_events')}, durations AS (SELECT run_id, event_id, CAST(floor((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY run_id ORDER BY ts, event_id))) / 1000) AS BIGINT) AS duration_ms FROM stage_events)"""


@query("stage_durations", f"{_DURATIONS} SELECT * FROM durations")
def stage_durations(spark, sf):
    return O.stage_durations(frame(spark, sf, "stage_events")).select("run_id", "event_id", "duration_ms")


@query("run_durations", f"{_DURATIONS} SELECT run_id, count(*) AS events, CAST(coalesce(sum(duration_ms), 0) AS BIGINT) AS total_ms FROM durations GROUP BY run_id")
def run_durations(spark, sf):
    return O.run_durations(O.stage_durations(frame(spark, sf, "stage_events")))
