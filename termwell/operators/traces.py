"""Run, cost, failure and traffic analytics over trace and request tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termwell.functions.numbers import rounded
from termwell.operators.joins import lookup_join
from termwell.operators.querylog import MICROS, ttl_anchors
from termwell.operators.scan import SLICE, join_slices, numbered, previous, running, sliced
from termwell.session import durable
from termwell.vocab import runs as rules


def recent_runs(runs: DataFrame, run_type: str, limit: int = 20) -> DataFrame:
    """The newest runs of a type."""
    wanted = runs.filter(F.col("run_type") == run_type)
    return wanted.orderBy(F.desc("start_time"), F.desc("run_id")).limit(min(max(limit, 1), 100))


def latency_ms(start: Column, end: Column) -> Column:
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return F.floor(micros / 1000)


def run_format(runs: DataFrame) -> DataFrame:
    """Runs with latency and empty collections in place of nulls."""
    return runs.withColumns({
        "latency_ms": latency_ms(F.col("start_time"), F.col("end_time")),
        "tags": F.coalesce("tags", F.array().cast("array<string>")),
        "metadata": F.coalesce("metadata", F.create_map().cast("map<string,string>")),
    })


def run_tree(runs: DataFrame) -> DataFrame:
    """Top-level runs and their direct children as rows ``(root_id, depth, run…)``.

    A long table instead of a child list: a run may have any number of children.
    """
    roots = runs.filter(F.col("parent_run_id").isNull())
    top = roots.select(F.col("run_id").alias("root_id"), F.lit(0).alias("depth"), *runs.columns)
    parents = roots.select(F.col("run_id").alias("root_id"), F.lit(True).alias("_is_root"))
    children = lookup_join(
        runs.filter(F.col("parent_run_id").isNotNull()).withColumn("root_id", F.col("parent_run_id")),
        parents, ["root_id"], "inner",
    ).select("root_id", F.lit(1).alias("depth"), *runs.columns)
    return top.unionByName(children)


def _stats() -> list[Column]:
    done = F.col("end_time").isNotNull() & F.col("start_time").isNotNull() & F.col("error").isNull()
    n, errors = F.count(F.lit(1)), F.count_if(F.col("error").isNotNull())
    micros = F.unix_micros(F.col("end_time").cast("timestamp")) - F.unix_micros(F.col("start_time").cast("timestamp"))
    total_tokens = F.coalesce(F.sum("total_tokens"), F.lit(0))
    return [
        n.alias("total_runs"), F.count_if(done).alias("completed_runs"), errors.alias("error_runs"),
        F.round(errors / F.greatest(n, F.lit(1)), 3).alias("error_rate"),
        F.round(F.coalesce(F.avg(F.when(done, micros / 1000)), F.lit(0.0)), 3).alias("avg_latency_ms"),
        total_tokens.alias("total_tokens"),
        F.round(total_tokens * rules.FLAT_TOKEN_PRICE, 4).alias("estimated_cost_usd"),
    ]


def _since(runs: DataFrame, as_of: Column, hours: int) -> DataFrame:
    return runs.filter((F.col("start_time") >= as_of - F.expr(f"INTERVAL {hours} HOURS")) & (F.col("start_time") <= as_of))


def run_stats(runs: DataFrame, as_of: Column, hours: int = 24, by_hour: bool = False) -> DataFrame:
    """Totals, error rate, latency and flat cost over the last hours, in one row or per hour."""
    recent = _since(runs, as_of, hours)
    if not by_hour:
        return recent.agg(*_stats())
    return recent.groupBy(F.window("start_time", "1 hour").alias("_w")).agg(*_stats()).select(
        F.col("_w.start").alias("hour"), "*"
    ).drop("_w")


def nearest_rank(rows: DataFrame, group: Sequence[str], value: str, share: float = 0.95) -> DataFrame:
    """The value at 0-based rank ``floor(n · share)`` of each group, exact.

    Equal values are counted first; the running count then passes through sorted
    slices, so a group of any size is spread over all tasks.
    """
    counted = rows.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running(counted, group, [value], {"_upto": ("sum", F.col("_n"))}, totals=True)
    reached = F.col("_upto") > F.floor(F.col("_upto_total") * share)
    return ranked.groupBy(*group).agg(
        F.max("_upto_total").alias("n"), F.min(F.when(reached, F.col(value))).alias("value")
    )


def approximate_rank(rows: DataFrame, group: Sequence[str], value: str, share: float = 0.95) -> DataFrame:
    """Cheaper variant of ``nearest_rank`` by a mergeable sketch."""
    return rows.groupBy(*group).agg(
        F.count(value).alias("n"), F.percentile_approx(value, share, 10_000).alias("value")
    )


def price(model: Column) -> tuple[Column, Column]:
    """USD per million input and output tokens of a model.

    An exact name first, then the first table row where one name begins with the
    other (compared up to 20 characters), else the default. A blank name takes
    the default.
    """
    name = F.lower(F.coalesce(model, F.lit("")))
    default_in, default_out = rules.DEFAULT_PRICE

    def pick(part: int, default: float) -> Column:
        exact, near = F, F.when(name == "", F.lit(default))
        for entry in rules.PRICES:
            alike = F.startswith(name, F.lit(entry[0])) | F.startswith(F.lit(entry[0]), F.substring(name, 1, 20))
            exact = exact.when(name == entry[0], F.lit(entry[part]))
            near = near.when(alike, F.lit(entry[part]))
        return F.coalesce(exact.otherwise(None), near.otherwise(F.lit(default)))

    return pick(1, default_in), pick(2, default_out)


def token_cost(input_tokens: Column, output_tokens: Column, model: Column) -> Column:
    price_in, price_out = price(model)
    return (input_tokens * price_in + output_tokens * price_out) / 1_000_000


def call_costs(calls: DataFrame) -> DataFrame:
    """Tokens and cost per call; usage comes from whichever place holds it.

    ``calls`` has ``usage_in``/``usage_out`` and the fallbacks ``meta_in``/``meta_out``.
    """
    tokens_in = F.coalesce("usage_in", "meta_in", F.lit(0)).cast("long")
    tokens_out = F.coalesce("usage_out", "meta_out", F.lit(0)).cast("long")
    return calls.withColumns({"input_tokens": tokens_in, "output_tokens": tokens_out}).withColumn(
        "cost_usd", token_cost(F.col("input_tokens"), F.col("output_tokens"), F.col("model"))
    )


def stage_calls(calls: DataFrame, order: str = "call_id") -> DataFrame:
    """Per-call breakdown as a long table with the number of the call in its stage."""
    costed = call_costs(calls).select(
        "run_id", "agent", order, "model", "input_tokens", "output_tokens", rounded(F.col("cost_usd"), 6).alias("cost_usd")
    )
    return numbered(costed, ["run_id", "agent"], [order], "call_no")


def stage_cost(calls: DataFrame) -> DataFrame:
    """Tokens, calls and cost per run and stage."""
    return call_costs(calls).groupBy("run_id", "agent").agg(
        F.count(F.lit(1)).alias("call_count"),
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"),
        rounded(F.sum("cost_usd"), 6).alias("cost_usd"),
    )


def run_cost_total(calls: DataFrame) -> DataFrame:
    """Costs per run and stage with totals per run and over all (null keys)."""
    return call_costs(calls).rollup("run_id", "agent").agg(
        F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"),
        rounded(F.sum("cost_usd"), 6).alias("cost_usd"),
    )


def calls_saved(traces: DataFrame) -> DataFrame:
    """Stages per run that were served without a model call."""
    return traces.groupBy("run_id").agg(F.count_if(F.col("rag_source").isin("rag", "bm25")).alias("llm_calls_saved"))


def source_rollup(sources: DataFrame) -> DataFrame:
    """"rag" for stages whose parts all came from there, else "mixed"."""
    return sources.groupBy("run_id", "stage").agg(
        F.when(F.bool_and(F.col("rag_source") == "rag"), F.lit("rag")).otherwise(F.lit("mixed")).alias("rag_source")
    )


def source_label(sources: DataFrame) -> DataFrame:
    """Distinct sources of a run joined by "+" in order of appearance."""
    distinct = sources.filter(F.col("rag_source").isNotNull()).groupBy("run_id", "rag_source").agg(F.min("ord").alias("_at"))
    labels = distinct.groupBy("run_id").agg(
        F.sort_array(F.collect_list(F.struct("_at", "rag_source"))).alias("_s")
    ).select("run_id", F.array_join(F.col("_s.rag_source"), "+").alias("label"))
    return sources.select("run_id").distinct().join(labels, "run_id", "left").select(
        "run_id", F.coalesce(F.nullif("label", F.lit("")), F.lit("mixed")).alias("label")
    )


def gateway_stats(outcomes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Dispatch counters and success rate of ``(outcome)`` rows."""
    counters = {
        "total_successes": "success", "total_failures": "failure", "total_timeouts": "timeout",
        "total_fallbacks": "fallback", "total_blocked": "blocked", "total_cache_hits": "cache_hit",
    }
    n = F.count(F.lit(1))
    return outcomes.groupBy(*by).agg(
        n.alias("total_dispatches"),
        *[F.count_if(F.col("outcome") == outcome).alias(name) for name, outcome in counters.items()],
        F.round(F.count_if(F.col("outcome") == "success") / F.greatest(n, F.lit(1)), 3).alias("success_rate"),
    )


def deadline_exceeded(requests: DataFrame, now: Column) -> DataFrame:
    """Elapsed and remaining seconds of ``(created_at, timeout_s)`` rows."""
    micros = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))
    elapsed = micros / MICROS
    return requests.select(
        "*", F.round(elapsed, 6).alias("elapsed_s"),
        F.round(F.greatest(F.lit(0.0), F.col("timeout_s") - elapsed), 6).alias("remaining_s"),
        (elapsed >= F.col("timeout_s")).alias("timed_out"),
    )


def failure_runs(calls: DataFrame, threshold: int = rules.FAILURE_THRESHOLD) -> DataFrame:
    """Unbroken runs of failures per agent of ``(agent, ts, call_id, failed)`` rows."""
    marked = running(
        calls.select("agent", "ts", "call_id", "failed"), ["agent"], ["ts", "call_id"],
        {"island": ("sum", F.when(F.col("failed"), 0).otherwise(1))},
    )
    return marked.filter("failed").groupBy("agent", "island").agg(
        F.count(F.lit(1)).alias("failures"),
        F.min("ts").alias("first_failure_at"), F.max("ts").alias("last_failure_at"),
    ).withColumn("flagged", F.col("failures") >= threshold)


def breaker_states(calls: DataFrame, threshold: int = rules.FAILURE_THRESHOLD,
                   recovery_s: float = rules.RECOVERY_SECONDS, group_rows: int = 10_000) -> DataFrame:
    """Breaker state of the agent after each call of ``(agent, ts, call_id, failed)``.

    A breaker opens at the fifth failure in a row. From the recovery time on the
    next call finds it half open; two successes in a row close it, and a failure
    that is at least the fifth in a row opens it again.

    So it opens at the first such failure, and then at each first one that comes
    at least the recovery time later: the chain of ``ttl_anchors``. All other
    parts of the state follow from running sums and maxima. The calls are cut into
    slices and stored once; every running value is taken inside of them and
    completed with a row per slice and agent.
    """
    order = ["ts", "call_id"]
    recovery = int(recovery_s * MICROS)
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = sliced(calls.select("agent", *order, "failed").withColumn("t", t), ["agent"], order)
    local = W.partitionBy(SLICE, "agent").orderBy(*order)
    upto = local.rowsBetween(W.unboundedPreceding, 0)
    earlier = W.partitionBy("agent").orderBy(SLICE).rowsBetween(W.unboundedPreceding, -1)

    # What the slices before hold: their number of calls, the place of the last success, the last call.
    rows = rows.withColumn("place", F.row_number().over(local))
    ahead = rows.groupBy(SLICE, "agent").agg(
        F.count(F.lit(1)).alias("calls"), F.max(F.when(~F.col("failed"), F.col("place"))).alias("success"),
        F.max(F.struct(*order, "failed", "t")).alias("tail"),
    ).withColumn("offset", F.coalesce(F.sum("calls").over(earlier), F.lit(0)))
    ahead = ahead.select(
        SLICE, "agent", "offset", F.max(F.col("offset") + F.col("success")).over(earlier).alias("success"),
        F.max("tail").over(earlier).alias("tail"))
    rows = join_slices(rows, ahead, ["agent"]).withColumn("place", F.col("offset") + F.col("place"))
    success = F.coalesce(F.max(F.when(~F.col("failed"), F.col("place"))).over(upto), F.col("success"), F.lit(0))
    before = F.coalesce(F.lag(F.struct("failed", "t")).over(local), F.struct("tail.failed", "tail.t"))
    rows = rows.select(
        SLICE, "agent", *order, "failed", "t", before.alias("before"),
        F.when(F.col("failed"), F.col("place") - success).otherwise(F.lit(0)).alias("in_a_row"))

    triggers = durable(rows.filter(F.col("in_a_row") >= threshold).select("agent", "t", "call_id"))
    anchors = ttl_anchors(triggers, "agent", F.col("t"), recovery, group_rows)
    opening = durable(triggers.join(anchors.withColumnRenamed("anchor", "t"), ["agent", "t"]).groupBy("agent", "t").agg(
        F.min("call_id").alias("call_id"), F.lit(True).alias("opens")))

    def latest(rows: DataFrame, when: Column, name: str) -> DataFrame:
        """Add time and number of the last call so far, in this slice or an earlier one, for which a condition holds."""
        place = F.when(when, F.struct("t", "call_id"))
        ahead = rows.groupBy(SLICE, "agent").agg(F.max(place).alias("_ahead")).select(
            SLICE, "agent", F.max("_ahead").over(earlier).alias("_ahead"))
        return join_slices(rows, ahead, ["agent"]).withColumn(
            name, F.coalesce(F.max(place).over(upto), F.col("_ahead"))).drop("_ahead")

    opened = latest(rows.join(opening, ["agent", "t", "call_id"], "left"), F.col("opens"), "open_at")
    half_open_at = F.col("open_at.t") + recovery
    closes = ~F.col("failed") & ~F.col("before.failed") & (F.col("before.t") >= half_open_at)
    closed = latest(opened, closes, "closed_at")
    state = (
        F.when(F.col("open_at").isNull(), F.lit("closed"))
        .when(F.col("t") < half_open_at, F.lit("open"))
        .when(F.col("closed_at") > F.col("open_at"), F.lit("closed"))
        .otherwise(F.lit("half_open"))
    )
    return closed.select("agent", *order, "failed", "in_a_row", state.alias("state"), "open_at")


def health_rollup(states: DataFrame, as_of: Column, recovery_s: float = rules.RECOVERY_SECONDS) -> DataFrame:
    """Latest breaker state and counters per agent, and whether any agent is open."""
    place = F.struct("ts", "call_id")
    now = F.unix_micros(as_of.cast("timestamp"))
    recovered = now >= F.col("open_at.t") + int(recovery_s * MICROS)
    per_agent = states.groupBy("agent").agg(
        F.max_by("state", place).alias("state"), F.max_by("open_at", place).alias("open_at"),
        F.max_by("in_a_row", place).alias("consecutive_failures"),
        F.count(F.lit(1)).alias("total_calls"), F.count_if("failed").alias("total_failures"),
        F.count_if(~F.col("failed")).alias("total_successes"),
        F.max(F.when(F.col("failed"), F.col("ts"))).alias("last_failure_at"),
    ).withColumn("state", F.when((F.col("state") == "open") & recovered, F.lit("half_open")).otherwise(F.col("state"))).drop("open_at")
    degraded = per_agent.agg(F.bool_or(F.col("state") == "open").alias("d")).scalar()
    return per_agent.withColumn("degraded", degraded)


def client_rate(requests: DataFrame, limit: int = rules.SEARCH_RATE_LIMIT,
                seconds: int = rules.RATE_WINDOW_SECONDS) -> DataFrame:
    """Requests per client and fixed time window, flagged above the limit."""
    return requests.groupBy(F.window("ts", f"{seconds} seconds").alias("_w"), "client").agg(
        F.count(F.lit(1)).alias("requests")
    ).select("client", F.col("_w.start").alias("window_start"), "requests", (F.col("requests") > limit).alias("limited"))


def log_levels(requests: DataFrame) -> DataFrame:
    """Requests and durations per path and level; probe paths are left out."""
    level = F.when(F.col("status_code") >= 400, F.lit("WARNING")).otherwise(F.lit("INFO"))
    return requests.filter(~F.col("path").isin(rules.SKIPPED_PATHS)).groupBy("path", level.alias("level")).agg(
        F.count(F.lit(1)).alias("requests"), F.round(F.avg("duration_ms"), 3).alias("avg_duration_ms"),
        F.max("duration_ms").alias("max_duration_ms"),
    )


def run_progress(events: DataFrame, event_types: Sequence[str], planned: str, finished: str) -> DataFrame:
    """Per run: last time of each event type, latest event, shards planned and finished, count and error flag.

    A shard is planned by an event of the type ``planned`` and finished by one of ``finished``.
    """
    return events.groupBy("run_id").agg(
        *[F.max(F.when(F.col("event_type") == kind, F.col("ts"))).alias(f"last_{kind}") for kind in event_types],
        F.max_by("event_type", F.struct("ts", "event_id")).alias("last_event"),
        F.count_if(F.col("event_type") == planned).alias("shards_planned"),
        F.count_if(F.col("event_type") == finished).alias("shards_finished"),
        F.count(F.lit(1)).alias("events"),
        F.bool_or(F.col("event_type") == "error").alias("has_error"),
    )


def stage_durations(events: DataFrame) -> DataFrame:
    """Milliseconds from the previous event of the same run; null for its first."""
    scanned = previous(events, ["run_id"], ["ts", "event_id"], ["ts"])
    return scanned.withColumn("duration_ms", latency_ms(F.col("prev_ts"), F.col("ts"))).drop("prev_ts")


def run_durations(stages: DataFrame) -> DataFrame:
    """Total of the stage durations per run."""
    return stages.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("events"), F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("total_ms")
    )
