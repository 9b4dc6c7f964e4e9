"""Online forms of the batch operators as Structured Streaming jobs."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from termwell.functions.guards import invalid_request_field
from termwell.operators import catalog, quality, segments
from termwell.streaming.runner import each_batch, replace_batch
from termwell.vocab import runs as rules
from termwell.vocab.listing import CHUNK_TTL_DAYS

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def stream_rate(requests: DataFrame, limit: int = rules.SEARCH_RATE_LIMIT, seconds: int = rules.RATE_WINDOW_SECONDS,
                delay: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Requests per client and window, emitted once the watermark has passed it."""
    window = F.window("ts", f"{seconds} seconds", slide)
    return requests.withWatermark("ts", delay).groupBy(window.alias("_w"), "client").agg(
        F.count(F.lit(1)).alias("requests")
    ).select("client", F.col("_w.start").alias("window_start"), "requests", (F.col("requests") > limit).alias("limited"))


def stream_dedup(chunks: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The first copy of each chunk id within the watermark delay."""
    return chunks.withWatermark("stored_at", delay).dropDuplicatesWithinWatermark(["chunk_id"])


class ProgressProcessor(StatefulProcessor):
    """Progress of a run so far, as one state row that goes when the run has been quiet for a time."""

    def __init__(self, event_types: Sequence[str], planned: str, finished: str, idle_us: int):
        self.event_types, self.planned, self.finished, self.idle_us = list(event_types), planned, finished, idle_us
        self.names = [f"last_{kind}" for kind in self.event_types]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("progress", PROGRESS.format(", ".join(f"`{name}` bigint" for name in self.names)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            values = list(self.state.get())
            times, (at, number, last, planned, finished, events, error) = values[:len(self.names)], values[len(self.names):]
            self.handle.deleteTimer((at + self.idle_us) // 1000)
        else:
            times, (at, number, last, planned, finished, events, error) = [None] * len(self.names), (None, None, None, 0, 0, 0, False)
        for batch in rows:
            kinds = batch["event_type"]
            newest = batch.groupby("event_type")["t"].max()
            times = [max((t for t in (old, newest.get(kind)) if t is not None), default=None) for kind, old in zip(self.event_types, times)]
            top = batch.sort_values(["t", "event_id"]).iloc[-1]
            if at is None or (top["t"], top["event_id"]) > (at, number):
                at, number, last = int(top["t"]), int(top["event_id"]), top["event_type"]
            planned, finished = planned + int((kinds == self.planned).sum()), finished + int((kinds == self.finished).sum())
            events, error = events + len(batch), bool(error or (kinds == "error").any())
        times = [None if t is None else int(t) for t in times]
        self.state.update((*times, at, number, last, planned, finished, events, error))
        self.handle.registerTimer((at + self.idle_us) // 1000)
        yield pd.DataFrame({
            "run_id": [key[0]], **{name: pd.array([t], dtype="Int64") for name, t in zip(self.names, times)}, "last_event": [last],
            "shards_planned": [planned], "shards_finished": [finished], "events": [events], "has_error": [error]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield from ()

    def close(self) -> None:
        pass


PROGRESS = "{}, at bigint, number bigint, last string, planned bigint, finished bigint, events bigint, error boolean"


def stream_events(events: DataFrame, event_types: Sequence[str], planned: str, finished: str,
                  delay: str = "1 hour", idle: str = "1 day") -> DataFrame:
    """Progress per run, for update mode: the figures of ``run_progress`` over the events so far.

    A run is over when the watermark has passed its last event by ``idle``; its state goes, its last row stays
    with whoever keeps the updates. Events later than ``delay`` are left out.
    """
    kind, key = events.schema["ts"].dataType, events.schema["run_id"].dataType.simpleString()
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).select(
        "run_id", "event_type", F.col("event_id").cast("long").alias("event_id"), "ts", F.unix_micros("ts").alias("t"))
    idle_us = int(pd.Timedelta(idle).total_seconds() * 1_000_000)
    names = [f"last_{name}" for name in event_types]
    schema = (f"run_id {key}, {', '.join(f'`{name}` bigint' for name in names)}, last_event string, shards_planned bigint, "
              "shards_finished bigint, events bigint, has_error boolean")
    out = timed.groupBy("run_id").transformWithStateInPandas(
        ProgressProcessor(event_types, planned, finished, idle_us), schema, "Update", "EventTime")
    return out.withColumns({name: F.timestamp_micros(name).cast(kind) for name in names})


def stream_ingest(listing: DataFrame, path: str) -> None:
    """Continuous write-back: new listing rows become chunks and index postings.

    Every batch writes its own folders, so a repeated batch replaces itself. All
    chunks go to the store, which ``chunk_upsert`` reads, so a later version
    replaces an earlier one whatever batches they came in. The index grows by a segment
    per batch, merged as they gather, and skips chunk ids it holds; it looks them up in the
    ids of its few segments. A batch repeated after its segment was written adds nothing.
    """
    spark = listing.sparkSession

    def ingest(batch: DataFrame, batch_id: int) -> None:
        chunks = catalog.chunk_upsert(catalog.make_chunks(batch, F.col("stored_at")))
        replace_batch(chunks, batch_id, f"{path}/chunks")
        written = spark.read.parquet(f"{path}/chunks/batch={batch_id}")
        segments.merge(segments.add(segments.open_index(spark, f"{path}/index"), written))

    each_batch(listing, ingest, path)


def stream_guard(requests: DataFrame, path: str) -> None:
    """Check requests online; good ones and rejected ones go to folders of their own, in one pass over a batch."""

    def split(batch: DataFrame, batch_id: int) -> None:
        row = {column: F.col(column) for column in batch.columns}
        checked = quality.check_input(batch).withColumn("invalid_field", invalid_request_field(row))
        bad = (F.col("action") == "block") | F.col("invalid_field").isNotNull()
        sided = checked.withColumn("side", F.when(F.coalesce(bad, F.lit(False)), "rejected").otherwise("good"))
        sided.write.mode("overwrite").partitionBy("side").parquet(f"{path}/requests/batch={batch_id}")

    each_batch(requests, split, path)


class BreakerProcessor(StatefulProcessor):
    """Breaker state per agent, one small state row; calls are taken in time order."""

    def __init__(self, threshold: int, recovery_us: int, successes: int, strict: bool):
        self.threshold, self.recovery_us = threshold, recovery_us
        self.successes, self.strict = successes, strict

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("breaker", "state string, failures bigint, wins bigint, open_at bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        calls = pd.concat(list(rows)).sort_values(["t", "call_id"])
        state, failures, wins, open_at = self.state.get() if self.state.exists() else ("closed", 0, 0, 0)
        states = []
        for t, failed in zip(calls["t"], calls["failed"]):
            if state == "open" and t - open_at >= self.recovery_us:
                state, wins = "half_open", 0
            if failed:
                failures, wins = failures + 1, 0
                at_once = self.strict and state == "half_open"
                if state != "open" and (failures >= self.threshold or at_once):
                    state, open_at = "open", int(t)
            else:
                failures, wins = 0, wins + 1
                if state == "half_open" and wins >= self.successes:
                    state, wins = "closed", 0
            states.append((state, failures))
        self.state.update((state, failures, wins, open_at))
        yield pd.DataFrame({
            "agent": key[0], "call_id": calls["call_id"].to_numpy(),
            "in_a_row": [f for _, f in states], "state": [s for s, _ in states],
        })

    def close(self) -> None:
        pass


def stream_breaker(calls: DataFrame, threshold: int = rules.FAILURE_THRESHOLD,
                   recovery_s: float = rules.RECOVERY_SECONDS, strict: bool = False) -> DataFrame:
    """Breaker state after each call of ``(agent, ts, call_id, failed)``, online.

    ``strict`` opens a half-open breaker at its first failure.
    """
    timed = calls.select(
        "agent", "call_id", "failed", F.unix_micros(F.col("ts").cast("timestamp")).alias("t")
    )
    processor = BreakerProcessor(threshold, int(recovery_s * 1_000_000), rules.SUCCESS_THRESHOLD, strict)
    return timed.groupBy("agent").transformWithStateInPandas(
        processor, "agent string, call_id bigint, in_a_row bigint, state string", "Append", "None"
    )


class ExpiryProcessor(StatefulProcessor):
    """Latest storage time per key; reports the key once its time to live is over."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stored = handle.getValueState("stored", "stored_ms bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = max(int(batch["stored_ms"].max()) for batch in rows)
        known = self.stored.get()[0] if self.stored.exists() else None
        if known is None or newest > known:
            if known is not None:
                self.handle.deleteTimer(known + self.ttl_ms)
            self.stored.update((newest,))
            self.handle.registerTimer(newest + self.ttl_ms)
        yield pd.DataFrame({"key": pd.Series([], dtype=str), "expired_ms": pd.Series([], dtype="int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        self.stored.clear()
        yield pd.DataFrame({"key": [key[0]], "expired_ms": [at]})

    def close(self) -> None:
        pass


def stream_expiry(stored: DataFrame, delay: str = "0 seconds", ttl_days: float = CHUNK_TTL_DAYS) -> DataFrame:
    """Keys of ``(key, stored_at)`` whose time to live ran out before the watermark."""
    timed = stored.withWatermark("stored_at", delay).select(
        "key", "stored_at", F.unix_millis("stored_at").alias("stored_ms")
    )
    return timed.groupBy("key").transformWithStateInPandas(
        ExpiryProcessor(int(ttl_days * 86_400_000)), "key string, expired_ms bigint", "Append", "EventTime"
    )
