"""Streaming jobs run over all data present, with their batch results in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termwell.operators import segments
from termwell.plans.guard_queries import REQUEST_FIELD_SQL, VERDICT_SQL
from termwell.plans.registry import query
from termwell.plans.tables import EVENT_TYPES, frame
from termwell.plans.text_queries import CHUNKS_SQL
from termwell.plans.trace_queries import BREAKER_SQL, PROGRESS_SQL, RECOVERY_S, _time
from termwell.session import run_dir
from termwell.streaming import jobs
from termwell.streaming import runner as R


def _stream(rows: DataFrame, label: str, files: int | None = None, order: str | None = None) -> DataFrame:
    """A derived input written to the shared folder and read back as a stream.

    It is written as it is partitioned and read in one go, or, given an order, in
    so many range partitions of it, one per micro-batch.
    """
    spark = rows.sparkSession
    path = run_dir(spark, label)
    (rows.repartitionByRange(files, order) if order else rows).write.parquet(path)
    return R.table_stream(spark, path, max_files=1 if order else None)


def _timestamps(rows: DataFrame, column: str) -> DataFrame:
    return rows.withColumn(column, F.col(column).cast("timestamp"))


@query("stream_rate", """WITH windows AS (SELECT user_id AS client, time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01 00:00:00') AS window_start, count(*) AS requests FROM events GROUP BY 1, 2)
SELECT client, strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start, requests, requests > 1 AS limited FROM windows
WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTES FROM events)""")
def stream_rate(spark: SparkSession, sf: str) -> DataFrame:
    """Closed hourly windows; the last one stays open behind the watermark."""
    events = R.table_stream(spark, f"{sf}/events*.parquet").select(
        F.col("user_id").alias("client"), F.col("ts").cast("timestamp").alias("ts")
    )
    table = R.append_to_table(jobs.stream_rate(events, 1, 3600), "rate")
    return table.withColumn("window_start", _time("window_start"))


@query("stream_dedup", f"""{CHUNKS_SQL} SELECT chunk_id, count(*) AS copies FROM (SELECT DISTINCT chunk_id FROM store) GROUP BY chunk_id""")
def stream_dedup(spark, sf):
    """Chunks of all catalog rows, each id once; the delay spans all storage times."""
    from termwell.operators import catalog

    made = catalog.make_chunks(frame(spark, sf, "listing"), F.col("stored_at")).select("chunk_id", "stored_at")
    stream = _stream(made, "dedup")
    R.use_rocksdb(spark)
    kept = R.append_to_table(jobs.stream_dedup(stream, "400 days"), "dedup")
    return kept.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("copies"))


@query("stream_events", PROGRESS_SQL)
def stream_events(spark, sf):
    events = R.table_stream(spark, f"{sf}/events*.parquet").withColumnRenamed("user_id", "run_id")
    path = run_dir(spark, "progress")
    R.use_rocksdb(spark)
    # Runs of this table may be quiet for months.
    progress = jobs.stream_events(events, EVENT_TYPES, "click", "purchase", idle="400 days")
    R.each_batch(progress, lambda batch, number: R.replace_rows(batch, number, path, ["run_id"]), f"{path}/stream", "update")
    current = R.current_rows(spark, path, ["run_id"])
    return current.withColumns({f"last_{k}": _time(f"last_{k}") for k in EVENT_TYPES})


def _full_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Guarded requests with the remaining request fields left empty."""
    unset = {"sort_by": "string", "page": "int", "page_size": "int", "year": "int", "month": "string", "countries": "array<string>"}
    return frame(spark, sf, "guard_requests").select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in unset.items()])


_FIELD_SQL = REQUEST_FIELD_SQL.split(" WHEN sort_by", 1)[0] + " END"


@query("stream_guard", f"""{VERDICT_SQL}, joined AS (SELECT v.action, v.code, r.invalid_field FROM verdicts v JOIN (
  SELECT query_id, {_FIELD_SQL} AS invalid_field FROM guard_requests) r USING (query_id))
SELECT CASE WHEN action = 'block' OR invalid_field IS NOT NULL THEN 'rejected' ELSE 'good' END AS side, action, code, invalid_field, count(*) AS rows FROM joined GROUP BY ALL""")
def stream_guard(spark, sf):
    """Both sinks read back: rows per side, verdict and broken field."""
    path = run_dir(spark, "guard")
    jobs.stream_guard(_stream(_full_requests(spark, sf), "requests"), path)
    return spark.read.parquet(f"{path}/requests").groupBy("side", "action", "code", "invalid_field").agg(F.count(F.lit(1)).alias("rows"))


@query("stream_breaker", f"{BREAKER_SQL} SELECT agent, call_id, in_a_row, state FROM states")
def stream_breaker(spark, sf):
    """Calls in four files by time, one per micro-batch; equals the batch result."""
    R.use_rocksdb(spark)
    calls = frame(spark, sf, "calls").select("agent", "ts", "call_id", "failed")
    stream = _ordered_stream(calls, "calls", 4, "ts")
    return R.append_to_table(jobs.stream_breaker(stream, recovery_s=RECOVERY_S), "breaker")


def _ordered_stream(rows: DataFrame, label: str, files: int, order: str) -> DataFrame:
    """A stream whose files come in the order of a column.

    The file source takes files by modification time, so they are written one
    after another.
    """
    spark = rows.sparkSession
    path = run_dir(spark, label)
    bounds = rows.select(F.percentile_approx(F.col(order).cast("timestamp").cast("double"), [i / files for i in range(1, files)])).first()[0]
    number = F.lit(0)
    for bound in bounds:
        number = number + F.when(F.col(order).cast("timestamp").cast("double") > bound, 1).otherwise(0)
    numbered = rows.withColumn("_file", number)
    for at in range(files):
        numbered.filter(F.col("_file") == at).drop("_file").coalesce(1).write.mode("append").parquet(path)
    return R.table_stream(spark, path, max_files=1)


@query("stream_expiry", f"""{CHUNKS_SQL}, latest AS (SELECT chunk_id AS key, max(stored_at) AS stored_at FROM store GROUP BY 1)
SELECT key, strftime(stored_at + INTERVAL 30 DAYS, '%Y-%m-%d') AS expired_on FROM latest WHERE stored_at + INTERVAL 30 DAYS <= (SELECT max(stored_at) FROM store)""")
def stream_expiry(spark, sf):
    """Chunk ids stored again do not expire; the watermark follows the storage times."""
    from termwell.operators import catalog

    R.use_rocksdb(spark)
    made = catalog.make_chunks(frame(spark, sf, "listing"), F.col("stored_at"))
    stream = _stream(made.select(F.col("chunk_id").alias("key"), "stored_at"), "stored")
    expired = R.append_to_table(jobs.stream_expiry(stream), "expiry")
    return expired.select("key", F.date_format(F.timestamp_millis("expired_ms"), "yyyy-MM-dd").alias("expired_on"))


@query("stream_ingest", f"""{CHUNKS_SQL} SELECT chunk_id, section, ord, strftime(stored_at, '%Y-%m-%d') AS stored_on, 1::BIGINT AS indexed
FROM store QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY stored_at DESC, ord DESC) = 1""")
def stream_ingest(spark, sf):
    """Catalog rows arriving in three files: the store holds the latest version of a chunk, the index each chunk once."""
    from termwell.operators import catalog

    listing = _timestamps(frame(spark, sf, "listing"), "stored_at")
    path = run_dir(spark, "ingest")
    jobs.stream_ingest(_stream(listing, "listing", 3, "ord"), path)
    chunks = catalog.chunk_upsert(spark.read.parquet(f"{path}/chunks").drop("batch", "expires_at"))
    lengths = segments.documents(segments.open_index(spark, f"{path}/index")).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("indexed"))
    return chunks.join(lengths, "chunk_id", "left").select(
        "chunk_id", "section", "ord", F.date_format("stored_at", "yyyy-MM-dd").alias("stored_on"), "indexed")
