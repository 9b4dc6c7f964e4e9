"""Payload parsing and the chunk store over catalog rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from termwell.operators import catalog
from termwell.operators.joins import sized_broadcast
from termwell.plans.registry import query
from termwell.plans.tables import AS_OF, frame, provided, wide_frame
from termwell.plans.text_queries import CHUNKS_SQL, LISTING, dashed_sql
from termwell.session import run_dir
from termwell.sources import frames, logs, payloads
from termwell.vocab.listing import CATEGORIES, DIFFICULTIES, REGIONS

FENCE = "```"
PAYLOAD_ROWS = 8

# Payload texts are made of eight catalog rows each; some have fences, some are
# no array, and some items lack a required field.
_FIELDS = [
    "name", "category", "region", "countries", "date", "deadline", "difficulty", "duration", "cost", "org",
    "subjects", "tags", "website", "description", "confidence", "cost_usd", "date_sortable",
]


def _payloads(spark, sf):
    rows = wide_frame(spark, sf, "listing").withColumns({
        "payload_id": F.floor(F.col("ord") / PAYLOAD_ROWS),
        "org": F.when(F.col("ord") % 13 != 4, F.col("org")),
        "confidence": F.when(F.col("ord") % 3 != 0, F.col("confidence")),
        "date_sortable": F.when(F.col("ord") % 4 == 0, F.lit("")).otherwise(F.col("date_sortable")),
    })
    item = F.to_json(F.struct(*_FIELDS))
    texts = rows.groupBy("payload_id").agg(F.sort_array(F.collect_list(F.struct("ord", item.alias("item")))).alias("items"))
    body = F.concat(F.lit("["), F.array_join(F.col("items.item"), ",\n"), F.lit("]"))
    raw = (
        F.when(F.col("payload_id") % 11 == 5, F.lit("Sorry, no data."))
        .when(F.col("payload_id") % 11 == 7, F.col("items")[0]["item"])
        .when(F.col("payload_id") % 3 == 0, F.concat(F.lit(f"{FENCE}json\n"), body, F.lit(f"\n{FENCE}")))
        .when(F.col("payload_id") % 3 == 1, F.concat(F.lit("  "), body, F.lit("\n")))
        .otherwise(body)
    )
    return texts.select("payload_id", raw.alias("raw"))


_PAYLOAD_SQL = f"""{LISTING}, items AS (SELECT ord // {PAYLOAD_ROWS} AS payload_id, ord % {PAYLOAD_ROWS} AS item_no, l.* REPLACE (
    CASE WHEN ord % 13 <> 4 THEN org END AS org, CASE WHEN ord % 3 <> 0 THEN confidence END AS confidence,
    CASE WHEN ord % 4 = 0 THEN '' ELSE date_sortable END AS date_sortable)
  FROM listing l WHERE (ord // {PAYLOAD_ROWS}) % 11 NOT IN (5, 7))"""
_ID_SQL = f"""substr({dashed_sql("name || '-' || org")}, 1, 40) || '-' || substr(sha1(lower(name || '-' || org)), 1, 6)"""


@query("payload_parse", f"{_PAYLOAD_SQL} SELECT payload_id, CAST(item_no AS INT) AS item_no, name, org, array_to_string(tags, ' ') AS tags, website FROM items")
def payload_parse(spark, sf):
    parsed = payloads.payload_parse(_payloads(spark, sf))
    return parsed.select("payload_id", "item_no", "name", "org", F.array_join("tags", " ").alias("tags"), "website")


@query("payload_rejected", f"{LISTING} SELECT DISTINCT ord // {PAYLOAD_ROWS} AS payload_id FROM listing WHERE (ord // {PAYLOAD_ROWS}) % 11 IN (5, 7)")
def payload_rejected(spark, sf):
    return payloads.rejected_payloads(_payloads(spark, sf))


@query("payload_rows", f"{_PAYLOAD_SQL} SELECT payload_id, CAST(item_no AS INT) AS item_no, {_ID_SQL} AS id FROM items WHERE org IS NOT NULL")
def payload_rows(spark, sf):
    return payloads.payload_rows(payloads.payload_parse(_payloads(spark, sf))).select("payload_id", "item_no", "id")


@query("payload_skipped", f"{_PAYLOAD_SQL} SELECT payload_id, count(*) AS skipped FROM items WHERE org IS NULL GROUP BY payload_id")
def payload_skipped(spark, sf):
    skipped = payloads.skipped_rows(payloads.payload_parse(_payloads(spark, sf)))
    return skipped.groupBy("payload_id").agg(F.count(F.lit(1)).alias("skipped"))


@query("payload_enriched", f"""{_PAYLOAD_SQL} SELECT payload_id, CAST(item_no AS INT) AS item_no, coalesce(confidence, 0.8::DOUBLE) AS confidence, cost_usd,
  nullif(date_sortable, '') AS date_sortable FROM items WHERE org IS NOT NULL""")
def payload_enriched(spark, sf):
    rows = payloads.payload_enriched(payloads.payload_parse(_payloads(spark, sf)))
    return rows.select("payload_id", "item_no", "confidence", "cost_usd", "date_sortable")


UPSERT_SQL = f"""{CHUNKS_SQL}, latest AS (
  SELECT * FROM store QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY stored_at DESC, ord DESC) = 1)"""
_NAME_SLUG = f"substr({dashed_sql('name')}, 1, 50)"


def _store(spark, sf):
    return catalog.chunk_upsert(catalog.make_chunks(wide_frame(spark, sf, "listing"), F.col("stored_at")))


@query("chunk_upsert", f"{UPSERT_SQL} SELECT chunk_id, ord, section, strftime(stored_at + INTERVAL 30 DAYS, '%Y-%m-%d') AS expires_on FROM latest")
def chunk_upsert(spark, sf):
    return _store(spark, sf).select("chunk_id", "ord", "section", F.date_format("expires_at", "yyyy-MM-dd").alias("expires_on"))


@query("chunks_for_exam", f"""{UPSERT_SQL} SELECT chunk_id, {_NAME_SLUG} AS slug FROM latest
WHERE {_NAME_SLUG} IN (SELECT {dashed_sql("upper(p_name) || '!'")} FROM part WHERE p_size = 7)""")
def chunks_for_exam(spark, sf):
    names = provided(spark, sf, "part").filter("p_size = 7").select(F.concat(F.upper("p_name"), F.lit("!")).alias("name"))
    return catalog.chunks_for_exam(_slugged_store(spark, sf), names).select("chunk_id", "slug")


def _slugged_store(spark: SparkSession, sf: str) -> DataFrame:
    """The store written by slug and opened again."""
    path = run_dir(spark, "store")
    catalog.write_store(_store(spark, sf), path)
    return catalog.open_store(spark, path)


@query("chunk_scan", f"{UPSERT_SQL} SELECT chunk_id FROM latest WHERE stored_at + INTERVAL 30 DAYS > TIMESTAMP '{AS_OF}'")
def chunk_scan(spark, sf):
    """The store is written by section and read back without expired chunks."""
    path = run_dir(spark, "chunks")
    catalog.write_chunks(_store(spark, sf), path)
    stored = spark.read.parquet(path)
    return catalog.chunk_scan(stored, F.lit(AS_OF).cast("timestamp")).select("chunk_id")


_STALE = f"""stale AS (SELECT slug, date_sortable FROM (
  SELECT {_NAME_SLUG} AS slug, is_year_round, date_sortable, row_number() OVER (
    PARTITION BY {_NAME_SLUG} ORDER BY section <> 'overview', chunk_id) AS n FROM latest)
  WHERE n = 1 AND NOT is_year_round AND date_sortable < '2025-09')"""


def _stale(spark, sf):
    return catalog.stale_exams(_store(spark, sf), F.lit("2025-09"))


@query("stale_exams", f"{UPSERT_SQL}, {_STALE} SELECT * FROM stale")
def stale_exams(spark, sf):
    return _stale(spark, sf)


@query("evict_exams", f"{UPSERT_SQL}, {_STALE} SELECT chunk_id FROM latest WHERE {_NAME_SLUG} NOT IN (SELECT slug FROM stale)")
def evict_exams(spark, sf):
    store = _slugged_store(spark, sf)
    return catalog.evict_exams(store, catalog.stale_exams(store, F.lit("2025-09"))).select("chunk_id")


@query("evict_vectors", """WITH kept AS (SELECT doc_id FROM documents WHERE lang <> 'en')
SELECT vec_id AS chunk_id, label FROM embeddings WHERE vec_id IN (SELECT doc_id FROM kept)""")
def evict_vectors(spark, sf):
    kept = frame(spark, sf, "chunks").filter("region <> 'en'")
    vectors = provided(spark, sf, "embeddings").withColumnRenamed("vec_id", "chunk_id")
    return catalog.evict_vectors(vectors, kept).select("chunk_id", "label")


@query("exam_known", f"""{UPSERT_SQL}, asked AS (SELECT s_name AS name FROM supplier UNION ALL SELECT p_name FROM part)
SELECT name, {_NAME_SLUG} AS slug, {_NAME_SLUG} IN (SELECT {_NAME_SLUG} FROM latest) AS known FROM asked""")
def exam_known(spark, sf):
    asked = provided(spark, sf, "supplier").select(F.col("s_name").alias("name")).union(provided(spark, sf, "part").select("p_name"))
    return catalog.exam_known(asked, _store(spark, sf))


@query("known_exam_count", f"{UPSERT_SQL} SELECT count(DISTINCT {_NAME_SLUG}) AS known_exams FROM latest")
def known_exam_count(spark, sf):
    return catalog.known_exam_count(_store(spark, sf))


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


@query("facets", f"""{LISTING} SELECT 'region' AS facet, region AS value, region IN {_in(REGIONS)} AS declared, count(*) AS rows FROM listing GROUP BY 2
UNION ALL SELECT 'category', category, category IN {_in(CATEGORIES)}, count(*) FROM listing GROUP BY 2
UNION ALL SELECT 'difficulty', difficulty, difficulty IN {_in(DIFFICULTIES)}, count(*) FROM listing GROUP BY 2""")
def facets(spark, sf):
    return catalog.facets(wide_frame(spark, sf, "listing"))


@query("region_vocabulary", """SELECT r_name AS region, count(*) AS customers, count(DISTINCT n_nationkey) AS nations,
  initcap_like AS declared_name FROM (
  SELECT r_name, n_nationkey, CASE r_name WHEN 'AFRICA' THEN 'Africa' WHEN 'ASIA' THEN 'Asia' WHEN 'EUROPE' THEN 'Europe' END AS initcap_like
  FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey) GROUP BY r_name, initcap_like""")
def region_vocabulary(spark, sf):
    """Customers per region, with the vocabulary entry the region name matches."""
    nations = sized_broadcast(provided(spark, sf, "nation"))
    regions = sized_broadcast(provided(spark, sf, "region"))
    placed = (
        provided(spark, sf, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    name = F.initcap(F.lower("r_name"))
    return placed.groupBy(F.col("r_name").alias("region"), F.when(name.isin(REGIONS), name).alias("declared_name")).agg(
        F.count(F.lit(1)).alias("customers"), F.countDistinct("n_nationkey").alias("nations")
    )


@query("log_ingest", """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, CASE event_type WHEN 'error' THEN 'ERROR' ELSE 'INFO' END AS level,
  'call ' || event_id AS msg, CASE WHEN event_id % 3 = 0 THEN 'ctx-' || user_id ELSE 'req-' || event_id END AS request_id,
  event_type AS agent, CAST(value AS VARCHAR) AS duration_ms, CASE WHEN event_type = 'error' THEN 'TimeoutError' END AS error
FROM events WHERE event_id % 10 <> 9""")
def log_ingest(spark, sf):
    """Events written as JSON log lines, a tenth of them cut off, and read back."""
    events = provided(spark, sf, "events")
    context = F.create_map(
        F.lit("request_id"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("ctx-"), "user_id")).otherwise(F.lit("")),
    )
    line = F.to_json(F.struct(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"),
        F.when(F.col("event_type") == "error", F.lit("ERROR")).otherwise(F.lit("INFO")).alias("level"),
        F.lit("app.search").alias("logger"), F.concat(F.lit("call "), "event_id").alias("msg"),
        F.concat(F.lit("req-"), "event_id").alias("request_id"), F.col("event_type").alias("agent"),
        F.col("value").alias("duration_ms"), F.lit("dropped").alias("unknown_extra"),
        F.when(F.col("event_type") == "error", F.lit("TimeoutError")).alias("exception"), context.alias("context"),
    ))
    cut = F.when(F.col("event_id") % 10 == 9, F.substring(line, 1, 30)).otherwise(line)
    path = run_dir(spark, "logs")
    events.select(cut.alias("value")).write.text(path)
    records = logs.log_ingest(logs.read_log_lines(spark, path))
    return records.select(
        F.substring("msg", 6, 20).cast("long").alias("event_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"),
        "level", "msg", "request_id", "agent", "duration_ms", "error",
    )


@query("event_frames", "SELECT event_id, event_type AS event, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id % 6 <> 1")
def event_frames(spark, sf):
    """Events written as server-sent frames, a sixth of them malformed, and read back."""
    data = F.concat(F.lit('{"event_id": '), "event_id", F.lit(', "props": '), "props", F.lit("}"))
    broken = F.when(F.col("event_id") % 6 == 1, F.concat(data, F.lit(" oops {"))).otherwise(data)
    text = F.concat(F.lit("event: "), "event_type", F.lit("\ndata: "), broken, F.lit("\n"))
    path = run_dir(spark, "frames")
    provided(spark, sf, "events").select(text.alias("value")).write.text(path)
    parsed = frames.event_frames(frames.read_frames(spark, path))
    return parsed.select(
        F.get_json_object("data", "$.event_id").cast("long").alias("event_id"), "event",
        F.get_json_object("data", "$.props.k").cast("long").alias("k"),
    )
