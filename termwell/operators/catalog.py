"""The chunk store as plain tables: building, upserting, expiring and evicting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termwell.functions import text as T
from termwell.operators.joins import at_most, lookup_join, sized_broadcast
from termwell.operators.layout import read_bucketed, write_bucketed
from termwell.vocab.listing import CHUNK_TTL_DAYS, DIFFICULTIES, REGIONS, CATEGORIES

STORE_BUCKETS = 32
LOOKUP_NAMES = 200

LISTING_COLUMNS = [
    "name", "org", "category", "region", "countries", "date", "deadline", "difficulty",
    "duration", "cost", "subjects", "tags", "website", "description",
]


def listing_columns() -> dict[str, Column]:
    return {column: F.col(column) for column in LISTING_COLUMNS}


def make_chunks(listing: DataFrame, stored_at: Column) -> DataFrame:
    """Three chunks per listing row: overview, subjects and deadline alerts."""
    row = listing_columns()
    base = T.slug(row["name"], row["org"])
    date_tags = F.concat(F.slice(row["tags"], 1, 4), T.months_in(row["date"]), T.years_in(row["date"]))
    short_tags = F.slice(row["tags"], 1, 8)

    def section(name: str, tags: Column, text: Column) -> Column:
        return F.struct(
            F.concat(base, F.lit(f"-{name}")).alias("chunk_id"),
            F.lit(name).alias("section"), tags.alias("tags"), text.alias("text"),
        )

    sections = F.array(
        section("overview", short_tags, T.overview_text(row)),
        section("subjects", short_tags, T.subjects_text(row)),
        section("deadline-alerts", F.slice(date_tags, 1, 12), T.deadline_text(row)),
    )
    return listing.select(
        *[c for c in ("ord",) if c in listing.columns],
        "name", "org", "region", "category", F.col("date").alias("exam_date"),
        T.date_sortable(F.col("date")).alias("date_sortable"),
        stored_at.cast("timestamp").alias("stored_at"),
        T.is_year_round(F.col("date")).alias("is_year_round"),
        F.inline(sections),
    )


def chunk_upsert(stored: DataFrame, new: DataFrame | None = None, order: str = "ord") -> DataFrame:
    """The latest version of every chunk id, with its expiry time."""
    rows = stored if new is None else stored.unionByName(new)
    rest = [c for c in rows.columns if c not in ("chunk_id", "expires_at")]
    latest = rows.groupBy("chunk_id").agg(
        F.max_by(F.struct(*rest), F.struct("stored_at", order)).alias("_row")
    )
    return latest.select("chunk_id", *[F.col(f"_row.{c}").alias(c) for c in rest]).withColumn(
        "expires_at", F.col("stored_at") + F.expr(f"INTERVAL {CHUNK_TTL_DAYS} DAYS")
    )


def write_store(chunks: DataFrame, path: str, buckets: int = STORE_BUCKETS) -> DataFrame:
    """Store chunks with their slug, bucketed and sorted by it, and return the store."""
    return write_bucketed(chunks.withColumn("slug", T.slug(F.col("name"))), path, "slug", buckets)


def open_store(spark: SparkSession, path: str, buckets: int = STORE_BUCKETS) -> DataFrame:
    """A store written before, with its ``slug`` column."""
    return read_bucketed(spark, path, "slug", buckets)


def _with_slug(chunks: DataFrame) -> DataFrame:
    return chunks if "slug" in chunks.columns else chunks.withColumn("slug", T.slug(F.col("name")))


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Store chunks by section, so scans of one section read only its files."""
    chunks.write.mode("overwrite").partitionBy("section").parquet(path)


def chunks_for_exam(chunks: DataFrame, names: DataFrame) -> DataFrame:
    """All chunks of the ``(name)`` rows, matched by slug.

    Of a store, few names read only their buckets; more are sent to the buckets, where nothing stored moves.
    """
    wanted = names.select(T.slug(F.col("name")).alias("slug")).distinct()
    if "slug" in chunks.columns and at_most(wanted, LOOKUP_NAMES):
        return chunks.filter(F.col("slug").isin([r["slug"] for r in wanted.collect()]))
    return _with_slug(chunks).join(sized_broadcast(wanted), "slug", "left_semi")


def chunk_scan(chunks: DataFrame, as_of: Column) -> DataFrame:
    """Chunks that have not expired."""
    return chunks.filter(F.col("expires_at") > as_of)


def stale_exams(chunks: DataFrame, before_ym: Column) -> DataFrame:
    """Slugs whose overview chunk (else the first chunk) has a past date."""
    order = F.struct((F.col("section") != "overview").alias("other"), F.col("chunk_id"))
    leading = _with_slug(chunks).groupBy("slug").agg(
        F.min_by(F.struct("is_year_round", "date_sortable"), order).alias("lead")
    )
    return leading.filter(
        ~F.col("lead.is_year_round") & (F.col("lead.date_sortable") < before_ym)
    ).select("slug", F.col("lead.date_sortable").alias("date_sortable"))


def evict_exams(chunks: DataFrame, slugs: DataFrame) -> DataFrame:
    """Chunks left after dropping the given slugs."""
    gone = sized_broadcast(slugs.select("slug").distinct())
    return _with_slug(chunks).join(gone, "slug", "left_anti").drop("slug")


def evict_vectors(vectors: DataFrame, kept_chunks: DataFrame) -> DataFrame:
    """Vectors whose chunk is still stored."""
    return vectors.join(kept_chunks.select("chunk_id"), "chunk_id", "left_semi")


def exam_known(names: DataFrame, chunks: DataFrame) -> DataFrame:
    """Flag each ``(name)`` row that has stored chunks."""
    known = _with_slug(chunks).select("slug").distinct().withColumn("_known", F.lit(True))
    asked = names.withColumn("slug", T.slug(F.col("name")))
    return lookup_join(asked, known, ["slug"]).select(
        *names.columns, "slug", F.coalesce("_known", F.lit(False)).alias("known")
    )


def known_exam_count(chunks: DataFrame, approximate: bool = False) -> DataFrame:
    key = T.slug(F.col("name"))
    counted = F.approx_count_distinct(key) if approximate else F.countDistinct(key)
    return chunks.agg(counted.alias("known_exams"))


def facets(listing: DataFrame) -> DataFrame:
    """Values of each filter in use and whether the vocabulary declares them."""
    declared = {"region": REGIONS, "category": CATEGORIES, "difficulty": DIFFICULTIES}
    pairs = F.inline(F.array(*[
        F.struct(F.lit(facet).alias("facet"), F.col(facet).alias("value"),
                 F.col(facet).isin(values).alias("declared"))
        for facet, values in declared.items()
    ]))
    return listing.select(pairs).groupBy("facet", "value", "declared").agg(F.count(F.lit(1)).alias("rows"))
