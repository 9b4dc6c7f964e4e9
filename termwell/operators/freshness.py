"""Staleness of chunks, coverage of hits and the source each query is served from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termwell.vocab.listing import STALE_AFTER_DAYS

COVERAGE_NORM = 0.55
COVERAGE_HITS = 3
NAMED_HIT_NORM = 0.7


def stale(date_sortable: Column, stored_at: Column, is_year_round: Column, as_of: Column,
          days: int = STALE_AFTER_DAYS) -> Column:
    """True for a past date kept for at least ``days``; year-round rows never go stale.

    Dates compare as texts. A missing storage time counts as old.
    """
    past = (F.coalesce(date_sortable, F.lit("")) != "") & (date_sortable < F.date_format(as_of, "yyyy-MM"))
    age = F.timestamp_diff("DAY", stored_at, as_of)
    old = stored_at.isNull() | (age >= days)
    return F.coalesce(~is_year_round & past & old, F.lit(False))


def with_stale_flag(chunks: DataFrame, as_of: Column) -> DataFrame:
    return chunks.withColumn(
        "stale", stale(F.col("date_sortable"), F.col("stored_at"), F.col("is_year_round"), as_of)
    )


def fresh_hits(hits: DataFrame, chunks: DataFrame, as_of: Column) -> DataFrame:
    """Hits whose chunk is not stale."""
    flags = with_stale_flag(chunks, as_of).select("chunk_id", "stale")
    return hits.join(flags, "chunk_id").filter(~F.col("stale")).drop("stale")


def stale_hits_per_query(hits: DataFrame, chunks: DataFrame, as_of: Column) -> DataFrame:
    flags = with_stale_flag(chunks, as_of).select("chunk_id", "stale")
    return hits.join(flags, "chunk_id").groupBy("query_id").agg(
        F.count(F.lit(1)).alias("hits"), F.count_if("stale").alias("stale_hits")
    )


def coverage(hits: DataFrame) -> DataFrame:
    """Per query: hits, good hits, top score, and whether the index alone suffices."""
    good = F.count_if(F.col("norm_score") >= COVERAGE_NORM)
    return hits.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("hits"),
        good.alias("good_hits"),
        F.min_by("norm_score", "rank").alias("top_score"),
        (good >= COVERAGE_HITS).alias("is_sufficient"),
    )


def tier_route(queries: DataFrame, covered: DataFrame, fetched: DataFrame, index_source: str = "bm25") -> DataFrame:
    """The source that serves each query.

    Queries the index covers stay with it. The others take externally fetched
    rows ``(query_id, …)`` if there are any, else the partial index result.
    """
    rows = fetched.groupBy("query_id").agg(F.count(F.lit(1)).alias("fetched_rows"))
    sufficient = F.coalesce("is_sufficient", F.lit(False))
    external = ~sufficient & (F.coalesce("fetched_rows", F.lit(0)) > 0)
    return (
        queries.select("query_id")
        .join(covered.select("query_id", "is_sufficient", "top_score"), "query_id", "left")
        .join(rows, "query_id", "left")
        .select(
            "query_id",
            F.when(sufficient, F.lit(index_source)).when(external, F.lit("llm")).otherwise(F.lit("bm25")).alias("source"),
            (sufficient | external).alias("is_sufficient"),
            (~sufficient).alias("needs_fetch"),
            F.coalesce("top_score", F.lit(0.0)).alias("top_score"),
        )
    )


def enrichment_source(names: DataFrame, store: DataFrame, index_chunks: DataFrame, hits: DataFrame,
                      as_of: Column) -> DataFrame:
    """Where the context of each ``(name)`` comes from.

    First the stored chunks of the name, unless one is stale. Then indexed
    chunks of exactly that name, or search ``hits(name, chunk_id, norm_score)``
    with the same name or a high score; at least two and none stale. Else the
    name has to be fetched.
    """
    wanted = names.select("name", F.lower("name").alias("_key")).distinct()

    def summary(chunks: DataFrame) -> DataFrame:
        return chunks.groupBy("_key").agg(
            F.count(F.lit(1)).alias("n"), F.bool_or("stale").alias("any_stale")
        )

    stored = summary(
        with_stale_flag(store, as_of).select(F.lower("name").alias("_key"), "stale")
        .join(wanted.select("_key").distinct(), "_key", "left_semi")
    ).withColumnsRenamed({"n": "stored_n", "any_stale": "stored_stale"})
    flagged = with_stale_flag(index_chunks, as_of).select("chunk_id", F.lower("name").alias("_own"), "stale")
    exact = summary(
        flagged.withColumnRenamed("_own", "_key").join(wanted.select("_key").distinct(), "_key", "left_semi")
    ).withColumnsRenamed({"n": "exact_n", "any_stale": "exact_stale"})
    near = summary(
        hits.select(F.lower("name").alias("_key"), "chunk_id", "norm_score").join(flagged, "chunk_id")
        .filter((F.col("_own") == F.col("_key")) | (F.col("norm_score") >= NAMED_HIT_NORM))
    ).withColumnsRenamed({"n": "near_n", "any_stale": "near_stale"})
    found = (
        wanted.join(stored, "_key", "left").join(exact, "_key", "left").join(near, "_key", "left")
        .select(
            "name",
            F.coalesce("stored_n", F.lit(0)).alias("stored_n"),
            F.coalesce("stored_stale", F.lit(False)).alias("stored_stale"),
            F.coalesce("exact_n", "near_n", F.lit(0)).alias("index_n"),
            F.when(F.col("exact_n").isNotNull(), F.col("exact_stale"))
            .otherwise(F.coalesce("near_stale", F.lit(False))).alias("index_stale"),
        )
    )
    from_store = (F.col("stored_n") > 0) & ~F.col("stored_stale")
    from_index = (F.col("index_n") >= 2) & ~F.col("index_stale")
    return found.select(
        "name",
        F.when(from_store, F.lit("store")).when(from_index, F.lit("bm25")).otherwise(F.lit("fetch")).alias("source"),
        F.when(from_store, F.col("stored_n") >= 2).otherwise(from_index).alias("is_sufficient"),
        F.when(from_store, F.col("stored_n")).when(from_index, F.col("index_n")).otherwise(0).alias("n_chunks"),
    )
