"""Deduplication, score blending, filters, sorts and pages of result rows.

Rows carry an ``ord`` column with their source order; "first" always means the
lowest ``ord``. Winners of a group are found by aggregation, which combines
inside each partition, so a key of any share costs one row per partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termwell.functions.numbers import rounded
from termwell.functions.text import fingerprint, is_year_round, text_or_empty
from termwell.operators.scan import numbered
from termwell.vocab.listing import DIFFICULTIES

# Fixed values of the score blend and the listing rules.
CONFIDENCE_WEIGHT, TEXT_WEIGHT, POSITION_WEIGHT = 0.55, 0.30, 0.15
POSITION_DROP = 0.9
RERANK_TOP = 12
RERANK_ABOVE = 8
STRONG_MATCH, PARTIAL_MATCH = 0.4, 0.15
UNDATED_KEY = "9999-99"
UNPRICED_KEY = 9999999.0
MAX_PAGE_SIZE = 50


def shard_union(shards: Sequence[DataFrame]) -> DataFrame:
    """All shard outputs as one table with the number of the shard."""
    combined = None
    for number, shard in enumerate(shards):
        part = shard.withColumn("shard_no", F.lit(number))
        combined = part if combined is None else combined.unionByName(part)
    return combined


def shard_counts(rows: DataFrame) -> DataFrame:
    """Row count per shard, and over all shards where ``shard_no`` is null."""
    return rows.rollup("shard_no").agg(F.count(F.lit(1)).alias("rows"))


def _with_fingerprint(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_fp", fingerprint(F.col("name"), F.col("org")))


def dedup_first(rows: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """The first row per name and organiser, with the categories of all its copies.

    ``source_shards`` lists each category once, by first appearance, with its
    count; categories come from a closed vocabulary, so the list stays short.
    """
    keys = [*within, "_fp"]
    marked = _with_fingerprint(rows)
    kept = [c for c in rows.columns if c not in within]
    first = marked.groupBy(*keys).agg(
        F.min_by(F.struct(*kept), F.col("ord")).alias("_row"), F.count(F.lit(1)).alias("copies")
    )
    shards = (
        marked.groupBy(*keys, "category").agg(F.min("ord").alias("_at"), F.count(F.lit(1)).alias("_n"))
        .groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_at", "category", "_n"))).alias("_shards"))
    )
    named = F.transform("_shards", lambda s: F.struct(s["category"].alias("category"), s["_n"].alias("n")))
    return first.join(shards, keys).select(
        *within, *[F.col(f"_row.{c}").alias(c) for c in kept], "copies", named.alias("source_shards")
    )


def dedup_best(rows: DataFrame, within: Sequence[str] = (), score: str = "score") -> DataFrame:
    """The row with the highest score per name and organiser; the first one on ties."""
    keys = [*within, "_fp"]
    kept = [c for c in rows.columns if c not in within]
    best = _with_fingerprint(rows).groupBy(*keys).agg(
        F.max_by(F.struct(*kept), F.struct(F.col(score), -F.col("ord"))).alias("_row")
    )
    return best.select(*within, *[F.col(f"_row.{c}").alias(c) for c in kept])


def presort(rows: DataFrame, within: Sequence[str] = (), score: str = "relevance") -> DataFrame:
    """Add the 0-based position by falling score; ties keep their order."""
    ranked = numbered(rows, within, [F.desc(score), F.asc("ord")], "_at")
    return ranked.withColumn("position", F.col("_at") - 1).drop("_at")


def rerank_merge(ranked: DataFrame, picks: DataFrame) -> DataFrame:
    """Apply an externally chosen order to the top of each ranking.

    ``ranked(query_id, position, …)`` with 0-based positions;
    ``picks(query_id, pick_no, position)`` names positions in chosen order. Only
    rankings of more than eight rows change, and there only the top twelve:
    chosen positions first (each once, those out of range ignored), then the
    others. ``rank_source`` tells whether picks were used.
    """
    sizes = ranked.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"))
    valid = (
        picks.join(sizes, "query_id")
        .filter((F.col("_n") > RERANK_ABOVE) & (F.col("position") >= 0)
                & (F.col("position") < F.least(F.col("_n"), F.lit(RERANK_TOP))))
        .groupBy("query_id", "position").agg(F.min("pick_no").alias("_pick"))
    )
    used = valid.select("query_id").distinct().withColumn("_used", F.lit(True))
    order = W.partitionBy("query_id").orderBy(F.asc_nulls_last("_pick"), "position")
    top = (
        ranked.filter(F.col("position") < RERANK_TOP)
        .join(valid, ["query_id", "position"], "left")
        .withColumn("new_position", (F.row_number().over(order) - 1).cast("long"))
        .drop("_pick")
    )
    rest = ranked.filter(F.col("position") >= RERANK_TOP).withColumn("new_position", F.col("position").cast("long"))
    source = F.when(F.col("_used"), F.lit("bm25+llm")).otherwise(F.lit("bm25"))
    return (
        top.unionByName(rest).join(used, "query_id", "left")
        .withColumn("rank_source", source).drop("_used")
    )


def falling_score(position: Column, total: Column) -> Column:
    """From 1 at position 0, falling by 0.9 over the whole list."""
    return F.lit(1.0) - position / total * POSITION_DROP


def position_score(rows: DataFrame, within: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Add ``position`` (0-based) and ``final_score`` for a ranking of any length."""
    ranked = numbered(rows, within, order, "_at", totals=True)
    position = F.col("_at") - 1
    return ranked.select(
        *rows.columns, position.alias("position"),
        rounded(falling_score(position, F.col("_at_total"))).alias("final_score"),
    )


def hybrid_score(confidence: Column, relevance: Column, position: Column, total: Column) -> Column:
    """Blend of source confidence, text relevance and list position, within 0 and 1."""
    place = F.when(total > 1, falling_score(position, total)).otherwise(1.0)
    raw = CONFIDENCE_WEIGHT * confidence + TEXT_WEIGHT * relevance + POSITION_WEIGHT * place
    return rounded(F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)))


def passes_filters(row: dict[str, Column], year: Column, month: Column, countries: Column,
                   free_only: Column) -> Column:
    """The constraints of a search on one listing row.

    An unknown cost fails ``free_only``; an unknown date passes ``year``.
    """
    free = ~free_only | F.coalesce(row["cost_usd"] <= 0, F.lit(False))
    date = F.lower(text_or_empty(row["date"]))
    in_month = (
        (text_or_empty(month) == "") | is_year_round(row["date"])
        | F.contains(date, F.substring(F.lower(month), 1, 3))
    )
    dated = F.coalesce(row["date_sortable"], F.lit(""))
    in_year = (F.coalesce(year, F.lit(0)) == 0) | (dated == "") | F.startswith(dated, year.cast("string"))
    offered = F.transform(row["countries"], F.lower)
    in_countries = (F.size(countries) <= 0) | F.arrays_overlap(offered, F.transform(countries, F.lower))
    return F.coalesce(free & in_month & in_year & in_countries, F.lit(False))


def difficulty_level(difficulty: Column) -> Column:
    """Ordinal of a difficulty; 0 if it is unknown."""
    return F.array_position(F.array(*[F.lit(d) for d in DIFFICULTIES]), text_or_empty(difficulty)).cast("int")


def sort_key(mode: Column, row: dict[str, Column]) -> Column:
    """Ascending sort key of a row under a sort mode."""
    number = (
        F.when(mode == "deadline", F.lit(0.0))
        .when(mode == "cost_asc", F.coalesce(row["cost_usd"], F.lit(UNPRICED_KEY)))
        .when(mode == "difficulty", -difficulty_level(row["difficulty"]).cast("double"))
        .otherwise(-row["score"])
    )
    text = F.when(
        mode == "deadline", F.coalesce(F.nullif(row["date_sortable"], F.lit("")), F.lit(UNDATED_KEY))
    ).otherwise("")
    return F.struct(number.alias("number"), text.alias("text"))


def match_reasons(row: dict[str, Column], query: Column, relevance: Column, sort_by: Column, asked: Column | None = None) -> Column:
    """Why a row was returned, as texts.

    ``asked`` is the query in lower case, for callers that have it once for many rows; else every word looked for lowers the query again.
    """
    asked = F.lower(query) if asked is None else asked

    def asked_for(values: Column) -> Column:
        return F.exists(values, lambda value: F.contains(asked, value))

    shown = rounded(relevance, 2).cast("string")
    reasons = F.array_compact(F.array(
        F.when(
            F.contains(asked, F.lower(row["region"])) | asked_for(F.transform(row["countries"], F.lower)),
            F.concat(F.lit("Geographic match: "), row["region"]),
        ),
        F.when(
            F.contains(asked, F.lower(row["category"])) | asked_for(row["tags"]),
            F.concat(F.lit("Category: "), row["category"]),
        ),
        F.when(relevance >= STRONG_MATCH, F.concat(F.lit("Strong BM25 corpus match ("), shown, F.lit(")")))
        .when(relevance >= PARTIAL_MATCH, F.concat(F.lit("Partial corpus match ("), shown, F.lit(")"))),
        F.when(sort_by == "deadline", F.lit("Sorted by upcoming deadline")),
        F.when(sort_by == "cost_asc", F.lit("Sorted by cost (lowest first)")),
    ))
    fallback = F.array(F.concat(F.lit("Relevance match for: "), F.substring(query, 1, 50)))
    return F.when(F.size(reasons) > 0, reasons).otherwise(fallback)


def paginate(rows: DataFrame, within: Sequence[str], order: Sequence[Column],
             page: Column, page_size: Column) -> DataFrame:
    """One page per query with the row number and the total number of rows.

    The order must be unique within a query. Rows are numbered in slices, so a
    query may have any number of results; pass the columns the page needs only.
    """
    ranked = numbered(rows, within, order, "row_no", totals=True).withColumnRenamed("row_no_total", "total")
    return ranked.filter((F.col("row_no") > (page - 1) * page_size) & (F.col("row_no") <= page * page_size))


def one_page(rows: DataFrame, order: Sequence[Column], page: int, page_size: int) -> DataFrame:
    """One page of a single result list."""
    return rows.orderBy(*order).offset((page - 1) * page_size).limit(page_size)


def head_limit(rows: DataFrame, order: Sequence[Column], limit: int) -> DataFrame:
    return rows.orderBy(*order).limit(min(max(limit, 1), MAX_PAGE_SIZE))


def enrich_select(ranked: DataFrame, top_n: Column, order: Sequence[Column]) -> DataFrame:
    """The best ``top_n`` rows of each query; ``top_n`` is a column of the row.

    The largest ``top_n`` is read first, so that each task passes on no more rows of a query.
    """
    most = ranked.agg(F.max(top_n)).first()[0] or 0
    at = F.row_number().over(W.partitionBy("query_id").orderBy(*order))
    return ranked.withColumn("rank", at).filter((F.col("rank") <= int(most)) & (F.col("rank") <= top_n))


def enrich_merge(rows: DataFrame, enriched: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Rows with the given columns replaced where there is an enriched version."""
    new = enriched.select(key, F.lit(True).alias("_new"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    return rows.join(new, key, "left").select(*[
        F.when(F.col("_new"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
        for c in rows.columns
    ])


def ui_filter(row: dict[str, Column], region: Column, difficulty: Column, year: Column, month: Column) -> Column:
    """Filters of the result view; "All" and "Any …" switch one off."""
    date = text_or_empty(row["date"])
    dates = F.concat(date, F.lit(" "), text_or_empty(row["deadline"]))
    year_round = date.rlike("(?i)year.?round")
    return (
        ((region == "All") | row["region"].isin("Global") | (row["region"] == region))
        & ((difficulty == "All") | (row["difficulty"] == difficulty))
        & ((year == "Any year") | year_round | F.contains(dates, year))
        & ((month == "Any month") | year_round | F.contains(F.lower(date), F.lower(F.substring(month, 1, 3))))
    )


def result_projection(ranked: DataFrame) -> DataFrame:
    """Ranked rows as result rows: the final score, with shard categories as reasons."""
    return ranked.withColumnsRenamed({"final_score": "relevance_score", "source_shards": "match_reasons"})
