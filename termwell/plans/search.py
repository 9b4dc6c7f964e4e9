"""The listing search as one lazily composed plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termwell.functions import intent as I
from termwell.operators import ranking as K
from termwell.plans.tables import frame, wide_frame
from termwell.plans.text_queries import request_row


def offered_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Catalog rows fetched for each request."""
    return frame(spark, sf, "offers").join(frame(spark, sf, "listing"), "ord")


def request_params(spark: SparkSession, sf: str) -> DataFrame:
    """Effective settings of each request as a struct ``w``, with page and size."""
    requests = wide_frame(spark, sf, "requests").withColumn("signals", I.intent(F.col("query")))
    params = I.effective_params(request_row(), F.col("signals"))
    return requests.select(
        "query_id", "query", F.greatest("page", F.lit(1)).alias("page"), F.greatest("page_size", F.lit(1)).alias("page_size"),
        F.struct(*[value.alias(name) for name, value in params.items()]).alias("w"),
    )


def catalog_search(fetched: DataFrame, requests: DataFrame) -> DataFrame:
    """Filter, score, deduplicate, sort and page fetched rows for all requests.

    ``fetched(query_id, ord, position, relevance, …)`` holds the rows fetched per
    request in source order; ``requests`` is as made by ``request_params``. The
    page holds keys and scores, to be joined with whatever is shown.
    """
    fetched = fetched.select(
        "query_id", "ord", "position", "relevance", "confidence", "name", "org", "date", "date_sortable", "countries", "cost_usd", "difficulty"
    )
    sizes = fetched.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    asked = requests.join(sizes, "query_id")
    row = {c: F.col(c) for c in ("date", "date_sortable", "countries", "cost_usd", "difficulty", "score")}
    keep = K.passes_filters(row, F.col("w.year"), F.col("w.month"), F.col("w.countries"), F.col("w.free_only"))
    scored = fetched.join(asked, "query_id").filter(keep).withColumn(
        "score", K.hybrid_score(F.col("confidence"), F.col("relevance"), F.col("position"), F.col("n"))
    )
    keyed = scored.select(
        "query_id", "ord", "position", "name", "org", "score", "page", "page_size", F.col("w.sort_by").alias("sort_by"),
        K.sort_key(F.col("w.sort_by"), row).alias("key"),
    )
    unique = K.dedup_best(keyed, ["query_id"]).drop("name", "org")
    return K.paginate(unique, ["query_id"], ["key", "position"], F.col("page"), F.col("page_size"))


def search_catalog(spark: SparkSession, sf: str) -> DataFrame:
    from termwell.operators.scan import numbered

    placed = numbered(frame(spark, sf, "offers"), ["query_id"], ["ord"], "_at")
    fetched = placed.join(frame(spark, sf, "listing"), "ord").select(
        "*", (F.col("_at") - 1).alias("position"), F.col("score").alias("relevance")
    ).drop("_at")
    return catalog_search(fetched, request_params(spark, sf))
