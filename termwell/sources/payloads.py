"""JSON text payloads as typed listing rows and search shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termwell.functions.text import stable_id
from termwell.schemas import LISTING_ITEM, PLAN_PAYLOAD, REQUIRED_FIELDS

DEFAULT_CONFIDENCE = 0.8


def unfenced(raw: Column) -> Column:
    """Payload text without code fences around it."""
    opened = F.regexp_replace(raw, r"(?m)^```(?:json)?\s*", "")
    return F.trim(F.regexp_replace(F.regexp_replace(opened, r"(?m)\s*```$", ""), r"^\s+|\s+$", ""))


def payload_items(payloads: DataFrame) -> DataFrame:
    """Items of the top-level JSON array of each ``(payload_id, raw)``.

    The items are split as texts first, so one malformed item does not take the
    others with it. Anything but an array yields a single null item. The text is
    parsed inside brackets, as the parser ignores whatever follows a complete value.
    """
    body = unfenced(F.col("raw"))
    enclosed = F.from_json(F.concat(F.lit("["), body, F.lit("]")), "array<array<string>>")
    parsed = F.when(F.startswith(body, F.lit("[")) & (F.size(enclosed) == 1), enclosed[0])
    return payloads.select("payload_id", F.posexplode_outer(parsed).alias("item_no", "item"))


def payload_parse(payloads: DataFrame) -> DataFrame:
    """One row per JSON object item, with the listing fields."""
    objects = payload_items(payloads).filter(F.startswith(F.ltrim("item"), F.lit("{")))
    return objects.select(
        "payload_id", "item_no", F.from_json("item", LISTING_ITEM).alias("_f")
    ).select("payload_id", "item_no", "_f.*")


def rejected_payloads(payloads: DataFrame) -> DataFrame:
    """Payloads without any item: not an array, invalid JSON, or an empty array."""
    return payload_items(payloads).filter(F.col("item").isNull() & F.col("item_no").isNull()).select("payload_id")


def _complete() -> Column:
    complete = F.lit(True)
    for field in REQUIRED_FIELDS:
        complete = complete & F.col(field).isNotNull()
    return complete


def payload_rows(items: DataFrame) -> DataFrame:
    """Items with all required fields, with their id."""
    return items.filter(_complete()).withColumn("id", stable_id(F.col("name"), F.col("org")))


def skipped_rows(items: DataFrame) -> DataFrame:
    """Items that lack a required field."""
    return items.filter(~_complete())


def payload_enriched(items: DataFrame) -> DataFrame:
    """Complete items with typed confidence, cost and sortable date."""
    confidence = F.when(F.col("confidence").isNull(), F.lit(DEFAULT_CONFIDENCE)).otherwise(
        F.col("confidence").try_cast("double")
    )
    return payload_rows(items).withColumns({
        "confidence": confidence,
        "cost_usd": F.col("cost_usd").try_cast("double"),
        "date_sortable": F.nullif("date_sortable", F.lit("")),
    })


def shard_rows(plans: DataFrame) -> DataFrame:
    """Search shards of ``(query_id, query, region, category, difficulty, raw)`` plans.

    A shard inherits the settings it leaves out. A plan without usable shards
    gives one broad shard of the request itself.
    """
    parsed = plans.withColumn("_plan", F.from_json("raw", PLAN_PAYLOAD))
    exploded = parsed.select(
        "*", F.posexplode_outer(F.filter("_plan.shards", lambda s: s.isNotNull())).alias("_no", "_shard")
    )

    def inherited(field: str) -> Column:
        return F.coalesce(F.nullif(F.col(f"_shard.{field}"), F.lit("")), F.col(field)).alias(field)

    return exploded.select(
        "query_id", F.coalesce("_no", F.lit(0)).alias("shard_no"),
        F.coalesce("_shard.query", "query").alias("query"),
        inherited("region"), inherited("category"), inherited("difficulty"),
        F.coalesce("_shard.focus", F.lit("broad")).alias("focus"),
        F.coalesce("_plan.intent", "query").alias("intent"),
        F.coalesce("_plan.enrich_top_n", F.lit(2)).alias("enrich_top_n"),
    )
