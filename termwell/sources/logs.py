"""Structured log lines with a fixed schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termwell.schemas import LOG_RECORD
from termwell.vocab.runs import LOG_EXTRAS


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def log_ingest(lines: DataFrame) -> DataFrame:
    """Typed log records of ``(value)`` JSON lines; lines that are no JSON are dropped.

    A non-empty context value wins over the record's own. Fields that are not
    listed are dropped. An exception is kept as its class name.
    """
    records = lines.select(F.from_json("value", LOG_RECORD).alias("r")).filter(F.col("r.msg").isNotNull())

    def merged(field: str) -> Column:
        return F.coalesce(F.nullif(F.col("r.context")[field], F.lit("")), F.col(f"r.{field}"))

    fields = {field: merged(field) for field in LOG_EXTRAS}
    fields["error"] = F.coalesce("r.exception", fields["error"])
    return records.select(
        F.to_timestamp("r.ts").alias("ts"), "r.level", "r.logger", "r.msg",
        *[value.alias(field) for field, value in fields.items()],
    )
