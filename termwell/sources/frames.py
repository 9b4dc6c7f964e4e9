"""Server-sent event text as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Frames of event-stream files: blocks separated by a blank line."""
    return spark.read.option("lineSep", "\n\n").text(path)


def event_frames(frames: DataFrame) -> DataFrame:
    """``(event, data)`` of each ``(value)`` frame; malformed JSON data is skipped.

    Other columns of the frame are kept. The data is checked inside brackets, as
    the parser ignores whatever follows a complete value.
    """
    kept = [column for column in frames.columns if column != "value"]
    event = F.trim(F.regexp_extract("value", r"(?m)^event: (.*)$", 1))
    lines = F.regexp_extract_all("value", F.lit(r"(?m)^data: (.*)$"), F.lit(1))
    return (
        frames.select(*kept, event.alias("event"), F.explode(lines).alias("data"))
        .filter(F.try_parse_json(F.concat(F.lit("["), "data", F.lit("]"))).isNotNull())
    )
