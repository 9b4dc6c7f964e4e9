"""Declared schemas of the external inputs."""

from pyspark.sql import types as T

from termwell.vocab.runs import LOG_EXTRAS

_TEXT_LIST = T.ArrayType(T.StringType())

LISTING_ITEM = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("region", T.StringType()),
    T.StructField("countries", _TEXT_LIST),
    T.StructField("date", T.StringType()),
    T.StructField("deadline", T.StringType()),
    T.StructField("difficulty", T.StringType()),
    T.StructField("duration", T.StringType()),
    T.StructField("cost", T.StringType()),
    T.StructField("org", T.StringType()),
    T.StructField("subjects", _TEXT_LIST),
    T.StructField("tags", _TEXT_LIST),
    T.StructField("website", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("confidence", T.StringType()),
    T.StructField("cost_usd", T.StringType()),
    T.StructField("date_sortable", T.StringType()),
])

REQUIRED_FIELDS = [
    "name", "category", "region", "countries", "date", "deadline", "difficulty",
    "duration", "cost", "org", "subjects", "tags",
]

PLAN_PAYLOAD = T.StructType([
    T.StructField("intent", T.StringType()),
    T.StructField("shards", T.ArrayType(T.StructType([
        T.StructField("query", T.StringType()),
        T.StructField("region", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("difficulty", T.StringType()),
        T.StructField("focus", T.StringType()),
    ]))),
    T.StructField("enrich_top_n", T.IntegerType()),
])

LOG_RECORD = T.StructType(
    [T.StructField(name, T.StringType()) for name in ("ts", "level", "logger", "msg")]
    + [T.StructField(name, T.StringType()) for name in LOG_EXTRAS]
    + [
        T.StructField("exception", T.StringType()),
        T.StructField("context", T.MapType(T.StringType(), T.StringType())),
    ]
)
