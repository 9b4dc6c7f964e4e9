"""How rows lie: over the cores available, and in stored buckets."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession


def spread(df: DataFrame) -> DataFrame:
    """Rows over at least as many partitions as there are cores.

    Only frames read in fewer splits than cores are redistributed, for costly
    row-wise work. A large table has more splits and passes without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _table_name(path: str) -> str:
    return f"bucketed_{hashlib.sha256(path.encode()).hexdigest()[:20]}"


def write_bucketed(df: DataFrame, path: str, by: str, buckets: int) -> DataFrame:
    """Store rows bucketed and sorted by a column; returns the stored table.

    Look-ups of a few values read only their buckets, and joins on the column leave the stored rows where they are.
    """
    (df.repartition(buckets, by).write.mode("overwrite").bucketBy(buckets, by).sortBy(by)
     .option("path", path).format("parquet").saveAsTable(_table_name(path)))
    return read_bucketed(df.sparkSession, path, by, buckets)


def read_bucketed(spark: SparkSession, path: str, by: str, buckets: int) -> DataFrame:
    """A table of ``write_bucketed``, in a session that may not know it yet."""
    name = _table_name(path)
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{by}`) SORTED BY (`{by}`) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)
