"""Running bounded streams into tables on the shared folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termwell.session import run_dir

COMPACT_EVERY = 16
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def table_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """A parquet table as a stream with its stored schema."""
    schema: T.StructType = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def use_rocksdb(spark: SparkSession) -> None:
    """Keep operator state on local disk with its log on the shared folder."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def append_to_table(stream: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Run an append-mode stream over all data present and return the written table."""
    spark = stream.sparkSession
    path = path or run_dir(spark, label)
    query = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", f"{path}/progress").option("path", f"{path}/rows")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def each_batch(stream: DataFrame, write: Callable[[DataFrame, int], None], path: str, mode: str = "append") -> None:
    """Run a stream over all data present, handing each micro-batch to ``write``.

    A batch may come twice after a failure; ``write`` must replace what it wrote
    for the same batch number.
    """
    query = (
        stream.writeStream.foreachBatch(write).outputMode(mode)
        .option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    )
    query.awaitTermination()


def replace_batch(batch: DataFrame, batch_id: int, path: str) -> None:
    """Write one batch into its own folder, replacing an earlier attempt."""
    batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def _versions(spark: SparkSession, path: str, prefix: str) -> dict[int, object]:
    """Complete folders ``<prefix>=<number>`` below a path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [f.getPath() for f in system.listStatus(at)] if system.exists(at) else []
    return {int(f.getName().split("=")[1]): f for f in found if f.getName().startswith(f"{prefix}=")
            and system.exists(spark._jvm.org.apache.hadoop.fs.Path(f, "_SUCCESS"))}


def replace_rows(batch: DataFrame, batch_id: int, path: str, keys: list[str], every: int = COMPACT_EVERY) -> None:
    """Add a batch of updates to a table of current rows; every few batches all are merged into one folder.

    Batches merged into an older folder than the last are deleted, so readers of the last one are left alone.
    """
    spark = batch.sparkSession
    replace_batch(batch, batch_id, f"{path}/updates")
    if (batch_id + 1) % every:
        return
    merged = sorted(n for n in _versions(spark, f"{path}/merged", "upto") if n < batch_id)
    replace = current_rows(spark, path, keys, before=batch_id)
    replace.write.mode("overwrite").parquet(f"{path}/merged/upto={batch_id}")
    system = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for folder, prefix in (("updates", "batch"), ("merged", "upto")):
        for number, at in _versions(spark, f"{path}/{folder}", prefix).items():
            if merged and number < merged[-1] + (prefix == "batch"):
                system.delete(at, True)


def current_rows(spark: SparkSession, path: str, keys: list[str], before: int | None = None) -> DataFrame:
    """The current row per key of a table of ``replace_rows``."""
    merged = [n for n in _versions(spark, f"{path}/merged", "upto") if before is None or n < before]
    last = max(merged, default=-1)
    updates = spark.read.parquet(f"{path}/updates").filter(F.col("batch") > last)
    if merged:
        updates = updates.unionByName(spark.read.parquet(f"{path}/merged/upto={last}").withColumn("batch", F.lit(last)))
    return _latest(updates, keys)


def latest_per_key(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Current value per key of a table of update batches."""
    return _latest(spark.read.parquet(path), keys)


def _latest(updates: DataFrame, keys: list[str]) -> DataFrame:
    rest = [column for column in updates.columns if column not in (*keys, "batch")]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_row")).select(
        *keys, *[F.col(f"_row.{column}").alias(column) for column in rest]
    )
