"""Helpers shared by the operators: tables, stored intermediate results, word and shingle hashes.

The hash helpers work on UTF-8 bytes with numpy: one pass over the bytes of a
text gives the hashes of all its words, without a Python object per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termwell.operators.filters import bit_filter, may_hold, mixed  # noqa: F401
from termwell.session import run_dir

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_stored: dict[str, list[str]] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows written as Parquet below ``spark.checkpoint.dir`` and read again: lineage ends here."""
    spark = df.sparkSession
    path = run_dir(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    _stored.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder, dropped with the stored tables."""
    path = run_dir(spark, label)
    _stored.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def drop_stored(spark: SparkSession) -> int:
    """Delete this session's stored intermediate tables; results that read them must be written by then."""
    paths = _stored.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    return len(paths)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Jobs run inside hand Python at most so many rows at a time, for rows that may be long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def spread_pieces(text: Column, most: int, pieces: int = 8) -> Column:
    """A text of at most ``most`` characters (or bytes), or that many in pieces spread evenly over all of a longer one."""
    size = most // pieces
    room = F.length(text) - size
    parts = [F.substring(text, (F.floor(room * F.lit(k) / (pieces - 1)) + 1).cast("int"), F.lit(size)) for k in range(pieces)]
    return F.when(F.length(text) <= most, text).otherwise(F.concat(*parts))


_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def powers_of(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier and of its inverse; grown in steps and kept."""
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), 1 << 16)
        _powers = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, _MULTIPLIER)], dtype=np.uint64)
        _inverses = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, _INVERSE)], dtype=np.uint64)
    return _powers[:n], _inverses[:n]


def word_spans(data: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes for which ``inside`` (a table of 256) holds."""
    flags = np.zeros(len(data) + 2, np.int8)
    flags[1:-1] = inside[data]
    edges = np.diff(flags)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def hash_sums(data: np.ndarray) -> np.ndarray:
    """Running sums over the bytes, from which the hash of any span follows."""
    powers, _ = powers_of(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data + np.uint64(1)) * powers[:-1], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes: equal spans have equal hashes wherever they stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    _, inverses = powers_of(len(sums))
    return mixed((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(np.uint64))


def word_hashes(text: str | bytes | None, inside: np.ndarray = ~SPACE) -> np.ndarray:
    """Hashes of the words of a text; words are runs of bytes of the given table, by default ``[^\\x20\\x09-\\x0D]+``."""
    data = np.frombuffer((text or "").encode() if not isinstance(text, bytes) else text, np.uint8)
    return span_hashes(hash_sums(data), *word_spans(data, inside))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` consecutive words; of the whole sequence if it is shorter, none if empty."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    size = min(size, n)
    powers, _ = powers_of(size + 1)
    out = np.full(n - size + 1, np.uint64(size))
    for k in range(size):
        out += words[k:n - size + 1 + k] * powers[k + 1]
    return mixed(out)
