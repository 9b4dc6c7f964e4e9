"""Membership filters of bounded size, for scans that should skip most other rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BITS = 1 << 16


def bit_filter(keys: DataFrame, column: str, most_bits: int = 1 << 27, bits_per_key: int = 16) -> np.ndarray:
    """A one-hash membership filter of 64-bit keys, for scans that should skip most other rows.

    It has about ``bits_per_key``, but never more than ``most_bits``: 16 MB by default,
    whatever the number of keys. A crowded filter lets more other rows pass and
    never drops a key. Its blocks are filled on the executors.
    """
    bits = BLOCK_BITS
    wanted = min(bits_per_key * keys.count(), most_bits)
    while bits < wanted:
        bits *= 2

    def place(batches):
        for batch in batches:
            at = np.unique(mixed(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)) & np.uint64(bits - 1))
            yield pa.record_batch({"block": pa.array((at // BLOCK_BITS).astype(np.int32)),
                                   "bit": pa.array((at % BLOCK_BITS).astype(np.int32))})

    def pack(rows: pa.Table) -> pa.Table:
        flags = np.zeros(BLOCK_BITS, bool)
        flags[rows.column("bit").to_numpy()] = True
        return pa.table({"block": rows.column("block")[:1], "flags": pa.array([np.packbits(flags, bitorder="little").tobytes()])})

    blocks = keys.select(column).filter(f"{column} IS NOT NULL").mapInArrow(place, "block int, bit int").groupBy("block").applyInArrow(
        lambda rows: pack(rows), "block int, flags binary")
    filled = np.zeros(bits // 8, np.uint8)
    for row in blocks.collect():
        filled[row["block"] * BLOCK_BITS // 8:(row["block"] + 1) * BLOCK_BITS // 8] = np.frombuffer(row["flags"], np.uint8)
    return filled


def may_hold(filled: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """False for keys that were surely not put into the filter."""
    at = mixed(keys.view(np.uint64)) & np.uint64(len(filled) * 8 - 1)
    return (filled[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values, so that all bits depend on all bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def may_match(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """The rows whose value is in ``keys``, and a few others; nulls count as equal. Rows stay where they are."""
    filled = df.sparkSession.sparkContext.broadcast(bit_filter(keys.select(F.xxhash64(column).alias("key")), "key"))

    def held(values: pa.Array) -> pa.Array:
        return pa.array(may_hold(filled.value, values.to_numpy(zero_copy_only=False)))

    return df.filter(F.arrow_udf(held, "boolean")(F.xxhash64(column)))
