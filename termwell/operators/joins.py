"""Join helpers with a checked size for everything that is broadcast."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
HOT_SHARE = 1_000
HOT_MIN_ROWS = 1_000_000


def at_most(df: DataFrame, rows: int) -> bool:
    """True if the frame has no more than that many rows; counts no further."""
    return df.limit(rows + 1).count() <= rows


def sized_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The frame marked for broadcast if it is small, else unmarked.

    Unmarked frames are joined by sorted merge, where adaptive execution splits
    skewed partitions.
    """
    return F.broadcast(df) if at_most(df, rows) else df


def lookup_join(facts: DataFrame, lookup: DataFrame, keys: Sequence[str], how: str = "left",
                hot_min_rows: int = HOT_MIN_ROWS) -> DataFrame:
    """Join a lookup (unique keys) to facts of which one key may hold a large share.

    Keys with more than a thousandth of all fact rows number fewer than a
    thousand, so their lookup rows are broadcast. The other keys are joined by
    an ordinary shuffle, which they cannot skew.
    """
    keys = list(keys)
    counts = facts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total, largest = counts.agg(F.sum("_n"), F.max("_n")).first()
    least = max(hot_min_rows, (total or 0) // HOT_SHARE)
    if (largest or 0) <= least:
        return facts.join(lookup, keys, how)
    hot = F.broadcast(counts.filter(F.col("_n") > least).select(*keys))
    hot_facts = facts.join(hot, keys, "left_semi")
    other_facts = facts.join(hot, keys, "left_anti")
    hot_lookup = F.broadcast(lookup.join(hot, keys, "left_semi"))
    return hot_facts.join(hot_lookup, keys, how).unionByName(other_facts.join(lookup, keys, how))
