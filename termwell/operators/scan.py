"""Ordered computations over groups of any size.

A window over ``partitionBy(group)`` puts a whole group into one task, which
fails when one group holds a large share of the table. The functions here cut
the rows, sorted by (group, order), into range partitions of even size
("slices"), compute inside each slice, and carry one row per slice and group
forward. No task ever sees more than one slice of a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termwell.session import durable

SLICE = "_slice"


def _asc(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(item) if isinstance(item, str) else item for item in order]


def sliced(df: DataFrame, group: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Rows with the number of the range partition they fall into.

    The result is stored: slice bounds come from sampling, and every branch that
    reads the slice number must see the same one, also after a lost executor.
    """
    ranged = df.repartitionByRange(*[F.col(g) for g in group], *_asc(order))
    return durable(ranged.withColumn(SLICE, F.spark_partition_id()))


def running(df: DataFrame, group: Sequence[str], order: Sequence[str | Column],
            values: dict[str, tuple[str, Column]], inclusive: bool = True,
            totals: bool = False) -> DataFrame:
    """Add running sums and maxima within each group.

    ``values`` maps a new column to ``("sum" | "max", expression)``. The order
    must be unique within a group. Without ``inclusive`` the own row is left out;
    the first row of a group then gets 0 for a sum and null for a maximum. With
    ``totals`` the value over the whole group is added as ``<column>_total``.
    """
    aggregates = {"sum": F.sum, "max": F.max}
    group = list(group)
    inputs = {f"_in_{name}": expr for name, (_, expr) in values.items()}
    rows = sliced(df.withColumns(inputs), group, order)

    # What the earlier slices of a group hold, as one row ahead of each slice.
    earlier = W.partitionBy(*group).orderBy(SLICE).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*group)
    per_slice = rows.groupBy(SLICE, *group).agg(
        *[aggregates[kind](f"_in_{name}").alias(f"_in_{name}") for name, (kind, _) in values.items()]
    )
    carried = per_slice.select(
        SLICE, *group,
        *[aggregates[kind](f"_in_{name}").over(earlier).alias(f"_in_{name}") for name, (kind, _) in values.items()],
        *[aggregates[kind](f"_in_{name}").over(whole).alias(f"_all_{name}")
          for name, (kind, _) in values.items() if totals],
        F.lit(0).alias("_row"),
    )
    placed = rows.withColumn("_row", F.lit(1)).unionByName(carried, allowMissingColumns=True)
    piece = W.partitionBy(SLICE, *group)
    upto = piece.orderBy("_row", *_asc(order)).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)

    def scanned(name: str, kind: str) -> Column:
        value = aggregates[kind](f"_in_{name}").over(upto)
        return F.coalesce(value, F.lit(0)) if kind == "sum" else value

    return placed.select(
        *df.columns, "_row",
        *[scanned(name, kind).alias(name) for name, (kind, _) in values.items()],
        *[F.max(f"_all_{name}").over(piece).alias(f"{name}_total") for name in values if totals],
    ).filter(F.col("_row") == 1).drop("_row")


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], name: str = "rank",
             totals: bool = False) -> DataFrame:
    """Add the position of each row within its group, from 1."""
    return running(df, group, order, {name: ("sum", F.lit(1).cast("long"))}, totals=totals)


def previous(df: DataFrame, group: Sequence[str], order: Sequence[str],
             values: Sequence[str], prefix: str = "prev_") -> DataFrame:
    """Add the values of the preceding row within the group; ascending order only."""
    row = F.struct(*order, *[value for value in values if value not in order])
    scanned = running(df, group, order, {"_previous": ("max", row)}, inclusive=False)
    return scanned.select(
        *df.columns, *[F.col(f"_previous.{value}").alias(f"{prefix}{value}") for value in values]
    )


def join_slices(rows: DataFrame, ahead: DataFrame, group: Sequence[str]) -> DataFrame:
    """Rows of slices with what a table of one row per slice and group says of theirs."""
    own = ahead.select(*[F.col(c).alias(f"_of_{c}" if c in (SLICE, *group) else c) for c in ahead.columns])
    same = F.col(SLICE) == F.col(f"_of_{SLICE}")
    for column in group:
        same = same & F.col(column).eqNullSafe(F.col(f"_of_{column}"))
    return rows.drop(*[c for c in own.columns if c in rows.columns]).join(own, same).drop(*[c for c in own.columns if c.startswith("_of_")])
