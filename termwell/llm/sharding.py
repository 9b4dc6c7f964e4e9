"""Range shards of near equal size from sampled splitters.

Rows are ordered by (hash of their text, tie-break). A size-weighted sample of
these keys gives quantile boundaries for many small ranges; ranges that turn
out overfull are subdivided with a denser sample of their own. The rows are
then partitioned by range, and the exact bytes ahead of each range place every
row: shard ``i`` holds the rows whose running total falls into the i-th equal
part of all bytes. Equal texts stand next to each other and share a shard,
unless the group is larger than ``group_share`` of a shard; such hot groups are
dealt out row by row.

Only the splitters (a sample of bounded size), the totals per range and the hot
groups (at most ``shards / group_share``) reach the driver or are broadcast.

Defined cases: a null text counts as empty; a row of no, null or negative size counts one byte; an empty table gives an empty
result; repeated rows are placed one by one; input columns named ``shard`` or
``slot`` are replaced; other columns pass through under any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termwell.llm.common import read_table, stored
from termwell.llm.registry import query

SHARDS = 24
RANGES_PER_SHARD = 16
SAMPLES_PER_RANGE = 64
GROUP_SHARE = 0.02
RECORD_BYTES = 8


def text_bytes(text: str = "text") -> Column:
    """UTF-8 bytes of a text plus the bytes of its record head."""
    return F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + F.lit(RECORD_BYTES)


def _uniform(salt: str, seed: int) -> Column:
    """A number in [0, 1) that a row keeps in every run over the stored table."""
    return F.pmod(F.xxhash64(F.col(salt), F.lit(seed)), F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))


def _range_of(bounds: list[tuple[int, int]]) -> Column:
    """The number of boundaries below the row's key, by binary search in a constant array."""
    if not bounds:
        return F.lit(0)
    steps = len(bounds).bit_length()
    items = ", ".join(f"named_struct('h', {h}L, 'sub', {s}L)" if min(h, s) > -(1 << 63) else
                      f"named_struct('h', {_long(h)}, 'sub', {_long(s)})" for h, s in bounds)
    return F.expr(
        f"aggregate(sequence({steps - 1}, 0, -1), 0, (low, bit) -> CASE WHEN low + shiftleft(1, bit) <= {len(bounds)} "
        f"AND element_at(array({items}), low + shiftleft(1, bit)) < named_struct('h', h, 'sub', sub) "
        "THEN low + shiftleft(1, bit) ELSE low END)"
    )


def _long(value: int) -> str:
    return f"{value}L" if value > -(1 << 63) else "(-9223372036854775807L - 1L)"


def _splitters(rows: DataFrame, total: float, ranges: int, seed: int) -> list[tuple[int, int]]:
    """Keys that cut the rows into about ``ranges`` parts of equal size, from a size-weighted sample."""
    step = max(1.0, total / (ranges * SAMPLES_PER_RANGE))
    drawn = rows.filter(_uniform("salt", seed) < F.col("size") / F.lit(step))
    sample = sorted((r["h"], r["sub"], max(r["size"], step)) for r in drawn.select("h", "sub", "size").collect())
    weight, passed, cuts = sum(s[2] for s in sample), 0.0, []
    for h, sub, size in sample:
        before, passed = passed, passed + size
        if int(before * ranges / weight) < int(passed * ranges / weight) and passed < weight:
            cuts.append((h, sub))
    return sorted(set(cuts))


def _per_range(rows: DataFrame, bounds: list[tuple[int, int]]) -> DataFrame:
    return rows.groupBy(_range_of(bounds).alias("rng")).agg(
        F.sum("size").alias("bytes"), F.min(F.struct("h", "sub")).alias("low"), F.max(F.struct("h", "sub")).alias("high"))


def assign_shards(df: DataFrame, shards: int = SHARDS, text: str = "text", size: Column | None = None,
                  group_share: float = GROUP_SHARE) -> DataFrame:
    """The rows with ``shard`` (0 to shards - 1) and ``slot`` (0, 1, ... within the shard)."""
    df = df.drop("shard", "slot")
    size = text_bytes(text) if size is None else size
    rows = stored(df.select(
        F.struct("*").alias("row"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h"),
        F.greatest(F.coalesce(size.cast("long"), F.lit(1)), F.lit(1)).alias("size"), F.monotonically_increasing_id().alias("salt")), "shard-rows")
    total = rows.agg(F.sum("size")).first()[0] or 0
    if total == 0:
        return rows.select("row.*", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot")).limit(0)
    share = max(1, int(total * group_share / shards))
    hot = F.broadcast(rows.groupBy("h").agg(F.sum("size").alias("group_bytes"))
                      .filter(F.col("group_bytes") > share).select("h", F.lit(True).alias("hot")))
    rows = rows.join(hot, "h", "left").withColumn(
        "sub", F.when(F.col("hot"), F.xxhash64("salt")).otherwise(F.lit(0).cast("long"))).drop("hot")

    ranges = shards * RANGES_PER_SHARD
    bounds = _splitters(rows, total, ranges, seed=1)
    for attempt in range(2, 6):
        overfull = [r for r in _per_range(rows, bounds).filter(
            (F.col("bytes") > 2 * total / ranges) & (F.col("low") != F.col("high"))).collect()]
        if not overfull:
            break
        more = set(bounds)
        for r in overfull:
            part = rows.filter(_range_of(bounds) == r["rng"])
            more.update(_splitters(part, r["bytes"], 2 * -(-r["bytes"] * ranges // total), seed=attempt))
        if len(more) == len(bounds):
            break
        bounds = sorted(more)

    ranged = rows.withColumn("rng", _range_of(bounds))
    ahead = W.orderBy("rng").rowsBetween(W.unboundedPreceding, -1)
    offsets = ranged.groupBy("rng").agg(F.sum("size").alias("bytes")).select(
        "rng", F.coalesce(F.sum("bytes").over(ahead), F.lit(0)).alias("before"))
    upto = F.col("before") + F.sum("size").over(W.partitionBy("rng").orderBy("h", "sub"))
    placed = ranged.join(F.broadcast(offsets), "rng").withColumn("upto", upto).withColumn(
        "shard", F.expr(f"CAST((upto - 1) * {shards}L div {total}L AS int)"))
    before_shard = W.partitionBy("shard").orderBy("rng").rowsBetween(W.unboundedPreceding, -1)
    slots = placed.groupBy("rng", "shard").agg(F.count(F.lit(1)).alias("n")).select(
        "rng", "shard", F.coalesce(F.sum("n").over(before_shard), F.lit(0)).alias("taken"))
    within = W.partitionBy("rng", "shard").orderBy("h", "sub", "salt")
    return placed.join(F.broadcast(slots), ["rng", "shard"]).select(
        "row.*", "shard", (F.col("taken") + F.row_number().over(within) - 1).alias("slot"))


@query("op6_sharding")
def op6_sharding(spark, sf_dir):
    """Every document with its shard under the law of near equal bytes."""
    docs = read_table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select("doc_id", text_bytes().alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
                         F.md5(text.cast("binary")).alias("text"))
    placed = assign_shards(narrow, size=F.col("size"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))
