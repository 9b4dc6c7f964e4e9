"""Query-log analytics: repeats within a time to live, near duplicates, hit rates."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termwell.functions.text import tokens
from termwell.operators.joins import at_most, lookup_join, sized_broadcast
from termwell.operators.scan import SLICE, sliced
from termwell.session import durable
from termwell.vocab.runs import NEAR_DUPLICATE_JACCARD, QUERY_TTL_HOURS

# Ship the kernels with the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MICROS = 1_000_000
QUERY_TTL = QUERY_TTL_HOURS * 3600 * MICROS
GROUP_ROWS = 10_000
COUNTERS = 1 << 18


def _anchors_of_small_keys(times: DataFrame, key: str, ttl: int) -> DataFrame:
    start = F.struct(F.lit(None).cast("long").alias("last"), F.array().cast("array<bigint>").alias("anchors"))

    def visit(state: Column, t: Column) -> Column:
        fresh = state["last"].isNull() | (t >= state["last"] + ttl)
        return F.when(
            fresh, F.struct(t.alias("last"), F.concat(state["anchors"], F.array(t)).alias("anchors"))
        ).otherwise(state)

    return times.groupBy(key).agg(F.sort_array(F.collect_list("t")).alias("_ts")).select(
        key, F.explode(F.aggregate("_ts", start, visit)["anchors"]).alias("anchor")
    )


def _first_at(times: np.ndarray, at: np.ndarray, leave: np.ndarray) -> np.ndarray:
    """Where chains that enter at given times leave a slice: through its first row from then on, or untouched if there is none."""
    if not len(times):
        return at
    row = np.searchsorted(times, at)
    return np.where(row < len(times), leave[np.minimum(row, len(times) - 1)], at)


def _anchors_of_hot_keys(times: DataFrame, key: str, ttl: int) -> DataFrame:
    """Chains over sorted slices, which are linked by jump pointers.

    A slice says for each row at which time a chain that enters there may store the key again, once
    it has left the slice. Only rows that a chain out of the slice before can enter by matter.
    Such tables of neighbouring slices are composed pairwise, then those of pairs and so on, each time for half as
    many slices; on the way back they give the time at which the one chain of the key enters every
    slice. The number of jobs grows with the logarithm of the slices.
    """
    rows = sliced(times, [key], ["t"])
    order = W.partitionBy(key).orderBy(SLICE)
    slices = durable(rows.groupBy(key, SLICE).agg(F.min("t").alias("low"), F.max("t").alias("high")).select(
        key, SLICE, "low", (F.row_number().over(order) - 1).cast("int").alias("number"), F.lag("high").over(order).alias("before")))
    placed = rows.join(sized_broadcast(slices.drop("low")), [key, SLICE]).select(key, "number", "before", "t")
    key_type = times.schema[key].dataType.simpleString()
    kind = f"{key} {key_type}, number int, t bigint, leave bigint"

    def numbers(table: pa.Table, column: str) -> np.ndarray:
        return table.column(column).to_numpy()

    def of_key(part: pa.Table, size: int) -> pa.ChunkedArray:
        return part.column(key).take(pa.array(np.zeros(size, np.int64)))

    def jumps(part: pa.Table) -> pa.Table:
        ts, before = np.sort(numbers(part, "t")), part.column("before")[0].as_py()
        following = np.searchsorted(ts, ts + ttl)
        leave = ts + ttl
        for row in range(len(ts) - 1, -1, -1):
            if following[row] < len(ts):
                leave[row] = leave[following[row]]
        entered = min(len(ts), 1 if before is None else int(np.searchsorted(ts, before + ttl)) + 1)
        return pa.table({key: of_key(part, entered), "number": part.column("number").take(pa.array(np.zeros(entered, np.int64))),
                         "t": ts[:entered], "leave": leave[:entered]})

    def through(at: np.ndarray, table: pa.Table) -> pa.Array:
        table = table.sort_by("t")
        return pa.array(_first_at(numbers(table, "t"), at, numbers(table, "leave")))

    def composed(left: pa.Table, right: pa.Table) -> pa.Table:
        return left.set_column(3, "leave", through(numbers(left, "leave"), right))

    def entered(points: pa.Table, table: pa.Table) -> pa.Table:
        return points.set_column(2, "at", through(numbers(points, "at"), table))

    def walk(part: pa.Table, points: pa.Table) -> pa.Table:
        ts, found = np.sort(numbers(part, "t")), []
        at = int(np.searchsorted(ts, points.column("at")[0].as_py())) if points.num_rows else len(ts)
        while at < len(ts):
            found.append(ts[at])
            at = int(np.searchsorted(ts, ts[at] + ttl))
        return pa.table({key: of_key(part, len(found)), "anchor": np.array(found, np.int64)})

    def meet(left: DataFrame, right: DataFrame, how, schema: str) -> DataFrame:
        left = left.select(*[F.col(c).alias(c) for c in left.columns])  # both may come from one table
        return left.groupBy(key, "number").cogroup(right.groupBy(key, "number")).applyInArrow(how, schema)

    count = slices.agg(F.max("number")).first()[0] + 1
    tables = [durable(placed.groupBy(key, "number").applyInArrow(jumps, kind))]
    while 1 << len(tables) < count:
        step = 1 << (len(tables) - 1)
        right = tables[-1].filter(F.col("number") % (2 * step) == step).withColumn("number", (F.col("number") - step).cast("int"))
        tables.append(durable(meet(tables[-1].filter(F.col("number") % (2 * step) == 0), right, composed, kind)))
    points = slices.filter("number = 0").select(key, "number", F.col("low").alias("at"))
    for level in range(len(tables) - 1, -1, -1):
        step = 1 << level
        later = meet(points, tables[level].filter(F.col("number") % (2 * step) == 0), entered, f"{key} {key_type}, number int, at bigint")
        points = durable(points.unionByName(later.withColumn("number", (F.col("number") + step).cast("int"))))
    return meet(placed.select(key, "number", "t"), points, walk, f"{key} {key_type}, anchor bigint")


def ttl_anchors(rows: DataFrame, key: str, t: Column, ttl: int, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Times at which a key is stored: the first, then each first one ``ttl`` later.

    A use within the time to live does not extend it. Keys with few distinct
    times are folded inside a row. The others are cut into slices that are linked
    by jump pointers, so no task holds a whole key and no step waits for all slices before.
    """
    times = rows.select(key, t.cast("long").alias("t")).distinct()
    hot = times.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > group_rows).select(key)
    if at_most(hot, 0):
        return _anchors_of_small_keys(times, key, ttl)
    hot = durable(hot)
    small = _anchors_of_small_keys(times.join(hot, key, "left_anti"), key, ttl)
    return small.unionByName(_anchors_of_hot_keys(times.join(hot, key, "left_semi"), key, ttl))


def repeat_queries(log: DataFrame, ttl: int = QUERY_TTL, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Per ``key`` of ``log(key, ts)``: uses, times it was stored, and hits."""
    stored = ttl_anchors(log, "key", F.unix_micros(F.col("ts").cast("timestamp")), ttl, group_rows)
    uses = log.groupBy("key").agg(F.count(F.lit(1)).alias("uses"))
    return uses.join(stored.groupBy("key").agg(F.count(F.lit(1)).alias("stored")), "key").select(
        "key", "uses", "stored", (F.col("uses") - F.col("stored")).alias("hits")
    )


def token_set(text: Column) -> Column:
    return F.sort_array(F.array_distinct(tokens(text)))


def token_jaccard(a: Column, b: Column) -> Column:
    """Shared share of two token sets, each without repeats; 0 if either is empty.

    The lambda holds the intersection, which is costly, so it is taken once.
    """
    both = F.size(a) + F.size(b)
    shares = F.transform(
        F.array(F.size(F.array_intersect(a, b))),
        lambda shared: F.when(shared > 0, shared / (both - shared)).otherwise(0.0),
    )
    return shares[0]


def rarest_tokens(sets: DataFrame, threshold: float) -> DataFrame:
    """The rows of ``sets(…, m, set)`` with each ``token`` of the part in which a similar set must share one, and its ``place`` from 1.

    Sets are read from their rarest token on. How often a token occurs is counted by its hash in
    ``COUNTERS`` counters, so any number of tokens has one order, and no set is shuffled for it. A
    token alone in its counter is shared with no other set and left out.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            sums += np.bincount(batch.column("set").flatten().to_numpy() & (COUNTERS - 1), minlength=COUNTERS)
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_pydict({"counter": used, "n": sums[used]})

    counted = sets.select("set").mapInArrow(count, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(COUNTERS, np.int64)
    counts[counted.column("counter").to_numpy()] = counted.column("n").to_numpy()
    shared = sets.sparkSession.sparkContext.broadcast(counts)
    kept = [column for column in sets.columns if column != "set"]

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, sizes = batch.column("set").flatten().to_numpy(), batch.column("set").value_lengths().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(sizes)), sizes)
            seen = shared.value[tokens & (COUNTERS - 1)]
            order = np.lexsort((tokens, seen, row))
            place = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
            length = sizes - np.ceil(sizes * threshold - 1e-9).astype(np.int64) + 1
            good = (place <= length[row]) & (seen[order] > 1)
            yield pa.RecordBatch.from_pydict({
                **{column: batch.column(column).take(pa.array(row[good])) for column in kept},
                "token": tokens[order][good], "place": place[good].astype(np.int32)})

    fields = ", ".join(f"`{column}` {sets.schema[column].dataType.simpleString()}" for column in kept)
    return sets.mapInArrow(pick, f"{fields}, token long, place int")


def near_dup_queries(log: DataFrame, scope: Sequence[str] = (), threshold: float = NEAR_DUPLICATE_JACCARD,
                     ttl: int = QUERY_TTL) -> DataFrame:
    """The most similar earlier query that is still live, for every query that has one.

    ``log(query_id, ts, text)``; queries only match within equal ``scope``
    columns. ``match_id`` is the lowest query id with the matched token set.

    Equal token sets are merged first, per time bucket as long as the time to
    live: a bucket's first use tells whether a set was used earlier in it, its
    last use whether that is still live in the next. Only the first use of a set
    in a bucket needs a search, so copies never form pairs. Candidates share a
    token among the rarest few of both sets, at places that leave both enough
    tokens to share, which every pair above the threshold must; the join on
    those is an inner join that adaptive execution splits where it is skewed.

    Tokens are compared by 64-bit hashes, whole sets by 128 bits.
    """
    scope = list(scope)
    used = log.select(
        "query_id", *scope, F.unix_micros(F.col("ts").cast("timestamp")).alias("t"),
        F.sort_array(F.array_distinct(F.transform(tokens(F.col("text")), lambda token: F.xxhash64(token)))).alias("set"),
    ).filter(F.size("set") > 0)
    used = durable(used.withColumn("set_id", F.concat(F.hex(F.xxhash64("set")), F.hex(F.xxhash64("set", F.lit(1))))).withColumn(
        "bucket", F.floor(F.col("t") / ttl)
    ))
    # A set goes by its lowest query id from here on.
    by_bucket = used.groupBy(*scope, "set_id", "bucket").agg(
        F.min(F.struct("t", "query_id")).alias("first"), F.max(F.struct("t", "query_id")).alias("last"),
        F.min("query_id").alias("_low"),
    )
    names = by_bucket.groupBy(*scope, "set_id").agg(F.min("_low").alias("set_first"))
    entries = durable(by_bucket.join(names, [*scope, "set_id"]).select("set_first", "bucket", "first", "last"))
    sets = durable(
        entries.select("set_first").distinct()
        .join(used.select(F.col("query_id").alias("set_first"), *scope, "set"), "set_first")
        .withColumn("m", F.size("set"))
    )

    # A later use in a bucket follows the same set, and so does a first use whose
    # set was last used in the bucket before and is still live.
    earlier = entries.select("set_first", (F.col("bucket") + 1).alias("bucket"), F.col("last.t").alias("before_t"))
    starts = entries.join(earlier, ["set_first", "bucket"], "left").withColumn(
        "own_live", F.coalesce(F.col("before_t") > F.col("first.t") - ttl, F.lit(False))
    )
    first_rows = starts.select(F.col("first.query_id").alias("query_id"), "own_live")
    own = (
        used.select("query_id", *scope, "set_id").join(first_rows, "query_id", "left")
        .filter(F.coalesce("own_live", F.lit(True))).select("query_id", *scope, "set_id")
    )
    same = lookup_join(own, names, [*scope, "set_id"], "inner").select(
        "query_id", F.col("set_first").alias("match_id"), F.lit(1.0).alias("similarity")
    )

    prefixes = rarest_tokens(sets.select("set_first", *scope, "m", "set"), threshold)
    probes = starts.filter(~F.col("own_live")).select(
        F.col("set_first").alias("probe"), "bucket", F.col("first.query_id").alias("query_id"), F.col("first").alias("own"),
    )
    probe_tokens = probes.join(
        prefixes.withColumnsRenamed({"set_first": "probe", "m": "probe_m", "place": "probe_place"}), "probe"
    )
    # An entry is seen from its own bucket by its first use, from the next by its last.
    visible = entries.select(
        "set_first",
        F.inline(F.array(
            F.struct(F.col("bucket").alias("bucket"), F.col("first").alias("seen")),
            F.struct((F.col("bucket") + 1).alias("bucket"), F.col("last").alias("seen")),
        )),
    )
    entry_tokens = visible.join(prefixes, "set_first")
    pairs = (
        probe_tokens.join(entry_tokens, [*scope, "token", "bucket"])
        .filter(
            (F.col("probe") != F.col("set_first"))
            & (F.col("seen") < F.col("own")) & (F.col("seen.t") > F.col("own.t") - ttl)
            & (F.col("m") >= F.col("probe_m") * threshold - 1e-9)
            & (F.col("probe_m") >= F.col("m") * threshold - 1e-9)
            # What follows the first common token in both sets must suffice.
            & (1 + F.least(F.col("m") - F.col("place"), F.col("probe_m") - F.col("probe_place"))
               >= threshold / (1 + threshold) * (F.col("m") + F.col("probe_m")) - 1e-9)
        )
        .select("query_id", "probe", "set_first").distinct()
    )
    left = sets.select(F.col("set_first").alias("probe"), F.col("set").alias("probe_set"))
    scored = (
        pairs.join(left, "probe").join(sets.select("set_first", "set"), "set_first")
        .withColumn("similarity", token_jaccard(F.col("probe_set"), F.col("set")))
        .filter(F.col("similarity") >= threshold)
    )
    near = scored.groupBy("query_id").agg(
        F.min(F.struct((-F.col("similarity")).alias("order"), F.col("set_first").alias("match_id"))).alias("_best")
    ).select(
        "query_id", F.col("_best.match_id").alias("match_id"), (-F.col("_best.order")).alias("similarity")
    )
    return same.unionByName(near).withColumn("similarity", F.round("similarity", 6))


def query_log_stats(outcomes: DataFrame) -> DataFrame:
    """One row over ``(outcome)`` values stored-miss, hit and near_hit.

    ``hit_rate`` leaves near hits out; ``any_hit_rate`` counts them as hits.
    """
    hits, near = F.count_if(F.col("outcome") == "hit"), F.count_if(F.col("outcome") == "near_hit")
    misses = F.count_if(F.col("outcome") == "miss")
    return outcomes.agg(
        F.count(F.lit(1)).alias("lookups"), hits.alias("hits"), near.alias("near_hits"), misses.alias("misses"),
        F.round(hits / F.greatest(hits + misses, F.lit(1)), 3).alias("hit_rate"),
        F.round((hits + near) / F.greatest(hits + near + misses, F.lit(1)), 3).alias("any_hit_rate"),
    )


def invalidate_keys(log: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """The log without the given keys, or empty without an argument."""
    return log.limit(0) if keys is None else log.join(keys.select("key").distinct(), "key", "left_anti")
