"""Near duplicates by ProbMinHash signatures, banding and exact verification.

A text is a weighted set: its shingles of five words (``[^\\x20\\x09-\\x0D]+``),
weighted by how often they occur. Each shingle sends a Poisson process of
arrivals at its weight's rate; every arrival hits one of ``COMPONENTS`` parts of the
signature at random, and a part keeps the shingle that hits it first. Two texts
agree in a part with the probability Jaccard similarity of their sets. A text
is done as soon as every part's first arrival lies before the horizon up to which
all arrivals are known, so most shingles cost one random number.

Texts that agree in a band of ``ROWS`` parts are compared. Texts with equal word
sequences are merged first. Pairs whose signatures agree in ``LEAST_AGREE`` parts
are verified on the similarity of their sets, verified links are joined to classes,
and only texts of different classes are compared further. First a bucket's members are
compared with its smallest one; then, in two rounds, with a random one and with their
neighbours in a random ring, in a quarter of the buckets; then, in buckets of at most
``MIDDLE_BUCKET`` members, all that are still in different classes with one another. Up to
here work per round is proportional to the members. Last,
the members of all larger buckets that still hold several classes meet in cells of
the rarest of their shingles, in blocks that are compared as matrices, which finds every
link between classes left (see ``_rare_links``). Its rows grow with the sets and the blocks of a
cell; its arithmetic is quadratic in a cell of texts that stay just below the threshold.

With 32 bands of 4, a pair at similarity 0.8 meets in no band with probability
5e-8, and agrees in fewer than ``LEAST_AGREE`` parts with 1e-8.

Defined cases: a null text has no words; all texts without words form one class;
texts of fewer than five words have one shingle, all their words; an empty table
gives an empty result; repeated rows fall into one class.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termwell.llm.common import bit_filter, may_hold, mixed, read_table, shingle_hashes, small_batches, stored, word_hashes
from termwell.llm.registry import query

SHINGLE = 5
THRESHOLD = 0.8
BANDS = 32
ROWS = 4
COMPONENTS = BANDS * ROWS
MIDDLE_BUCKET = 64
QUARTERS = 4
RANDOM_ROUNDS = 2
ROWS_PER_TASK = 20_000
LEAST_AGREE = 76
COUNTERS = 1 << 20
BLOCK_ROWS = 1000
BLOCK_BYTES = 2 << 20
MATRIX_ITEMS = 2048
FEW_PAIRS = 16

_STEP = np.uint64(0x9E3779B97F4A7C15)


def weighted_shingles(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes in order and their counts."""
    return np.unique(shingle_hashes(words, SHINGLE), return_counts=True)


def _uniform(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1] from scrambled 64-bit values."""
    return ((mixed(x) >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0 ** -53


def prob_minhash(items: np.ndarray, weights: np.ndarray, components: int = COMPONENTS) -> np.ndarray:
    """The signature: for each part the item whose arrival hits it first; 0 without items."""
    if not len(items):
        return np.zeros(components, np.uint64)
    weights = weights.astype(np.float64)
    first = -np.log(_uniform(items)) / weights
    horizon = components * (np.log(components) + 4.0) / weights.sum()
    while True:
        # Only items that arrive before the horizon can matter; all their arrivals up to it are drawn.
        early = first <= horizon
        now, who, rate = first[early], items[early], weights[early]
        times, owners, parts = [], [], []
        drawn = 0
        while len(now):
            expected = float((horizon - now).max() * rate.max())
            width = min(int(expected + 3.0 * np.sqrt(expected)) + 2, max(2, (1 << 16) // len(now)))
            steps = (np.arange(drawn, drawn + width, dtype=np.uint64) * _STEP)[None, :]
            gaps = -np.log(_uniform(who[:, None] + steps + _STEP)) / rate[:, None]
            at = now[:, None] + np.concatenate([np.zeros((len(now), 1)), np.cumsum(gaps, axis=1)], axis=1)
            row, column = np.nonzero(at[:, :-1] <= horizon)
            times.append(at[row, column])
            owners.append(who[row])
            parts.append(mixed(who[row] * np.uint64(3) + steps[0, column] * np.uint64(2)) % np.uint64(components))
            stay = at[:, -1] <= horizon
            now, who, rate, drawn = at[stay, -1], who[stay], rate[stay], drawn + width
        if times:
            at, owner, part = np.concatenate(times), np.concatenate(owners), np.concatenate(parts).astype(np.int64)
            latest_first = np.argsort(-at, kind="stable")  # so the earliest is written last
            signature, hit = np.zeros(components, np.uint64), np.zeros(components, bool)
            signature[part[latest_first]] = owner[latest_first]
            hit[part] = True
            if hit.all():
                return signature
        horizon *= 2.0


def band_hashes(signature: np.ndarray) -> np.ndarray:
    """One 64-bit hash per band of parts."""
    grid = signature.reshape(BANDS, ROWS)
    out = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        out = mixed(out ^ grid[:, k])
    return out


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact probability Jaccard of two weighted sets of sorted distinct items.

    The sum over common items d of 1 / sum_e max(a_e / a_d, b_e / b_d). Sorted by the
    ratio of the weights, the inner sums are prefix sums. 1 for two empty sets.
    """
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    common, left, right = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    wa, wb = a[1][left].astype(float), b[1][right].astype(float)
    only_a, only_b = a[1].sum() - wa.sum(), b[1].sum() - wb.sum()
    ratio = wa / wb
    order = np.argsort(ratio, kind="stable")
    sa, sb, r = wa[order], wb[order], ratio[order]
    # For d, items e with a ratio above d's count by a_e / a_d, the others by b_e / b_d.
    above = np.cumsum(sa[::-1])[::-1]
    above = np.append(above, 0.0)[np.searchsorted(r, r, side="right")] + only_a
    below = np.append(0.0, np.cumsum(sb))[np.searchsorted(r, r, side="right")] + only_b
    return float((1.0 / (above / sa + below / sb)).sum())


def _sequence_key(words: np.ndarray) -> int:
    """A 64-bit name for a sequence of words."""
    return int.from_bytes(hashlib.blake2b(words.tobytes(), digest_size=8).digest(), "little", signed=True)


def _signatures(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, bands, sketches = [], [], []
        for text in batch.column("text"):
            words = word_hashes(text.as_py())
            signature = prob_minhash(*weighted_shingles(words))
            keys.append(_sequence_key(words))
            bands.append(band_hashes(signature).tobytes() if len(words) else None)
            sketches.append((mixed(signature) & np.uint64(255)).astype(np.uint8).tobytes())
        yield pa.record_batch({"doc_id": batch.column("doc_id"), "rep": pa.array(keys, pa.int64()),
                               "bands": pa.array(bands, pa.binary()), "sketch": pa.array(sketches, pa.binary())})


def _unpacked(crowded=None):
    """One row per band of a text; with a filter, of the buckets that may hold several texts."""
    def unpack(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps = np.repeat(batch.column("rep").to_numpy(), BANDS)
            found = np.frombuffer(b"".join(batch.column("bands").to_pylist()), np.int64)
            if crowded is not None:
                kept = may_hold(crowded.value, found)
                reps, found = reps[kept], found[kept]
            yield pa.record_batch({"bucket": pa.array(found), "rep": pa.array(reps)})

    return unpack


def _shingled(speaking):
    """The weighted shingles of the documents in a filter; counts are left out where all are 1.

    32 bits of a shingle's hash suffice to compare two texts: two shingles of one
    pair of texts of 1,000 shingles collide with a probability of 1 in 4,000, which
    moves their similarity by a thousandth.
    """
    def shingle(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            wanted = may_hold(speaking.value, ids.fill_null(0).to_numpy()) | ids.is_null().to_numpy(zero_copy_only=False)
            words = [word_hashes(text.as_py()) for text in batch.column("text").filter(pa.array(wanted))]
            sets = [np.unique(shingle_hashes(w, SHINGLE).astype(np.uint32), return_counts=True) for w in words]
            yield pa.record_batch({
                "rep": pa.array([_sequence_key(w) for w in words], pa.int64()),
                "items": pa.array([s[0].tobytes() for s in sets], pa.binary()),
                "counts": pa.array([s[1].astype(np.int32).tobytes() if (s[1] != 1).any() else b"" for s in sets], pa.binary())})

    return shingle


def _held(wanted):
    """The rows whose text is in a filter."""
    def hold(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(may_hold(wanted.value, batch.column("rep").to_numpy())))

    return hold


def _loaded(items: pa.BinaryScalar, counts: pa.BinaryScalar) -> tuple[np.ndarray, np.ndarray]:
    found = np.frombuffer(items.as_buffer(), np.uint32)
    weights = np.frombuffer(counts.as_buffer(), np.int32)
    return found, weights if len(weights) else np.ones(len(found), np.int32)


def _rows(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), width)


@F.arrow_udf(T.IntegerType())
def _agreeing(a: pa.Array, b: pa.Array) -> pa.Array:
    """Parts in which two signatures agree, from one byte of each part."""
    return pa.array((_rows(a, COMPONENTS) == _rows(b, COMPONENTS)).sum(axis=1).astype(np.int32))


@F.arrow_udf(T.DoubleType())
def _similarity(a: pa.Array, na: pa.Array, b: pa.Array, nb: pa.Array) -> pa.Array:
    return pa.array([probability_jaccard(_loaded(w, x), _loaded(y, z)) for w, x, y, z in zip(a, na, b, nb, strict=True)], pa.float64())


def connected(links: DataFrame) -> DataFrame:
    """(rep, class): the smallest member of each connected component of links (a, b).

    Every round each vertex takes the smallest label among itself and its
    neighbours, and then its label's label, until nothing changes; each round's
    labels are stored.
    """
    both = stored(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    n = both.count()
    labels = stored(_dealt(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")), n), "labels")
    while True:
        own = labels.select("a", "label", F.col("label").alias("old"))
        near = both.join(labels.select(F.col("a").alias("b"), "label"), "b").select("a", "label", F.lit(None).cast("long").alias("old"))
        lowest = own.union(near).groupBy("a").agg(F.min("label").alias("next"), F.max("old").alias("old"))
        jumped = lowest.join(labels.select(F.col("a").alias("next"), F.col("label").alias("beyond")), "next", "left")
        after = stored(_dealt(jumped, n).select("a", F.least("next", F.coalesce("beyond", "next")).alias("label"), "old"), "labels")
        labels = after.select("a", "label")
        if after.filter("label <> old").limit(1).count() == 0:
            return labels.select(F.col("a").alias("rep"), F.col("label").alias("class"))


def _dealt(df: DataFrame, rows: int) -> DataFrame:
    """The frame shuffled to tasks of about ``ROWS_PER_TASK`` of so many rows, so that small rounds write few files.

    Merging the partitions of a join into one task would keep the buffers of all of them to its end.
    """
    tasks = max(1, -(-rows // ROWS_PER_TASK))
    return df.repartition(tasks) if tasks < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def _close_pairs(batches) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of different classes whose signatures agree, from the lists of members of small buckets."""
    for batch in batches:
        found = [np.zeros((0, 2), np.int64)]
        for members in batch.column("m"):
            reps, classes, sketches = members.values.flatten()
            reps, classes, sketches = reps.to_numpy(), classes.to_numpy(), _rows(sketches, COMPONENTS)
            i, j = np.nonzero(np.triu(classes[:, None] != classes[None, :]))
            near = (sketches[i] == sketches[j]).sum(axis=1) >= LEAST_AGREE
            found.append(np.stack([reps[i[near]], reps[j[near]]], axis=1))
        pairs = np.concatenate(found)
        yield pa.record_batch({"a": pa.array(pairs.min(axis=1)), "b": pa.array(pairs.max(axis=1))})


def _candidates(buckets: DataFrame, members: DataFrame, classes: DataFrame | None, number: int) -> DataFrame:
    """Pairs (a, b) of texts of different classes that this round compares, each once."""
    pair = lambda x, y: [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]
    if classes is None:
        # Hubs are the smallest texts, so that the buckets of a group share one.
        hubs = buckets.groupBy("bucket").agg(F.min("rep").alias("hub"), F.max("rep").alias("high")).filter("hub < high")
        return buckets.join(hubs, "bucket").filter("rep <> hub").select(*pair("hub", "rep")).distinct()
    exhaustive = number > RANDOM_ROUNDS
    some = buckets if exhaustive else buckets.filter(F.pmod("bucket", F.lit(QUARTERS)) == number % QUARTERS)
    rows = some.join(classes, "rep", "left").withColumn("class", F.coalesce("class", "rep"))
    turn = F.xxhash64("rep", "bucket", F.lit(number))
    about = rows.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.min("class").alias("low"), F.max("class").alias("high"),
        F.min(F.struct(turn.alias("turn"), F.col("rep"), F.col("class"))).alias("hub")).filter("low < high").select(
        "bucket", "n", F.col("hub.rep").alias("hub"), F.col("hub.class").alias("hub_class"))
    if exhaustive:
        few = rows.join(about.filter(F.col("n") <= MIDDLE_BUCKET).select("bucket"), "bucket").join(members.select("rep", "sketch"), "rep")
        lists = few.groupBy("bucket").agg(F.collect_list(F.struct("rep", "class", "sketch")).alias("m"))
        return lists.select("m").mapInArrow(_close_pairs, "a long, b long").distinct()
    # A ring is drawn in blocks of the random order, so that no bucket has to meet in one task.
    joined = rows.join(about, "bucket").withColumn("turn", turn)
    after = W.partitionBy("bucket", "block").orderBy("turn", "rep")
    ring = joined.withColumn("block", F.pmod("turn", F.ceil(F.col("n") / F.lit(1000)))).select(
        "rep", "class", F.lead("rep").over(after).alias("other"), F.lead("class").over(after).alias("other_class"))
    star = joined.filter("class <> hub_class").select(*pair("rep", "hub"))
    return star.union(ring.filter("class <> other_class").select(*pair("rep", "other"))).distinct()


def _counted(batches) -> Iterator[pa.RecordBatch]:
    """How many sets hold a shingle, in counters that shingles share by their hash."""
    sums = np.zeros(COUNTERS, np.int64)
    for batch in batches:
        for items in batch.column("items"):
            sums += np.bincount(_counter(np.frombuffer(items.as_buffer(), np.uint32)), minlength=COUNTERS)
    at = np.flatnonzero(sums)
    yield pa.record_batch({"counter": pa.array(at), "n": pa.array(sums[at])})


def _counter(items: np.ndarray) -> np.ndarray:
    return (mixed(items.astype(np.uint64)) & np.uint64(COUNTERS - 1)).astype(np.int64)


def rare_prefix(items: np.ndarray, weights: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rarest shingles of a set and the share of its weight that lies before each.

    A pair is similar only if the shares u and v of the two sets' weights that their common
    shingles have satisfy 1/u + 1/v <= 1 + 1/THRESHOLD: with p and q as the weights over their
    sums, each inner sum of the similarity is at least 1/p + (1 - v)/q, and the sum of
    1 / (1/p + (1 - v)/q) over common shingles is at most 1 / (1/u + 1/v - 1). Where the
    first common shingle in any order of all shingles has the shares before and before' of
    the weights in front of it, u <= 1 - before and v <= 1 - before'. So it stands where
    before <= 1 - THRESHOLD in both sets, and ``_near_enough`` holds for it.
    """
    seen = counts[_counter(items)]
    order = np.lexsort((items, seen))
    weight = weights[order].astype(np.float64)
    before = (np.cumsum(weight) - weight) / weight.sum()
    kept = (before <= 1.0 - THRESHOLD + 1e-9) & (seen[order] > 1)  # what one set holds is shared with none
    return items[order][kept], before[kept]


def _near_enough(a: str, b: str) -> Column:
    return 1.0 / (1.0 - F.col(a)) + 1.0 / (1.0 - F.col(b)) <= 1.0 + 1.0 / THRESHOLD + 1e-9


def _prefixed(counts):
    def prefix(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [rare_prefix(*_loaded(x, n), counts.value) for x, n in zip(batch.column("items"), batch.column("counts"), strict=True)]
            reps = np.repeat(batch.column("rep").to_numpy(), [len(f[0]) for f in found])
            items, before = (np.concatenate([f[k] for f in found]) if found else np.zeros(0) for k in (0, 1))
            yield pa.record_batch({"rep": pa.array(reps, pa.int64()), "item": pa.array(items.astype(np.int64)),
                                   "before": pa.array(before, pa.float64())})

    return prefix


def _among_items(wanted):
    def hold(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(may_hold(wanted.value, batch.column("item").to_numpy())))

    return hold


def shared_weights(left: list, right: list) -> tuple[np.ndarray, np.ndarray]:
    """For each set of one list (rows) and of the other (columns), their weights on the shingles they share.

    Shingles that few pairs share are added pair by pair, the others by products of matrices over some of them at a time.
    """
    items = [np.concatenate([s[0] for s in side]) for side in (left, right)]
    shared = np.intersect1d(*items)
    sides = []
    for side, item in zip((left, right), items, strict=True):
        code = np.minimum(np.searchsorted(shared, item), max(len(shared) - 1, 0))
        hit = np.flatnonzero(shared[code] == item) if len(shared) else np.zeros(0, np.int64)
        hit = hit[np.argsort(code[hit], kind="stable")]
        row = np.repeat(np.arange(len(side)), [len(s[0]) for s in side])[hit]
        sides.append((code[hit], row, np.concatenate([s[1] for s in side])[hit].astype(np.float64)))
    (code_l, row_l, weight_l), (code_r, row_r, weight_r) = sides
    shape = len(left), len(right)
    often = np.bincount(code_r, minlength=len(shared))
    few = np.bincount(code_l, minlength=len(shared)) * often <= FEW_PAIRS
    rare = np.flatnonzero(few[code_l])
    times = often[code_l[rare]]
    first = np.searchsorted(code_r, code_l[rare])
    at_l = np.repeat(rare, times)
    at_r = np.arange(len(at_l)) + np.repeat(first - (np.cumsum(times) - times), times)
    pair = row_l[at_l] * shape[1] + row_r[at_r]
    mine, theirs = (np.bincount(pair, weight, shape[0] * shape[1]).reshape(shape).astype(np.float64) for weight in (weight_l[at_l], weight_r[at_r]))
    flat = (weight_l == 1).all() and (weight_r == 1).all()
    dense = np.flatnonzero(~few)
    for start in range(0, len(dense), MATRIX_ITEMS):
        part = dense[start:start + MATRIX_ITEMS]
        matrices = []
        for n, (code, row, weight) in zip(shape, sides, strict=True):
            span = slice(*np.searchsorted(code, [part[0], part[-1] + 1]))
            span = np.arange(span.start, span.stop)[~few[code[span]]]
            matrix = np.zeros((n, len(part)), np.float32 if flat else np.float64)
            matrix[row[span], np.searchsorted(part, code[span])] = weight[span]
            matrices.append(matrix)
        x, y = matrices
        product = x @ (y > 0).astype(x.dtype).T
        mine += product
        theirs += product if flat else (x > 0).astype(x.dtype) @ y.T
    return mine, theirs


def block_links(rows: pa.Table) -> pa.Table:
    """Links (a, b) between the classes of two blocks of sets, ``lo`` and ``hi``, or inside one.

    Pairs that the bound of ``rare_prefix`` leaves are verified one by one. A link between classes
    that others have joined here adds nothing, so there are fewer links than classes.
    """
    block, lo, hi = (rows.column(c).to_numpy() for c in ("block", "lo", "hi"))
    rep, of = rows.column("rep").to_numpy(), rows.column("class").to_numpy()
    sets = [_loaded(x, n) for x, n in zip(rows.column("items"), rows.column("counts"), strict=True)]
    left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
    joined: dict[int, int] = {}
    links = []

    def top(x: int) -> int:
        while x in joined:
            x = joined[x]
        return x

    if len(left) and len(right):
        mine, theirs = shared_weights([sets[k] for k in left], [sets[k] for k in right])
        total = [np.array([sets[k][1].sum() for k in side], np.float64) for side in (left, right)]
        with np.errstate(divide="ignore"):
            near = total[0][:, None] / mine + total[1][None, :] / theirs <= 1.0 + 1.0 / THRESHOLD + 1e-9
        for i, j in zip(*np.nonzero(near & (of[left][:, None] != of[right][None, :])), strict=True):
            one, other = left[i], right[j]
            p, q = top(int(of[one])), top(int(of[other]))
            if p != q and probability_jaccard(sets[one], sets[other]) >= THRESHOLD:
                joined[max(p, q)] = min(p, q)
                links.append(sorted((int(rep[one]), int(rep[other]))))
    return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})


def _rare_links(buckets: DataFrame, classes: DataFrame | None, sets: DataFrame) -> DataFrame | None:
    """Links (a, b) that join all classes with a similar pair among the members of large buckets.

    Similar sets share a rare shingle and meet in its cell. Shingles share the cell of the shingle that their
    sets most often have as their commonest, so that a set visits few cells. A cell's sets are dealt to
    blocks, which meet pairwise; sets of its commonest class meet only sets of other classes. Pairs of
    sets are never rows: a cell of n sets sends each to some n / ``BLOCK_ROWS`` meetings.
    """
    send = buckets.sparkSession.sparkContext.broadcast
    classed = buckets if classes is None else buckets.join(classes, "rep", "left")
    classed = classed.withColumn("class", F.coalesce("class", "rep") if classes is not None else F.col("rep"))
    mixed_up = classed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("class").alias("low"), F.max("class").alias("high")).filter(
        (F.col("n") > MIDDLE_BUCKET) & (F.col("low") < F.col("high"))).select("bucket")
    open_ = stored(classed.join(mixed_up, "bucket", "left_semi").select("rep", "class").distinct(), "open")
    if open_.limit(1).count() == 0:
        return None
    held = stored(sets.mapInArrow(_held(send(bit_filter(open_, "rep"))), sets.schema).join(open_, "rep", "left_semi"), "open-shingles")
    counts = np.zeros(COUNTERS, np.int64)
    with small_batches(buckets.sparkSession):
        counted = held.mapInArrow(_counted, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
        counts[counted.column("counter").to_numpy()] = counted.column("n").to_numpy()
        prefixes = stored(held.mapInArrow(_prefixed(send(counts)), "rep long, item long, before double").join(open_, "rep"), "prefixes")
    # With a share of more than half of what both may lack before it, a shingle meets only such as have less.
    early = 1.0 - 2.0 / (1.0 + 1.0 / THRESHOLD) + 1e-9
    shared = stored(prefixes.groupBy("item").agg(
        F.min("class").alias("low"), F.max("class").alias("high"), F.count(F.lit(1)).alias("n"),
        F.min("before").alias("least")).filter((F.col("low") < F.col("high")) & (F.col("least") <= early)).select("item", "n", "least"), "shared")
    if shared.limit(1).count() == 0:
        return None
    rows = stored(prefixes.mapInArrow(_among_items(send(bit_filter(shared, "item"))), prefixes.schema).join(shared, "item").filter(
        _near_enough("before", "least")).select("item", "n", "rep", "class"), "shared-rows")
    heads = rows.groupBy("rep").agg(F.max_by("item", F.struct("n", "item")).alias("head"))
    votes = rows.join(heads, "rep").groupBy("item", "head").agg(F.count(F.lit(1)).alias("n"))
    cells = votes.groupBy("item").agg(F.max_by("head", F.struct("n", "head")).alias("cell"))
    placed = stored(rows.join(cells, "item").select("cell", "rep", "class").distinct().join(
        held.select("rep", F.length("items").alias("size")), "rep"), "cells")
    parts = lambda n, size: F.ceil(F.greatest(n / F.lit(BLOCK_ROWS), size / F.lit(BLOCK_BYTES)))
    about = placed.groupBy("cell", "class").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).groupBy("cell").agg(
        F.sum("n").alias("n"), F.sum("size").alias("size"), F.max(F.struct("n", "class", "size")).alias("most")).filter(
        F.col("n") > F.col("most.n")).select(
        "cell", F.col("most.class").alias("top"), parts(F.col("n") - F.col("most.n"), F.col("size") - F.col("most.size")).alias("minor"),
        parts(F.col("most.n"), F.col("most.size")).alias("major"))
    turn, is_top = F.xxhash64("rep"), F.col("class") == F.col("top")
    dealt = placed.join(about, "cell").select(
        "cell", "rep", "class", F.when(is_top, F.col("minor") + F.pmod(turn, "major")).otherwise(F.pmod(turn, "minor")).alias("block"),
        (F.when(is_top, F.col("minor")).otherwise(F.col("minor") + F.col("major")) - 1).alias("last"))
    meeting = dealt.join(held.select("rep", "items", "counts"), "rep").withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last")))).select(
        "cell", "block", "rep", "class", "items", "counts", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    return stored(meeting.groupBy("cell", "lo", "hi").applyInArrow(block_links, "a long, b long").distinct(), "similar")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class_id): the class of each row, named by its smallest document."""
    spark = df.sparkSession
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    with small_batches(spark):
        signed = stored(docs.mapInArrow(_signatures, "doc_id long, rep long, bands binary, sketch binary"), "signatures")
    texts = stored(signed.groupBy("rep").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"),
                                             F.first("sketch").alias("sketch")), "texts")
    banded = texts.filter("bands IS NOT NULL").select("rep", "bands")
    crowded = banded.mapInArrow(_unpacked(), "bucket long, rep long").groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n")).filter("n > 1")
    send = spark.sparkContext.broadcast
    buckets = stored(banded.mapInArrow(_unpacked(send(bit_filter(stored(crowded.select("bucket"), "crowded"), "bucket"))),
                                       "bucket long, rep long"), "buckets")
    members = stored(texts.select("rep", "doc_id", "sketch").join(buckets.select("rep").distinct(), "rep", "left_semi"), "members")
    sets = None

    def both(pairs: DataFrame, of: DataFrame) -> DataFrame:
        named = lambda end: of.select(*[F.col(c).alias(end if c == "rep" else f"{c}_{end}") for c in of.columns])
        return pairs.join(named("a"), "a").join(named("b"), "b")

    def close_ones(pairs: DataFrame, n_pairs: int) -> DataFrame:
        return stored(_dealt(both(pairs, members.select("rep", "sketch")).filter(
            _agreeing("sketch_a", "sketch_b") >= LEAST_AGREE).select("a", "b"), n_pairs), "close")

    def similar(close: DataFrame) -> DataFrame:
        # Only sets of texts in these pairs are shuffled.
        ends = send(bit_filter(close.select(F.explode(F.array("a", "b")).alias("rep")), "rep"))
        with small_batches(spark):
            return stored(_dealt(both(close, sets.mapInArrow(_held(ends), sets.schema)).filter(
                _similarity("items_a", "counts_a", "items_b", "counts_b") >= THRESHOLD).select("a", "b"), close.count()), "similar")

    tried, links, classes, n_buckets = None, None, None, buckets.count()
    for number in range(RANDOM_ROUNDS + 2):
        pairs = _candidates(buckets, members, classes, number)
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        with small_batches(spark):
            pairs = stored(_dealt(pairs, n_buckets), "pairs")
        tried = pairs if tried is None else tried.union(pairs)
        n_pairs = pairs.count()
        if not n_pairs:
            if classes is None:
                break
            continue
        if sets is None:
            speaking = send(bit_filter(members, "doc_id"))
            with small_batches(spark):
                sets = stored(docs.mapInArrow(_shingled(speaking), "rep long, items binary, counts binary")
                              .dropDuplicates(["rep"]).join(members.select("rep"), "rep", "left_semi"), "shingles")
        fresh = similar(pairs if number > RANDOM_ROUNDS else close_ones(pairs, n_pairs))
        if fresh.limit(1).count() > 0:
            links = fresh if links is None else links.union(fresh)
            classes = connected(links)
        elif classes is None:
            classes = connected(fresh)
    fresh = _rare_links(buckets, classes, sets) if sets is not None else None
    if fresh is not None and fresh.limit(1).count() > 0:
        classes = connected(fresh if links is None else links.union(fresh))

    if classes is None:
        named = texts.select("rep", F.col("doc_id").alias("class_id"))
    else:
        placed = stored(texts.select("rep", "doc_id").join(classes, "rep", "left").select(
            "rep", "doc_id", F.coalesce("class", "rep").alias("class")), "classes")
        names = placed.groupBy("class").agg(F.min("doc_id").alias("class_id"))
        named = placed.join(names, "class").select("rep", "class_id")
    return signed.select("doc_id", "rep").join(named, "rep").select("doc_id", "class_id")


@query("op8_minhash")
def op8_minhash(spark, sf_dir):
    """Every document with the class of its near duplicates."""
    return near_duplicates(read_table(spark, sf_dir, "documents"))
