"""Approximate nearest neighbours by a forest of random-projection trees.

Nearness is the largest inner product. Vectors get one more component, the root of
the largest squared length less their own, so that all are of equal length and the
largest product is the smallest distance. Every tree halves a sample at the median
of a random difference of two vectors, down to ``LEAVES`` leaves; every vector is put
into its leaf of every tree. A query goes down all trees through one shared
priority queue, ordered by the largest margin crossed on the way, and opens leaves
until they hold ``BUDGET`` times the vectors. The candidates of each leaf are ranked by their
exact product in double precision and the best of all leaves are merged.

Equal vectors are merged before the search: one stands for all, with the
``k + 1`` smallest identifiers, which is all that a list of ``k`` without the query's own
row can need. So no leaf is filled by copies.

The trees are fitted on a sample of ``SAMPLE`` expected vectors and are the only thing sent to
all executors. Leaves meet their queries in groups cut to at most about ``CHUNK`` vectors
and ``QUERY_CHUNK`` queries. Recall is measured in the tests and listed in the README.

Defined cases: vectors that are null, zero, of another dimension than most, or hold
null or non-finite components take no part, nor do rows without identifier; repeated
rows count once; with at most ``k`` other vectors all are returned; an empty
table gives an empty result.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termwell.llm.common import read_table, stored
from termwell.llm.registry import query

NEIGHBOURS = 20
TREES = 10
LEAVES = 32
MOST_LEAVES = 4096
LEAF_ROWS = 20_000
LEAST_LEAF = 1024
BUDGET = 1.25
SAMPLE = 1 << 16
CHUNK = 200_000
QUERY_CHUNK = 20_000
MARGIN = 1e-9


@dataclass(frozen=True)
class Forest:
    """Complete binary trees, node ``n`` above ``2n + 1`` and ``2n + 2``; normals (tree, node, component)."""

    depth: int
    normals: np.ndarray
    cuts: np.ndarray
    shares: np.ndarray  # of the sample, per tree and leaf

    @classmethod
    def fit(cls, sample: np.ndarray, leaves: int, trees: int = TREES, seed: int = 7) -> Forest:
        depth, rng = max(0, int(leaves).bit_length() - 1), np.random.default_rng(seed)
        inner = (1 << depth) - 1
        normals = np.zeros((trees, inner, sample.shape[1]))
        cuts, shares = np.zeros((trees, inner)), np.zeros((trees, inner + 1))
        for tree in range(trees):
            rows = {0: np.arange(len(sample))}
            for node in range(inner):
                own = rows.pop(node)
                if len(own) > 1:
                    a, b = sample[rng.choice(own, 2, replace=False)]
                    length = np.linalg.norm(a - b)
                    normals[tree, node] = (a - b) / length if length else rng.normal(size=sample.shape[1])
                else:
                    normals[tree, node] = rng.normal(size=sample.shape[1])
                along = sample[own] @ normals[tree, node]
                cuts[tree, node] = np.median(along) if len(own) else 0.0
                right = along > cuts[tree, node]
                rows[2 * node + 1], rows[2 * node + 2] = own[~right], own[right]
            for leaf in range(inner + 1):
                shares[tree, leaf] = len(rows[inner + leaf]) / max(1, len(sample))
        return cls(depth, normals, cuts, shares)

    def margins(self, vectors: np.ndarray) -> np.ndarray:
        """Signed distance of every vector from every cut: (vector, tree, node)."""
        trees, inner, size = self.normals.shape
        return (vectors @ self.normals.reshape(trees * inner, size).T).reshape(len(vectors), trees, inner) - self.cuts

    def leaf_of(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of every vector in every tree: (vector, tree)."""
        margins = self.margins(vectors)
        node = np.zeros(margins.shape[:2], np.int64)
        for _ in range(self.depth):
            right = np.take_along_axis(margins, node[:, :, None], axis=2)[:, :, 0] > 0
            node = 2 * node + 1 + right
        return node - margins.shape[2]

    def probes(self, margins: list[list[float]], budget: float = BUDGET) -> list[tuple[int, int]]:
        """The leaves one query opens, best first, through a queue shared by all trees."""
        inner = (1 << self.depth) - 1
        queue = [(0.0, tree, 0) for tree in range(len(margins))]
        opened, held = [], 0.0
        while queue and held < budget:
            crossed, tree, node = heapq.heappop(queue)
            row = margins[tree]
            while node < inner:
                margin = row[node]
                near = 2 * node + 1 + (margin > 0)
                heapq.heappush(queue, (max(crossed, abs(margin)), tree, 4 * node + 3 - near))
                node = near
            opened.append((tree, node - inner))
            held += self.shares[tree, node - inner]
        return opened


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _lifted(vectors: np.ndarray, longest: float) -> np.ndarray:
    """One more component that makes all vectors equally long."""
    rest = np.sqrt(np.maximum(longest ** 2 - (vectors ** 2).sum(axis=1), 0.0))
    return np.c_[vectors, rest]


def _asked(vectors: np.ndarray, longest: float) -> np.ndarray:
    """Queries as long as the vectors; their last component is 0."""
    return np.c_[vectors * (longest / np.linalg.norm(vectors, axis=1, keepdims=True)), np.zeros(len(vectors))]


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, v, h1, h2): rows that take part, each once, with a key of their vector."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).filter(
        F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))
    keyed = rows.select("vec_id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v")).withColumns(
        {"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), F.col("v"))})
    return keyed.dropDuplicates(["vec_id", "h1", "h2"])


def _placed(forest, longest: float, copies: int, chunks: int):
    trees = len(forest.value.cuts)

    def place(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            leaves = forest.value.leaf_of(_lifted(_matrix(batch.column("v")), longest))
            n = batch.num_rows
            chunk = (batch.column("h2").to_numpy() % chunks).astype(np.int32)
            for tree in range(trees):
                for block in range(copies):
                    yield pa.record_batch({
                        "tree": pa.array(np.full(n, tree, np.int32)), "leaf": pa.array(leaves[:, tree].astype(np.int32)),
                        "chunk": pa.array(chunk), "block": pa.array(np.full(n, block, np.int32)),
                        "v": batch.column("v"), "ids": batch.column("ids")})

    return place


def _probing(forest, longest: float, copies: int, chunks: int):
    def probe(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                margins = forest.value.margins(_asked(_matrix(part.column("v")), longest)).tolist()
                found = [forest.value.probes(m) for m in margins]
                rows = np.repeat(np.arange(part.num_rows), [len(f) * chunks for f in found])
                tree, leaf = np.array([pair for f in found for pair in f for _ in range(chunks)], np.int32).reshape(-1, 2).T
                chunk = np.concatenate([np.tile(np.arange(chunks, dtype=np.int32), len(f)) for f in found])
                part = part.take(pa.array(rows))
                yield pa.record_batch({
                    "tree": pa.array(tree), "leaf": pa.array(leaf), "chunk": pa.array(chunk),
                    "block": pa.array((part.column("h2").to_numpy() % copies).astype(np.int32)),
                    "h1": part.column("h1"), "h2": part.column("h2"), "v": part.column("v")})

    return probe


def _best(k: int):
    """Exact products of one leaf's vectors with its queries; the best of each query."""
    def rank(asked: pa.Table, held: pa.Table) -> pa.Table:
        schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.float64()))])
        if not asked.num_rows or not held.num_rows:
            return schema.empty_table()
        asked, held = asked.combine_chunks(), held.combine_chunks()
        vectors, wanted = _matrix(held.column("v").chunk(0)), _matrix(asked.column("v").chunk(0))
        members, last = held.column("ids").to_pylist(), min(k, held.num_rows) - 1
        longest = np.linalg.norm(vectors, axis=1).max()
        ids, scores = [], []
        for at in range(0, len(wanted), 256):
            rough = wanted[at:at + 256] @ vectors.T
            # All that may tie with the last of the best, up to the rounding of products, are compared exactly.
            least = -np.partition(-rough, last, axis=1)[:, last] - MARGIN * longest * np.linalg.norm(wanted[at:at + 256], axis=1)
            for one, near, cut in zip(wanted[at:at + 256], rough, least, strict=True):
                rows = np.flatnonzero(near >= cut)
                exact = (vectors[rows] * one).sum(axis=1)
                pairs = sorted((-s, i) for s, r in zip(exact.tolist(), rows.tolist(), strict=True) for i in members[r])[:k]
                ids.append([i for _, i in pairs])
                scores.append([-s for s, _ in pairs])
        return pa.table([asked.column("h1"), asked.column("h2"), pa.array(ids, pa.list_(pa.int64())),
                         pa.array(scores, pa.list_(pa.float64()))], schema=schema)

    return rank


def _merged(k: int):
    """The best of all leaves of one query; at most trees x leaves short lists."""
    def merge(lists: pa.Table) -> pa.Table:
        found = sorted({(-s, i) for ids, scores in zip(lists.column("ids").to_pylist(), lists.column("scores").to_pylist(), strict=True)
                        for i, s in zip(ids, scores, strict=True)})[:k]
        return pa.table({"h1": lists.column("h1")[:1], "h2": lists.column("h2")[:1],
                         "found": pa.array([[{"vec_id": i, "score": -s} for s, i in found]],
                                           pa.list_(pa.struct([("vec_id", pa.int64()), ("score", pa.float64())])))})

    return merge


def nearest(vectors: DataFrame, asks: Column, k: int = NEIGHBOURS, vec_id: str = "vec_id", vector: str = "embedding",
            budget: float | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows for which ``asks`` holds (a condition on ``vec_id``)."""
    spark = vectors.sparkSession
    rows = usable(vectors, vec_id, vector)
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if sizes is None:
        return empty
    rows = stored(rows.filter(F.size("v") == sizes["d"]), "vectors")
    smallest = W.partitionBy("h1", "h2").orderBy("vec_id")
    distinct = stored(rows.withColumn("nth", F.row_number().over(smallest)).filter(F.col("nth") <= k + 1)
                      .groupBy("h1", "h2").agg(F.first("v").alias("v"), F.sort_array(F.collect_list("vec_id")).alias("ids")),
                      "distinct-vectors")
    squared = F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x)
    count, longest = distinct.agg(F.count(F.lit(1)), F.sqrt(F.max(squared))).first()
    asking = rows.filter(asks)
    asked = stored(asking.groupBy("h1", "h2").agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("n")), "queries")
    n_asked = asked.count()
    if not n_asked:
        return empty

    draw = F.pmod(F.col("h1"), F.lit(1 << 40)) < F.lit(min(1.0, SAMPLE / count) * float(1 << 40))
    sample = distinct.filter(draw).select("h1", "v").toArrow().sort_by("h1")
    sample = _matrix(sample.column("v").combine_chunks()) if sample.num_rows else np.zeros((1, sizes["d"]))
    leaves = min(max(LEAVES, count // LEAF_ROWS), MOST_LEAVES, max(1, count // LEAST_LEAF), max(1, len(sample) // 16))
    forest = spark.sparkContext.broadcast(Forest.fit(_lifted(sample, longest), leaves))
    chunks, blocks = max(1, -(-count // (leaves * CHUNK))), max(1, -(-n_asked // QUERY_CHUNK))

    held = distinct.select("h2", "v", "ids").mapInArrow(
        _placed(forest, longest, blocks, chunks), "tree int, leaf int, chunk int, block int, v array<double>, ids array<long>")
    probes = asked.select("h1", "h2", "v").mapInArrow(
        _probing(forest, longest, blocks, chunks), "tree int, leaf int, chunk int, block int, h1 long, h2 long, v array<double>")
    key = ["tree", "leaf", "chunk", "block"]
    ranked = probes.groupBy(*key).cogroup(held.groupBy(*key)).applyInArrow(
        lambda a, b: _best(k + 1)(a, b), "h1 long, h2 long, ids array<long>, scores array<double>")
    merged = ranked.groupBy("h1", "h2").applyInArrow(
        lambda t: _merged(k + 1)(t), "h1 long, h2 long, found array<struct<vec_id: long, score: double>>")
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    answers = asking.select(F.col("vec_id").alias("query_id"), "h1", "h2").join(merged, ["h1", "h2"]).select(
        "query_id", F.posexplode(others).alias("at", "hit"))
    return answers.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"),
                          F.col("hit.score").alias("score"))


@query("op3_neighbours")
def op3_neighbours(spark, sf_dir):
    """The 20 nearest of all vectors for every vector whose identifier is divisible by 20."""
    return nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
