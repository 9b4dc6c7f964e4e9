"""Dense retrieval, rank fusion and the vector table."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from termwell.operators import bm25
from termwell.session import durable

# Ship the kernels with the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

RRF_K = 60
QUERY_VECTOR_ROWS = 32_768  # queries that meet a slice at once
SLICE_ROWS = 65_536  # vectors of a cell that meet them
QUERY_BLOCK = 512
PRODUCTS = 1 << 23  # cosines computed at once
CENTRES = 1_024
CELL_ROWS = 32_768  # a query travels once to each cell it views, a vector once to each block of queries
CENTRE_SAMPLE = 16
CENTRE_ROUNDS = 4
SLACK = 2e-6  # covers the rounding of scores


def norm(vector: Column) -> Column:
    squares = F.transform(vector, lambda x: x.cast("double") * x.cast("double"))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda total, x: total + x))


def l2_normalised(vector: Column) -> Column:
    """The vector at length one; a zero vector stays zero."""
    length = norm(vector)
    divisor = F.when(length == 0, F.lit(1e-9)).otherwise(length)
    return F.transform(vector, lambda x: x.cast("double") / divisor)


def _unit_rows(column: pa.Array, count: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    matrix = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(count, -1)
    lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(lengths == 0, 1e-9, lengths)


def _best_of(ids: np.ndarray, cosines: np.ndarray, reached: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns' ids and rounded scores of the k best of each row (highest score, then lowest id), of those that
    reach a score (-2: any); rounds and sorts only what can be among them."""
    least = reached - SLACK
    any_ = np.flatnonzero(reached < -1)
    if len(any_) and cosines.shape[1] > k:
        least[any_] = -np.partition(-cosines[any_], k - 1, axis=1)[:, k - 1] - SLACK
    among = cosines >= least[:, None]
    if cosines.shape[1] <= k:
        among[any_] = True
    rows, columns = np.nonzero(among)
    scores = np.round(cosines[rows, columns], 6)
    order = np.lexsort((ids[columns], -scores, rows))
    rows, columns, scores = rows[order], columns[order], scores[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    kept = place < k
    return rows[kept], ids[columns[kept]], scores[kept]


@dataclass
class Cells:
    """Centres of the cells, how many vectors each holds and the widest angle between them and it.

    The last cell holds the vectors of length zero, whose cosine is 0 with any query.
    """

    centres: np.ndarray
    counts: np.ndarray
    angles: np.ndarray

    def bounds(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest cosine a query can have with the vectors of each cell, by the triangle inequality of angles."""
        away = np.arccos(np.clip(units @ self.centres.T, -1, 1)) if len(self.centres) else np.zeros((len(units), 0))
        least, most = np.cos(np.minimum(away + self.angles, np.pi)), np.cos(np.maximum(away - self.angles, 0))
        zeros = np.zeros((len(units), 1))
        empty = np.r_[self.counts[:-1] == 0, self.counts[-1] == 0]
        return np.c_[least, zeros], np.where(empty, -2.0, np.c_[most, zeros])


def _centres(vectors: DataFrame, count: int) -> np.ndarray:
    """Centres of clusters in a bounded sample, as many as asked for or fewer."""
    drawn = vectors.orderBy(F.xxhash64("chunk_id")).limit(count * CENTRE_SAMPLE).select("v").toArrow()
    units = _unit_rows(drawn.column("v"), drawn.num_rows) if drawn.num_rows else np.zeros((0, 1))
    units = units[np.any(units != 0, axis=1)]
    centres = units[:count]
    for _ in range(CENTRE_ROUNDS):
        nearest = (units @ centres.T).argmax(axis=1) if len(centres) else np.zeros(0, int)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, units)
        lengths = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(lengths > 0, sums / np.where(lengths > 0, lengths, 1), centres)
    return centres


def _placed(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """``(chunk_id, u, cell, cosine)``: unit vectors with their nearest centre."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            units, centres = _unit_rows(batch.column("v"), batch.num_rows), shared.value
            zero = ~np.any(units != 0, axis=1)
            near = units @ centres.T if len(centres) else np.zeros((len(units), 1))
            cell = np.where(zero, len(centres), near.argmax(axis=1))
            yield pa.RecordBatch.from_pydict({
                "chunk_id": batch.column("chunk_id"), "u": _as_lists(units), "cell": cell.astype(np.int32),
                "cosine": np.where(zero, 1.0, near.max(axis=1))})

    id_type = vectors.schema["chunk_id"].dataType.simpleString()
    return vectors.select("chunk_id", "v").mapInArrow(place, f"chunk_id {id_type}, u array<double>, cell int, cosine double")


def _as_lists(matrix: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]), pa.array(np.ascontiguousarray(matrix).ravel()))


def _views(queries: DataFrame, cells: Cells, k: int, first_only: bool = False) -> DataFrame:
    """``(query_id, u, reached, cell, first)``: each query with every cell that may hold one of its k best.

    The cells in which k vectors are sure to have a cosine of some value rule out those that cannot reach it. Of the
    rest, the most promising ones that hold k vectors together come ``first``. Where the queries know the score
    ``reached`` there, only the other cells that may hold a better one are viewed.
    """
    later = "reached" in queries.columns
    shared = queries.sparkSession.sparkContext.broadcast(cells)

    def view(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, QUERY_BLOCK):
                part = batch.slice(low, QUERY_BLOCK)
                units = _unit_rows(part.column("v"), part.num_rows)
                least, most = shared.value.bounds(units)
                counts = shared.value.counts
                safe = np.argsort(-least, axis=1, kind="stable")
                enough = np.cumsum(counts[safe], axis=1) >= k
                sure = np.where(enough.any(axis=1), least[np.arange(len(units)), safe[np.arange(len(units)), enough.argmax(axis=1)]], -1.0)
                hopeful = np.argsort(-most, axis=1, kind="stable")
                before = np.cumsum(counts[hopeful], axis=1) - counts[hopeful]
                first = np.zeros(most.shape, bool)
                np.put_along_axis(first, hopeful, before < k, axis=1)
                wanted = (most > -2) & ((most >= sure[:, None] - SLACK) | first)
                reached = np.full(len(units), -2.0)
                if later:
                    reached = part.column("reached").fill_null(-2.0).to_numpy(zero_copy_only=False)
                    wanted &= ~first & (most + SLACK >= reached[:, None])
                rows, cell = np.nonzero(wanted & first if first_only else wanted)
                yield pa.RecordBatch.from_pydict({
                    "query_id": part.column("query_id").take(pa.array(rows)), "u": _as_lists(units).take(pa.array(rows)),
                    "reached": reached[rows], "cell": cell.astype(np.int32), "first": first[rows, cell]})

    id_type = queries.schema["query_id"].dataType.simpleString()
    return queries.mapInArrow(view, f"query_id {id_type}, u array<double>, reached double, cell int, first boolean")


def _matrix(column: pa.ChunkedArray, count: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(count, -1)


def _met(placed: DataFrame, views: DataFrame, counts: np.ndarray, k: int, rows: int) -> DataFrame:
    """The k best of each query in each part of the grid: slices of cells against blocks of the queries that view them."""
    spark = placed.sparkSession
    viewed = {r["cell"]: r["n"] for r in views.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per cell at most
    if not viewed:
        viewed = {0: 0}
    sizes = F.broadcast(spark.createDataFrame(
        [(int(c), int(counts[c]) // SLICE_ROWS + 1, n // rows + 1) for c, n in viewed.items()], "cell int, slices long, blocks long"))
    left = placed.join(sizes, "cell").select(
        "cell", F.pmod(F.xxhash64("chunk_id"), F.col("slices")).alias("slice"), F.explode(F.expr("sequence(0L, blocks - 1)")).alias("block"), "chunk_id", "u")
    right = views.join(sizes, "cell").select(
        "cell", F.explode(F.expr("sequence(0L, slices - 1)")).alias("slice"), F.pmod(F.xxhash64("query_id"), F.col("blocks")).alias("block"), "query_id", "u", "reached")
    keys = ["cell", "slice", "block"]
    query_type, id_type = (df.schema[c].dataType.simpleString() for df, c in ((views, "query_id"), (placed, "chunk_id")))
    empty = pa.table({"query_id": pa.array([], to_arrow_type(views.schema["query_id"].dataType)),
                      "chunk_id": pa.array([], to_arrow_type(placed.schema["chunk_id"].dataType)), "score": pa.array([], pa.float64())})

    def meet(stored: pa.Table, asked: pa.Table) -> pa.Table:
        if not stored.num_rows or not asked.num_rows:
            return empty
        units, names = _matrix(stored.column("u"), stored.num_rows), stored.column("chunk_id").combine_chunks()
        ids = np.asarray(names.to_pylist())
        matrix, reached, found = _matrix(asked.column("u"), asked.num_rows), asked.column("reached").to_numpy(), []
        step = max(1, min(QUERY_BLOCK, PRODUCTS // len(units)))
        for low in range(0, len(matrix), step):
            row, owner, score = _best_of(ids, matrix[low:low + step] @ units.T, reached[low:low + step], k)
            found.append(pa.table({"query_id": asked.column("query_id").take(pa.array(low + row)),
                                   "chunk_id": pa.array(owner.tolist(), names.type), "score": pa.array(score)}))
        return pa.concat_tables(found)

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, f"query_id {query_type}, chunk_id {id_type}, score double")


def dense_views(vectors: DataFrame, queries: DataFrame, k: int, cell_rows: int = CELL_ROWS,
                rows: int = QUERY_VECTOR_ROWS) -> tuple[DataFrame, DataFrame, DataFrame, Cells]:
    """The grid of a search: placed vectors, views of the first cells with what they found, and the views still needed."""
    known = vectors.select("chunk_id", "v").filter("v IS NOT NULL")
    asked = queries.select("query_id", "v").filter("v IS NOT NULL")
    centres = _centres(known, min(CENTRES, known.count() // cell_rows + 1))
    placed = durable(_placed(known, centres))
    counts, angles = np.zeros(len(centres) + 1, np.int64), np.zeros(len(centres))
    for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("cosine").alias("c")).collect():  # a row per cell
        counts[r["cell"]] = r["n"]
        if r["cell"] < len(centres):
            angles[r["cell"]] = np.arccos(np.clip(r["c"], -1, 1)) + SLACK
    cells = Cells(centres, counts, angles)
    found = durable(_met(placed, _views(asked, cells, k, first_only=True), counts, k, rows))
    reached = bm25.best(found, k).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("reached")).filter(
        F.col("n") == k).select("query_id", "reached")
    return placed, found, _views(asked.join(reached, "query_id", "left"), cells, k), cells


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int, rows: int = QUERY_VECTOR_ROWS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """The k chunks with the highest cosine per query, exact.

    ``vectors(chunk_id, v)`` are placed in cells around centres found in a bounded sample. Each of the
    ``queries(query_id, v)`` looks first into the cells that promise most, which gives the score its k-th hit
    reaches at least; cells whose widest angle rules out a better score are skipped. Cells and queries meet by
    key, in slices and blocks of bounded size. Null vectors take no part.
    """
    placed, found, more, cells = dense_views(vectors, queries, k, cell_rows, rows)
    if len(cells.centres) > 1 or cells.counts[-1]:
        found = found.unionByName(_met(placed, more, cells.counts, k, rows))
    return bm25.best(found, k)


def rrf_merge(ranked: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of ``(query_id, chunk_id, rank)`` lists."""
    lists = None
    for hits in ranked:
        part = hits.select("query_id", "chunk_id", "rank")
        lists = part if lists is None else lists.unionByName(part)
    return lists.groupBy("query_id", "chunk_id").agg(
        F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score")
    )


def hybrid_topk(index: bm25.Index, queries: DataFrame, vectors: DataFrame | None = None,
                query_vectors: DataFrame | None = None, k: int = bm25.TOP_K,
                min_score: float = bm25.MIN_SCORE) -> DataFrame:
    """Best k chunks by BM25 and cosine together; BM25 alone without vectors.

    Each side contributes its best 2k. The text side only holds chunks that
    share a term with the query.
    """
    if vectors is None or query_vectors is None:
        return bm25.bm25_topk(index, queries, k, min_score)
    by_text = bm25.best(bm25.bm25_scores(index, queries).filter(F.col("score") > 0), 2 * k)
    by_vector = dense_topk(vectors, query_vectors, 2 * k)
    merged = bm25.best(rrf_merge([by_text, by_vector]), k)
    return bm25.with_norm(merged).filter(F.col("score") >= min_score)


def write_vectors(vectors: DataFrame, path: str) -> None:
    """Store ``(chunk_id, v)`` with single-precision vectors."""
    vectors.select("chunk_id", F.col("v").cast("array<float>").alias("v")).write.mode("overwrite").parquet(path)


def vector_lookup(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    """Vectors of the given chunk ids; ids without a vector are left out."""
    return ids.select("chunk_id").distinct().join(vectors, "chunk_id")


def missing_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunk ids that still need a vector."""
    return chunks.select("chunk_id").distinct().join(vectors.select("chunk_id"), "chunk_id", "left_anti")


def vector_matrix(chunks: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """One vector per chunk: the stored one, or zeros where there is none yet."""
    zeros = F.array_repeat(F.lit(0.0), dim)
    stored = vectors.select("chunk_id", F.col("v").cast("array<double>").alias("v"))
    return chunks.select("chunk_id").distinct().join(stored, "chunk_id", "left").select(
        "chunk_id", F.coalesce("v", zeros).alias("v"), F.col("v").isNotNull().alias("reused")
    )
