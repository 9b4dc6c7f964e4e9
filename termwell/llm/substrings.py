"""Exact removal of repeated passages with FM-indexes.

Every window of ``WINDOW`` words that also starts earlier (in a smaller document, or
further ahead in the same one) is repeated; the words it covers are removed.

Windows are dealt to shards by their anchor, the smallest hash among the
``ANCHOR``-word strings inside a window: equal windows have equal anchors, so they meet in
one shard, and neighbouring windows share an anchor and travel together as one
segment. Only segments whose anchor stands twice in the corpus can hold a
repeated window; a filter of those anchors, of bounded size, keeps nearly all others in their
documents. Equal segments are merged, with their first place. Each shard indexes its distinct segments: a suffix
order over words, its Burrows-Wheeler transform in a wavelet matrix of packed bits with
block counts. The segments are then streamed through backward search: the match
that ends at a word grows to the left while the index holds it, and where it reaches
the threshold of a window its interval names all places of the window; the
first of them stays. A segment that stands again elsewhere is repeated there as a whole.

Shards hold about ``SHARD_WORDS`` words. An anchor with more than ``HEAVY`` distinct segments is
dealt out further, window by window, by the hash of the whole window.

Defined cases: a null text has no words; rows with equal doc_id are one document, so
a repeated row repeats nothing, and spans found in one of several texts under a doc_id
are removed from all of them; a null doc_id comes after all others; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termwell.llm.common import bit_filter, may_hold, mixed, powers_of, read_table, shingle_hashes, small_batches, stored, word_hashes
from termwell.llm.registry import query

WINDOW = 20
ANCHOR = 10
SHARD_WORDS = 500_000
HEAVY = 50_000
ANCHOR_BITS = 128  # of a filter per anchor that stands twice, as far as its size allows
LAST = (1 << 63) - 1


def anchored(words: np.ndarray, window: int = WINDOW, size: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring windows with one anchor: (anchor hash, first window, number of windows)."""
    count = len(words) - window + 1
    if count < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes = shingle_hashes(words, size)
    at = np.lib.stride_tricks.sliding_window_view(hashes, window - size + 1).argmin(axis=1) + np.arange(count)
    starts = np.r_[0, np.flatnonzero(np.diff(at)) + 1]
    return hashes[at[starts]].view(np.int64), starts, np.diff(np.r_[starts, count])


class Bits:
    """A packed bit vector with the number of ones ahead of every 64 bits."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[:len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.ahead = np.r_[0, np.cumsum(np.bitwise_count(self.words))].astype(np.int32)

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        block = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.ahead[block] + np.bitwise_count(self.words[block] & mask)


class FMIndex:
    """Backward search over a text of symbols; rows are sorted by their first ``2 ** ROUNDS`` symbols."""

    ROUNDS = 5

    def __init__(self, text: np.ndarray):
        rank = text.astype(np.int64)
        for k in (1 << r for r in range(self.ROUNDS)):
            after = np.zeros_like(rank)
            after[:-k] = rank[k:] + 1
            rank = np.unique(rank * (int(after.max()) + 1) + after, return_inverse=True)[1]
        self.order = np.argsort(rank, kind="stable")
        transform = text[self.order - 1].astype(np.int64)
        symbols = int(text.max()) + 1
        self.smaller = np.r_[0, np.cumsum(np.bincount(text, minlength=symbols))]
        self.levels: list[tuple[int, Bits, int]] = []
        for bit in range(max(1, (symbols - 1).bit_length()) - 1, -1, -1):
            ones = (transform >> bit & 1).astype(bool)
            self.levels.append((bit, Bits(ones), int(len(ones) - ones.sum())))
            transform = np.r_[transform[~ones], transform[ones]]
        self.base = self._down(np.zeros(symbols, np.int64), np.arange(symbols))

    def _down(self, at: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        for bit, bits, zeros in self.levels:
            ones = bits.ones(at)
            at = np.where(symbol >> bit & 1, zeros + ones, at - ones)
        return at

    def extended(self, at: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Interval bounds after putting a symbol in front of what is matched."""
        return self.smaller[symbol] + self._down(at, symbol) - self.base[symbol]

    def intervals(self, text: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows that begin with ``text[start:start + size]``, for all starts at once, by ``size`` backward steps.

        A match that only one row is left of is not extended further; its interval is empty.
        """
        low, high = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        active = np.arange(len(starts))
        lows, highs = low.copy(), np.full(len(starts), len(self.order), np.int64)
        for back in range(size - 1, -1, -1):
            symbol = text[starts[active] + back].astype(np.int64)
            bounds = self.extended(np.r_[lows, highs], np.r_[symbol, symbol])
            lows, highs = bounds[:len(active)], bounds[len(active):]
            several = highs - lows > 1
            active, lows, highs = active[several], lows[several], highs[several]
        low[active], high[active] = lows, highs
        return low, high


def repeated_windows(segments: list[list[bytes]], docs: np.ndarray, starts: np.ndarray,
                     window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(segment, window) pairs that also stand at an earlier place of some segment; places are (doc, start)."""
    number: dict[bytes, int] = {}
    flat: list[int] = []
    for words in segments:
        flat.extend([number.setdefault(word, len(number) + 1) for word in words])
        flat.append(0)
    text = np.array(flat, np.int32)
    sizes = np.array([len(words) for words in segments])
    heads = np.r_[0, np.cumsum(sizes + 1)[:-1]]
    per = np.maximum(sizes - window + 1, 0)
    segment = np.repeat(np.arange(len(segments)), per)
    offset = np.arange(per.sum()) - np.repeat(np.r_[0, np.cumsum(per)[:-1]], per)
    at = heads[segment] + offset
    index = FMIndex(text)
    low, high = index.intervals(text, at, window)
    several = np.flatnonzero(high > low)
    segment, offset, at, low, high = segment[several], offset[several], at[several], low[several], high[several]
    if not len(several):
        return segment, offset
    # Places in the order of the corpus; equal places get equal numbers.
    doc, start = docs[segment], starts[segment] + offset
    order = np.lexsort((start, doc))
    fresh = np.r_[True, (np.diff(doc[order]) != 0) | (np.diff(start[order]) != 0)]
    place = np.full(len(text), len(order) + 1, np.int64)
    place[at[order]] = np.cumsum(fresh)
    # All intervals are those of strings of one length: equal or apart.
    lows, which = np.unique(low, return_inverse=True)
    highs = np.zeros(len(lows), np.int64)
    highs[which] = high
    rows = np.r_[place[index.order], 0]
    first = np.minimum.reduceat(rows, np.stack([lows, highs], axis=1).ravel())[::2]
    again = first[which] < place[at]
    return segment[again], offset[again]


def _key(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _read(batches) -> Iterator[pa.RecordBatch]:
    """Per document its word count, the digest of its words and its anchors, those that repeat inside it twice."""
    for batch in batches:
        counts, digests, anchors = [], [], []
        for text in batch.column("text"):
            raw = (text.as_py() or "").encode()
            words = raw.split()
            counts.append(len(words))
            digests.append(_digest(words))
            once, times = np.unique(anchored(word_hashes(raw))[0], return_counts=True)
            anchors.append(np.r_[once, once[times > 1]])
        yield pa.record_batch({"doc_id": batch.column("doc_id"), "n_words": pa.array(counts, pa.int64()),
                               "whole": pa.array(digests, pa.string()),
                               "anchors": pa.array([a.tobytes() for a in anchors], pa.binary())})


def _anchor_rows(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for one in batch.column("anchors"):
            yield pa.record_batch({"anchor": pa.array(np.frombuffer(one.as_buffer(), np.int64))})


def _packed(wanted):
    """The texts of the documents in a filter."""
    def pack(batches) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            batch = batch.filter(pa.array(may_hold(wanted.value, batch.column("doc_id").to_numpy())))
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "packed": pa.array(
                [packer.compress((text.as_py() or "").encode()) for text in batch.column("text")], pa.binary())})

    return pack


SEGMENT = "anchor long, segment binary, doc_id long, start long, n long, words binary"


def sequence_keys(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """128 bits for each run of words, equal for equal runs, from running sums over the hashes of the words."""
    powers, inverses = powers_of(len(hashes) + 1)
    halves = []
    for turn in (np.uint64(0), np.uint64(0x5BD1E995)):
        sums = np.r_[np.uint64(0), np.cumsum(mixed(hashes ^ turn) * powers[:-1], dtype=np.uint64)]
        halves.append(mixed((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(np.uint64)))
    flat = np.stack(halves, axis=1).tobytes()
    return [flat[k:k + 16] for k in range(0, len(flat), 16)]


def _holding(shared):
    """The documents with an anchor that may stand twice."""
    def hold(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(one.as_buffer(), np.int64) for one in batch.column("anchors")]
            owner = np.repeat(np.arange(len(found)), [len(f) for f in found])
            held = np.unique(owner[may_hold(shared.value, np.concatenate(found))]) if found else owner
            yield pa.record_batch({"doc_id": batch.column("doc_id").take(pa.array(held))})

    return hold


def _segments(shared, holding):
    """The segments of each document whose anchor may stand twice; other documents are not hashed again."""
    def segments(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(may_hold(holding.value, batch.column("doc_id").to_numpy())))
            anchors, keys, docs, begins, sizes, pieces = [], [], [], [], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                raw = (text.as_py() or "").encode()
                hashes = word_hashes(raw)
                anchor, start, n = anchored(hashes)
                kept = may_hold(shared.value, anchor)
                if not kept.any():
                    continue
                start, n = start[kept], n[kept]
                words = raw.split()
                whole, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
                last = start + n + WINDOW - 1
                low, high = np.r_[0, ends][start].tolist(), (ends[last - 1] - 1).tolist()
                pieces.extend([whole[a:b] for a, b in zip(low, high, strict=True)])
                keys.extend(sequence_keys(hashes, start, last))
                anchors.append(anchor[kept])
                begins.append(start)
                sizes.append(n)
                docs.append(np.full(len(n), doc, np.int64))
            if pieces:
                yield pa.record_batch({
                    "anchor": pa.array(np.concatenate(anchors)), "segment": pa.array(keys, pa.binary()),
                    "doc_id": pa.array(np.concatenate(docs)), "start": pa.array(np.concatenate(begins), pa.int64()),
                    "n": pa.array(np.concatenate(sizes), pa.int64()), "words": pa.array(pieces, pa.binary())})

    return segments


def _cut(batches) -> Iterator[pa.RecordBatch]:
    """Segments as single windows, each under the hash of its words."""
    for batch in batches:
        docs, starts, pieces = [], [], []
        for doc, start, text in zip(batch.column("doc_id").to_pylist(), batch.column("start").to_pylist(),
                                    batch.column("words").to_pylist(), strict=True):
            words = text.split()
            windows = range(len(words) - WINDOW + 1)
            docs.extend([doc] * len(windows))
            starts.extend([start + k for k in windows])
            pieces.extend([words[k:k + WINDOW] for k in windows])
        keys = [_key(p) for p in pieces]
        yield pa.record_batch({
            "anchor": pa.array([int.from_bytes(k[:8], "little", signed=True) for k in keys], pa.int64()),
            "segment": pa.array(keys, pa.binary()), "doc_id": pa.array(docs, pa.int64()), "start": pa.array(starts, pa.int64()),
            "n": pa.array([1] * len(keys), pa.int64()), "words": pa.array([b" ".join(p) for p in pieces], pa.binary())})


def _shard(rows: pa.Table) -> pa.Table:
    """Index one shard's segments and search it for them; spans (doc_id, low, high) of repeated words."""
    docs, starts = rows.column("doc_id").to_numpy(), rows.column("start").to_numpy()
    segment, offset = repeated_windows([text.split() for text in rows.column("words").to_pylist()], docs, starts)
    joins = np.r_[False, (np.diff(segment) == 0) & (np.diff(offset) == 1)][:len(segment)]
    first = np.flatnonzero(~joins)
    last = np.r_[first[1:], len(segment)] - 1 if len(first) else first
    low = starts[segment[first]] + offset[first]
    return pa.table({"doc_id": docs[segment[first]], "low": low, "high": low + offset[last] - offset[first] + WINDOW})


def _kept(batches) -> Iterator[pa.RecordBatch]:
    """Each text without its spans."""
    opener = zstandard.ZstdDecompressor()
    for batch in batches:
        counts, gone, texts = [], [], []
        for packed, spans in zip(batch.column("packed"), batch.column("spans").to_pylist(), strict=True):
            words = opener.decompress(packed.as_py()).split()
            keep = np.ones(len(words), bool)
            for span in spans:
                keep[span["low"]:span["high"]] = False
            counts.append(len(words))
            gone.append(int((~keep).sum()))
            texts.append(b" ".join([words[k] for k in np.flatnonzero(keep)]))
        yield pa.record_batch({"doc_id": batch.column("doc_id"), "n_words": pa.array(counts, pa.int64()),
                               "n_removed": pa.array(gone, pa.int64()), "kept": pa.array(texts, pa.binary())})


def _repeats(segments: DataFrame, heavy_above: int) -> DataFrame:
    """(doc_id, low, high): spans of repeated words in a table of segments, hot anchors dealt out further."""
    distinct = stored(segments.groupBy("segment").agg(
        F.min(F.struct("doc_id", "start")).alias("first"), F.count(F.lit(1)).alias("places"), F.first("anchor").alias("anchor"),
        F.first("n").alias("n"), F.first("words").alias("words")), "distinct-segments")
    firsts = distinct.filter("places > 1").select("segment", "first")
    again = segments.select("segment", "doc_id", "start", "n").join(firsts, "segment").filter(
        F.struct("doc_id", "start") > F.col("first")).select(
        "doc_id", F.col("start").alias("low"), (F.col("start") + F.col("n") + WINDOW - 1).alias("high"))

    pieces = distinct.select("anchor", "first.doc_id", "first.start", "words", "n")
    counts = pieces.groupBy("anchor").agg(F.count(F.lit(1)).alias("m"), F.sum(F.col("n") + WINDOW - 1).alias("size"))
    total, heaviest = counts.agg(F.sum("size"), F.max("m")).first()
    rest = None
    if (heaviest or 0) > heavy_above:
        heavy = counts.filter(F.col("m") > heavy_above).select("anchor")
        windows = stored(pieces.join(heavy, "anchor", "left_semi").select("doc_id", "start", "words").mapInArrow(_cut, SEGMENT), "windows")
        rest = _repeats(windows, LAST)  # equal windows are one segment now, and each has an anchor of its own
        pieces = pieces.join(heavy, "anchor", "left_anti")
    shards = max(1, -(-(total or 0) // SHARD_WORDS))
    found = pieces.select(F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard"), "doc_id", "start", "words").groupBy(
        "shard").applyInArrow(lambda rows: _shard(rows), "doc_id long, low long, high long")
    spans = again.unionByName(found)
    return spans if rest is None else spans.unionByName(rest)


def without_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", heavy_above: int = HEAVY) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256): every row after the words of repeated windows are removed.

    Documents without repeats are described where they are read; only texts that
    lose words are shuffled.
    """
    spark = df.sparkSession
    send = spark.sparkContext.broadcast
    docs = df.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("doc_id"), F.col(text).alias("text"))
    with small_batches(spark):
        read = stored(docs.mapInArrow(_read, "doc_id long, n_words long, whole string, anchors binary"), "read")
        anchors = read.select("anchors").mapInArrow(_anchor_rows, "anchor long")
        twice = stored(anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor"), "shared-anchors")
        shared = send(bit_filter(twice, "anchor", bits_per_key=ANCHOR_BITS))
        holding = read.select("doc_id", "anchors").mapInArrow(_holding(shared), "doc_id long")
        segments = stored(docs.mapInArrow(_segments(shared, send(bit_filter(holding, "doc_id", bits_per_key=ANCHOR_BITS))), SEGMENT), "segments")
        spans = stored(_repeats(segments, heavy_above), "spans")
        per_doc = stored(spans.groupBy("doc_id").agg(F.collect_set(F.struct("low", "high")).alias("spans")), "document-spans")
        texts = docs.mapInArrow(_packed(send(bit_filter(per_doc, "doc_id"))), "doc_id long, packed binary")
        cleaned = stored(texts.join(per_doc, "doc_id").mapInArrow(
            _kept, "doc_id long, n_words long, n_removed long, kept binary").select(
            "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")), "cleaned")
    untouched = read.join(per_doc.select("doc_id"), "doc_id", "left_anti").select(
        "doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("whole").alias("kept_sha256"))
    return cleaned.unionByName(untouched).withColumn("doc_id", F.expr(f"nullif(doc_id, {LAST}L)"))


@query("op5_substrings", r"""
    WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    windows AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 19), ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM docs WHERE len(w) >= 20)),
    again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM windows) WHERE k > 1),
    gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM again),
    words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM docs),
    kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
    FROM docs LEFT JOIN kept USING (doc_id)
""")
def op5_substrings(spark, sf_dir):
    """Every document without the passages that stand earlier."""
    return without_repeats(read_table(spark, sf_dir, "documents"))
