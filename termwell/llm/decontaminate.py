"""Benchmark passages in documents, re-parameterised ones too.

A text becomes two sequences: its words in lower case, and its template, in which
numbers, names (words with one leading capital) and units give way to typed
placeholders. Windows of five of an item's words or template tokens are hashed
and looked up among the windows of every document. An item leaks into a document
where the share of its windows that stand together there, over a stretch little
longer than the item, reaches the threshold. For a template the slots must agree
as well: what stands for a value of the item stands for it throughout.

All windows count. Looked up are those windows of a template that hold ``LEAST_LITERAL``
words besides placeholders, and the next richest until they are more than the windows that may
differ, so that one of them is met wherever the threshold is reached; around
them the other windows are compared. A template without a word is no template.

Besides, ``Block.all_leaks`` reports what stands in a document though the item's share there is
too small: runs of ``RUN_WORDS`` consecutive words of an item (kind ``excerpt``) and items of
fewer than five words at any place (kind ``short``).

The benchmark is broadcast in blocks of at most ``BLOCK_WORDS`` words (or one item);
documents are read once and neither shuffled nor cut.

Defined cases: a null text or item has no words and matches nothing; an item of
fewer than five words is of kind ``words`` where a text has just these words, else of kind
``short``, which tells too little to drop a document; an empty benchmark leaks nowhere; repeated
items and documents are reported each; an input column ``leaks`` is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termwell.llm.common import hash_sums, mixed, read_table, shingle_hashes, span_hashes, stored, word_hashes, word_spans
from termwell.llm.registry import query

WINDOW = 5
THRESHOLD = 0.8
LEAST_LITERAL = 3
LEAST_CONSISTENT = 0.8
SLACK = 1.25
BLOCK_WORDS = 2_000_000
RUN_WORDS = 13

# Words that stand for numbers and units of measure.
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
    "eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half dozen"
).split()
UNIT_WORDS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ounce ounces pound pounds "
    "ton tons ml l liter liters litre litres gallon gallons cup cups second seconds minute minutes hour hours day days week "
    "weeks month months year years cent cents dollar dollars euro euros percent degree degrees meter meters metre metres "
    "kilometer kilometers kilometre kilometres mph kmh watt watts volt volts"
).split()

NUMBER, NAME, UNIT = (np.uint64(k) for k in (1, 2, 3))
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_JOINS = np.isin(np.arange(256), np.frombuffer(b".,:/", np.uint8))
_numbers = np.sort(word_hashes(" ".join(NUMBER_WORDS)))
_units = np.sort(word_hashes(" ".join(UNIT_WORDS)))
_PUNCTUATION = dict.fromkeys([*range(0x2000, 0x2070), 0xA0, 0xA1, 0xAB, 0xB7, 0xBB, 0xBF, 0x3000, 0x3001, 0x3002, 0xFF0C], " ")


def _among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    at = np.searchsorted(table, values)
    return table[np.minimum(at, len(table) - 1)] == values if len(table) else np.zeros(len(values), bool)


def _lowered(text: str, size: int) -> bytes:
    """Lower case with the same number of bytes, so that positions agree."""
    lower = text.lower().encode()
    if len(lower) == size:
        return lower
    return "".join(low if len((low := c.lower()).encode()) == len(c.encode()) else c for c in text).encode()


@dataclass(frozen=True)
class Tokens:
    """A text as words and as a template; ``codes`` are 1 to 3 for placeholders, ``values`` what they stand for."""

    words: np.ndarray
    codes: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, text: str | None) -> Tokens:
        text = (text or "").translate(_PUNCTUATION) if text and not text.isascii() else text or ""
        raw = text.encode()
        data, lower = np.frombuffer(raw, np.uint8), np.frombuffer(_lowered(text, len(raw)), np.uint8)
        starts, ends = word_spans(data, _WORD)
        if not len(starts):
            none = np.zeros(0, np.uint64)
            return cls(none, none, none)
        sums = hash_sums(lower)
        words = span_hashes(sums, starts, ends)
        changed = np.r_[0, np.cumsum(data != lower)]
        digits = np.r_[0, np.cumsum((data >= 48) & (data <= 57))]
        lead = data[starts]
        first = starts + np.select([lead < 128, lead < 224, lead < 240], [1, 2, 3], 4)
        capital = (changed[np.minimum(first, ends)] > changed[starts]) & (changed[ends] - changed[starts] == 1) & (ends > first)
        number = (digits[ends] > digits[starts]) | _among(words, _numbers)
        kind = np.select([number, _among(words, _units), capital], [NUMBER, UNIT, NAME], np.uint64(0))
        # "1,250.5" is one number and "Ada Lovelace" one name.
        gap = np.r_[False, starts[1:] - ends[:-1] == 1]
        between = np.r_[np.uint8(0), data[ends[:-1]]]
        same = np.r_[False, kind[1:] == kind[:-1]]
        joined = gap & same & (((kind == NUMBER) & _JOINS[between]) | ((kind == NAME) & (between == 32)))
        heads = np.flatnonzero(~joined)
        tails = np.r_[heads[1:], len(starts)] - 1
        values = words if len(heads) == len(starts) else span_hashes(sums, starts[heads], ends[tails])
        codes = np.where(kind[heads] > 0, kind[heads], values)
        return cls(words, codes, values)

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the windows of words and of the template."""
        return shingle_hashes(self.words, WINDOW), mixed(shingle_hashes(self.codes, WINDOW) ^ np.uint64(0x5A5A))

    def seeds(self) -> np.ndarray:
        """Places of the template windows that are looked up."""
        if not len(self.codes):
            return np.zeros(0, np.int64)
        width = min(WINDOW, len(self.codes))
        literal = np.r_[0, np.cumsum(self.codes > 3)]
        held = literal[width:] - literal[:len(literal) - width]
        if not held.any():
            return np.zeros(0, np.int64)
        least = int((1.0 - THRESHOLD) * len(held) + 1e-9) + 1  # so many cannot all differ in a copy that counts
        order = np.argsort(-held, kind="stable")
        return np.sort(order[:max(least, int((held >= min(LEAST_LITERAL, width)).sum()))])


@dataclass(frozen=True)
class Block:
    """Windows of some items, sorted by hash: which item and where in it."""

    items: list
    tokens: list[Tokens]
    needed: np.ndarray  # per item: windows of words, windows of the template
    shapes: list  # per item: the hashes of its template windows in order, and their places
    hashes: np.ndarray
    owner: np.ndarray
    place: np.ndarray
    short: dict  # number of words: hashes of the items of so many words in order, and the items

    @classmethod
    def of(cls, rows: list[tuple[int, str | None]]) -> Block:
        tokens = [Tokens.of(text) for _, text in rows]
        hashes, owner, place, needed, shapes = [], [], [], [], []
        for k, t in enumerate(tokens):
            for side, found in enumerate(t.windows()):
                at = t.seeds() if side else np.arange(len(found))
                hashes.append(found[at])
                owner.append(np.full(len(at), 2 * k + side))
                place.append(at)
                needed.append(len(found))
                if side:
                    order = np.argsort(found, kind="stable")
                    shapes.append((found[order], order, len(at)))
        hashes, owner, place = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (hashes, owner, place))
        order = np.argsort(hashes, kind="stable")
        short = {}
        for width in range(1, WINDOW):
            items = [k for k, t in enumerate(tokens) if len(t.words) == width]
            named = np.array([shingle_hashes(tokens[k].words, width)[0] for k in items], np.uint64)
            if items:
                short[width] = (np.sort(named), np.array(items)[np.argsort(named, kind="stable")])
        return cls([i for i, _ in rows], tokens, np.array(needed), shapes, hashes[order].astype(np.uint64), owner[order], place[order], short)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_known"}

    @cached_property
    def _known(self) -> np.ndarray:
        """Flags by the low bits of the hashes: most windows of a text are told off by one look."""
        flags = np.zeros(1 << min(25, max(16, (16 * len(self.hashes)).bit_length())), bool)
        flags[(self.hashes & np.uint64(len(flags) - 1)).astype(np.int64)] = True
        return flags

    def leaks(self, text: str | None) -> list[dict]:
        """The items of the block that stand in the text."""
        doc = Tokens.of(text)
        windows = doc.windows()
        return self._whole(doc, windows, [self._hits(windows[side], side) for side in (0, 1)])

    def _hits(self, hashes: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the table and places in the document that agree."""
        none = np.zeros(0, np.int64)
        if not len(self.hashes):
            return none, none
        maybe = np.flatnonzero(self._known[(hashes & np.uint64(len(self._known) - 1)).astype(np.int64)])
        low = np.searchsorted(self.hashes, hashes[maybe], side="left")
        same = self.hashes[np.minimum(low, len(self.hashes) - 1)] == hashes[maybe]
        hit, low = maybe[same], low[same]
        if not len(hit):
            return none, none
        n = np.searchsorted(self.hashes, hashes[hit], side="right") - low
        which = np.repeat(low - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        at = np.repeat(hit, n)
        mine = self.owner[which] % 2 == side
        return which[mine], at[mine]

    def _whole(self, doc: Tokens, windows: tuple, hits: list) -> list[dict]:
        found: dict[int, dict] = {}
        for side, (which, at) in enumerate(hits):
            hashes = windows[side]
            for owner in np.unique(self.owner[which]).tolist():
                own = self.owner[which] == owner
                where, spot = self.place[which[own]], at[own]
                if side:
                    where, spot = self._surroundings(owner // 2, where, spot, hashes)
                leak = self._aligned(owner, side, where, spot, doc)
                item = owner // 2
                if leak and (item not in found or found[item]["share"] < leak["share"]):
                    found[item] = leak | {"item_id": self.items[item]}
        return [found[k] for k in sorted(found)]

    def _passages(self, words: np.ndarray, hits: tuple) -> list[dict]:
        """Long runs of words of items, and items of few words, wherever they stand in the text."""
        found: dict[int, dict] = {}
        which, at = hits
        if len(which) >= RUN_WORDS - WINDOW + 1:
            owner, place = self.owner[which], self.place[which]
            order = np.lexsort((at, at - place, owner))
            owner, place, at = owner[order], place[order], at[order]
            breaks = np.flatnonzero((np.diff(owner) != 0) | (np.diff(at - place) != 0) | (np.diff(at) != 1)) + 1
            starts = np.r_[0, breaks][:len(at)]
            runs = np.diff(np.r_[starts, len(at)])
            for k in np.flatnonzero(runs >= RUN_WORDS - WINDOW + 1).tolist():
                first, item = int(starts[k]), int(owner[starts[k]]) // 2
                share = float(runs[k] / self.needed[2 * item])
                if item not in found or found[item]["share"] < share:
                    found[item] = {"item_id": self.items[item], "kind": "excerpt", "share": share, "consistency": 1.0,
                                   "first_token": int(at[first]), "n_tokens": int(runs[k]) + WINDOW - 1}
        for width, (named, items) in self.short.items():
            if len(words) < width:
                continue
            hashes = shingle_hashes(words, width)
            low = np.searchsorted(named, hashes)
            hit = np.flatnonzero(named[np.minimum(low, len(named) - 1)] == hashes)
            _, earliest = np.unique(hashes[hit], return_index=True)
            for k in hit[earliest].tolist():
                for item in items[low[k]:np.searchsorted(named, hashes[k], side="right")].tolist():
                    found[item] = {"item_id": self.items[item], "kind": "short", "share": 1.0, "consistency": 1.0,
                                   "first_token": k, "n_tokens": width}
        return [found[k] for k in sorted(found)]

    def all_leaks(self, text: str | None) -> list[dict]:
        """``leaks``, and the passages of items that are not among them."""
        doc = Tokens.of(text)
        windows = doc.windows()
        hits = [self._hits(windows[side], side) for side in (0, 1)]
        whole = self._whole(doc, windows, hits)
        known = {leak["item_id"] for leak in whole}
        return whole + [passage for passage in self._passages(doc.words, hits[0]) if passage["item_id"] not in known]

    def _surroundings(self, item: int, place: np.ndarray, at: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All agreeing template windows of the item and the document near the seeds found."""
        shape, order, seeds = self.shapes[item]
        if seeds - len(np.unique(place)) > (1.0 - THRESHOLD) * len(shape) + 1e-9:
            return place[:0], at[:0]  # too many windows are surely missing
        reach = int(len(self.tokens[item].codes) * SLACK) + 1
        edge = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(edge, np.maximum(at - reach, 0), 1)
        np.add.at(edge, np.minimum(at + reach + 1, len(hashes)), -1)
        near = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        low, high = (np.searchsorted(shape, hashes[near], side=s) for s in ("left", "right"))
        n = high - low
        which = np.repeat(low - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        return order[which], np.repeat(near, n)

    def _aligned(self, owner: int, side: int, place: np.ndarray, at: np.ndarray, doc: Tokens) -> dict | None:
        """The stretch of the document with most of the item's windows, if it has enough that agree."""
        needed = int(self.needed[owner])
        if len(np.unique(place)) < THRESHOLD * needed:
            return None
        item = self.tokens[owner // 2]
        span = max(1, int(len(item.codes if side else item.words) * SLACK) - WINDOW + 1)
        best, low, counts, kinds = (0, 0, 0), 0, {}, 0
        order = np.argsort(at, kind="stable")
        place, at = place[order], at[order]
        where, spot = place.tolist(), at.tolist()
        for high in range(len(spot)):
            counts[where[high]] = counts.get(where[high], 0) + 1
            kinds += counts[where[high]] == 1
            while spot[high] - spot[low] >= span:
                counts[where[low]] -= 1
                kinds -= counts[where[low]] == 0
                low += 1
            if kinds > best[0]:
                best = (kinds, low, high + 1)
        share = best[0] / needed
        if share < THRESHOLD:
            return None
        if side:  # the stretch may be longer than what first shows all windows where a template repeats itself
            low, high = np.searchsorted(at, [at[best[2] - 1] - span + 1, at[best[1]] + span])
            place, at = place[low:high], at[low:high]
            # There it agrees at several places, too; each window counts at the likeliest.
            shift, n = np.unique(at - place, return_counts=True)
            off = np.abs(at - place - shift[n.argmax()])
            close = off < max(1, span - needed + 1)
            place, at, off = place[close], at[close], off[close]
            order = np.lexsort((off, at))
            likeliest = order[np.unique(at[order], return_index=True)[1]]
            place, at = place[likeliest], at[likeliest]
            share = len(np.unique(place)) / needed
            if share < THRESHOLD:
                return None
        else:
            place, at = place[best[1]:best[2]], at[best[1]:best[2]]
        agree = self._agreement(item, doc, place, at) if side else 1.0
        if agree < LEAST_CONSISTENT:
            return None
        return {"kind": "template" if side else "words", "share": share, "consistency": agree,
                "first_token": int(at.min()), "n_tokens": int(at.max() - at.min()) + WINDOW}

    @staticmethod
    def _agreement(item: Tokens, doc: Tokens, place: np.ndarray, at: np.ndarray) -> float:
        """Share of slots whose value in the document is the one that most often stands for the item's value."""
        width = min(WINDOW, len(item.codes))
        pairs = np.unique(np.stack([(place[:, None] + np.arange(width)).ravel(), (at[:, None] + np.arange(width)).ravel()]), axis=1)
        slot = item.codes[pairs[0]] <= 3
        mine, theirs = item.values[pairs[0][slot]], doc.values[pairs[1][slot]]
        if not len(mine):
            return 1.0
        both, n = np.unique(np.stack([mine, theirs]), axis=1, return_counts=True)
        return sum(int(n[both[0] == value].max()) for value in np.unique(mine)) / len(mine)


LEAK_TYPE = T.ArrayType(T.StructType([
    T.StructField("item_id", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("share", T.DoubleType()),
    T.StructField("consistency", T.DoubleType()), T.StructField("first_token", T.LongType()),
    T.StructField("n_tokens", T.LongType())]))
_ARROW_LEAKS = pa.list_(pa.struct([("item_id", pa.int64()), ("kind", pa.string()), ("share", pa.float64()),
                                   ("consistency", pa.float64()), ("first_token", pa.int64()), ("n_tokens", pa.int64())]))


def _lookup(block):
    def leaks(texts: pa.Array) -> pa.Array:
        return pa.array([block.value.all_leaks(text) for text in texts.to_pylist()], _ARROW_LEAKS)

    return F.arrow_udf(leaks, LEAK_TYPE)


def with_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
               item_text: str = "text") -> DataFrame:
    """The documents with ``leaks``: the benchmark items found in each."""
    spark = docs.sparkSession
    items = stored(benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text"),
                                    F.size(F.split(F.coalesce(F.col(item_text), F.lit("")), r"\s+")).alias("n")), "benchmark")
    total = items.agg(F.sum("n")).first()[0] or 0
    blocks = -(-total // BLOCK_WORDS)
    found = []
    for number in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == number).select("item_id", "text")
        block = Block.of(sorted(((r["item_id"], r["text"]) for r in part.collect()),
                                key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")))
        found.append(_lookup(spark.sparkContext.broadcast(block))(F.col(text)))
    none = F.array().cast(LEAK_TYPE)
    return docs.withColumn("leaks", F.concat(none, *found) if found else none)


@query("op10_decontamination")
def op10_decontamination(spark, sf_dir):
    """Every benchmark item found in a document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    leaks = with_leaks(docs, read_table(spark, sf_dir, "benchmark"))
    return leaks.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")
