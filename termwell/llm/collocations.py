"""Phrases whose words stand together more often than their parts explain, by vertically partitioned suffix trees.

Texts are lower-cased (A-Z), split into pieces at punctuation and line ends, and pieces into words. All
suffixes of all pieces, cut after ``longest`` words, would make one tree whose nodes are the
phrases and whose leaf totals give their counts. It is built in parts that fit into memory:

1. Words are counted per language: the prefixes of one word. A prefix that begins more than a
   group's budget of suffixes is heavy; one further pass over the texts counts its extensions by
   a word, and so on. Heavy prefixes number at most (words / budget) per length.
2. Prefixes that are not heavy are packed into groups of about ``BUDGET`` suffixes. They are
   packed by cells of their hash, so the table that names a suffix's group has a bounded size
   whatever the number of words.
3. The texts are read once more. Suffixes are cut at words too rare to stand in any
   candidate, equal ones of a stretch of text are merged, and each goes to its group. A group
   builds its subtree alone: level by level from the leaves, whose totals add up to the counts of
   the nodes above. No group holds more rows than its suffixes, however often a word occurs.

``collocations`` then scores candidates (phrases of 2 to ``longest`` words that occur ``least`` times):
``floor(1000000 * a * a / (l * r))`` for the cut into parts of counts l and r that gives the least, ties to the
earlier cut, in 38-digit decimals. A candidate that stands inside a longer one with at least
``ABSORBED`` hundredths of its count is dropped. The ``top`` of each language stay.

Words are told apart as strings, never by their hashes; those only choose groups.

Defined cases: a null text is empty; a null language is ``und``; texts and repeated rows
count as often as they stand; words have no length limit; equal scores and counts are
ordered by the phrase's UTF-8 bytes; an empty table gives an empty result; the result has its own columns
only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termwell.llm.common import bit_filter, hash_sums, may_hold, mixed, read_table, small_batches, span_hashes, stored
from termwell.llm.registry import query
from termwell.operators.joins import lookup_join

LONGEST = 3
LEAST = 10
ABSORBED = 50
TOP = 2000
BUDGET = 1 << 19  # suffixes in a group
GROUPS = 1 << 22  # at most; beyond, groups grow
STRETCH = 1 << 22  # bytes of text handled at once
BATCH_ROWS = 1500  # texts handed to Python at once
UNKNOWN = "und"

BREAK = np.zeros(256, bool)
BREAK[[ord(c) for c in ".,;:!?\n\v\f\r"]] = True
INSIDE = ~BREAK
INSIDE[[0x20, 0x09]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """The words of some bytes: ``codes`` into ``distinct``, and whether the next word follows in the same piece.

    ``begins`` are places at which a piece starts in any case, because another text does.
    """

    def __init__(self, data: np.ndarray, begins: np.ndarray):
        inside = INSIDE[data]
        fresh = np.zeros(len(data) + 1, bool)
        fresh[begins] = True
        before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        starts = inside & (~before | fresh[:-1])
        self.starts = np.flatnonzero(starts)
        ends = np.flatnonzero(inside & (~after | fresh[1:])) + 1
        piece = np.cumsum(BREAK[data] | fresh[:-1])[self.starts]
        self.linked = np.r_[piece[1:] == piece[:-1], False] if len(piece) else np.zeros(0, bool)
        offsets = np.r_[0, np.cumsum(ends - self.starts)].astype(np.int64)
        words = pa.Array.from_buffers(
            pa.large_binary(), len(self.starts), [None, pa.py_buffer(offsets), pa.py_buffer(LOWER[data[inside]])])
        coded = words.dictionary_encode()
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.distinct = coded.dictionary

    def __len__(self) -> int:
        return len(self.codes)

    def nodes(self, at: np.ndarray, node: np.ndarray, upto: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Level by level the tree of the word runs that begin ``at`` and have ``upto`` words.

        ``node`` tells roots apart. Yields the places still deep enough, the number of the node of
        each, and one place per node.
        """
        for depth in range(int(upto.max()) if len(upto) else 0):
            deep = upto > depth
            at, node, upto = at[deep], node[deep], upto[deep]
            node = pd.factorize(node * (len(self.distinct) + 1) + self.codes[at + depth])[0]
            place = np.empty(int(node.max()) + 1, np.int64)
            place[node[::-1]] = at[::-1]
            yield at, node, place

    def phrases(self, at: np.ndarray, sizes: np.ndarray, end: bytes = b"") -> pa.Array:
        """The words that begin at each place, joined by a space."""
        longest = int(sizes.max()) if len(sizes) else 0
        parts = []
        for k in range(longest):
            there = np.minimum(at + k, len(self) - 1)
            parts.append(self.distinct.take(pa.array(self.codes[there], mask=sizes <= k)))
        if not parts:
            return pa.array([], pa.large_binary())
        space, nothing = pa.scalar(b" ", pa.large_binary()), pa.scalar(b"", pa.large_binary())
        joined = pc.binary_join_element_wise(*parts, space, null_handling="skip")
        return pc.binary_join_element_wise(joined, nothing, pa.scalar(end, pa.large_binary())) if end else joined


def _stretches(batches, size: int = STRETCH) -> Iterator[tuple[Words, np.ndarray, list[str]]]:
    """Words of some texts at a time, with the language number of each word and the languages; pieces stay whole."""
    for batch in batches:
        langs = batch.column("lang").dictionary_encode()
        names, of_text = langs.dictionary.to_pylist(), langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        texts = batch.column("text").cast(pa.large_string())
        places = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        low, end = (int(places[0]), int(places[-1])) if len(places) else (0, 0)
        while low < end:
            high = min(low + size, end)
            while high < end:  # go back to the last place where a piece or a text ends, else take more
                cuts = np.flatnonzero(BREAK[data[low:high]])
                cut = max(int(places[np.searchsorted(places, high, "right") - 1]), low + int(cuts[-1]) + 1 if len(cuts) else low)
                if cut > low:
                    high = cut
                    break
                high = min(high + size, end)
            begins = places[(places >= low) & (places < high)] - low
            words = Words(data[low:high], begins)
            yield words, of_text[np.searchsorted(places, words.starts + low, "right") - 1], names
            low = high


def _hashes(values: pa.Array) -> np.ndarray:
    """A hash of each string, the same in every batch."""
    values = values.cast(pa.large_binary())
    places = np.frombuffer(values.buffers()[1], np.int64)[values.offset:values.offset + len(values) + 1]
    data = np.frombuffer(values.buffers()[2] or b"", np.uint8)[:places[-1] if len(places) else 0]
    return span_hashes(hash_sums(data), places[:-1], places[1:])


def _routes(words: Words, lang: np.ndarray, names: list[str], longest: int) -> list[np.ndarray]:
    """For every number of words, the hash of language and prefix at each place (rubbish where a piece ends sooner)."""
    of_word = _hashes(words.distinct)[words.codes] if len(words) else np.zeros(0, np.uint64)
    first = mixed(_hashes(pa.array(names, pa.string()))[lang] * _FACTOR + of_word) if len(words) else of_word
    routes = [first]
    for k in range(1, longest):
        later = np.zeros_like(first)
        later[:-k] = first[k:]
        routes.append(mixed(routes[-1] * _FACTOR + later))
    return [route.view(np.int64) for route in routes]


def _member(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(keys), bool)
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)] == keys


def _reach(linked: np.ndarray, longest: int) -> np.ndarray:
    """Words from each place to the end of its run, ``longest`` at most."""
    reach = np.ones(len(linked), np.int64)
    open_ = np.ones(len(linked), bool)
    for k in range(longest - 1):
        following = np.zeros(len(linked), bool)
        following[:len(linked) - k] = linked[k:]
        open_ &= following
        reach += open_
    return reach


COUNTED = "lang string, phrase string, n long, route long"


def _prefix_rows(batches, size: int, heavy: np.ndarray | None, frequent: np.ndarray | None):
    """Counts of the prefixes of that many words, of several words those of frequent words under heavy prefixes."""
    for words, lang, names in _stretches(batches):
        routes = _routes(words, lang, names, size)
        at = np.flatnonzero(_reach(words.linked, size) >= size)
        if heavy is not None:
            at = at[_member(heavy, routes[size - 2][at])]
            at = at[may_hold(frequent, routes[0][at + size - 1])]
        if not len(at):
            continue
        *_, (_, node, place) = words.nodes(at, lang[at], np.full(len(at), size))
        yield pa.record_batch({
            "lang": pa.array(names, pa.string()).take(pa.array(lang[place])),
            "phrase": words.phrases(place, np.full(len(place), size)).cast(pa.string()),
            "n": pa.array(np.bincount(node)), "route": pa.array(routes[size - 1][place])})


LEAVES = "group int, depth int, lang string, leaves string, n array<long>"


def _leaf_rows(batches, longest: int, heavy: list[np.ndarray], frequent: np.ndarray, cells: np.ndarray):
    """The suffixes of frequent words with their numbers, a row for each group, prefix length and language."""
    shift = np.uint64(64 - (len(cells) - 1).bit_length())
    for words, lang, names in _stretches(batches):
        if not len(words):
            continue
        routes = _routes(words, lang, names, longest)
        known = may_hold(frequent, routes[0])
        reach = np.where(known, _reach(words.linked & known & np.r_[known[1:], False], longest), 0)
        depth, route, under = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), np.ones(len(words), bool)
        for size in range(1, longest):
            light = under & ~_member(heavy[size - 1], routes[size - 1])
            depth[light], route[light] = size, routes[size - 1][light]
            under &= ~light
        at = np.flatnonzero((depth > 0) & (reach > depth))
        if not len(at):
            continue
        leaf = np.full(len(words), -1, np.int64)
        root, first = lang[at], 0
        for size, (there, node, _) in enumerate(words.nodes(at, root, reach[at]), 1):
            ending = reach[there] == size
            leaf[there[ending]] = first + node[ending]
            first += int(node.max()) + 1
        number, _ = pd.factorize(leaf[at])
        place = np.empty(int(number.max()) + 1, np.int64)
        place[number[::-1]] = at[::-1]
        group = cells[(route[place].view(np.uint64) >> shift).astype(np.int64)]
        order = np.lexsort((lang[place], depth[place], group))
        place, count, group = place[order], np.bincount(number)[order], group[order]
        new = np.flatnonzero((np.diff(group) != 0) | (np.diff(depth[place]) != 0) | (np.diff(lang[place]) != 0)) + 1
        runs = np.r_[0, new, len(place)]
        lines = words.phrases(place, reach[place], b"\n").cast(pa.large_binary())
        bounds = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset:lines.offset + len(lines) + 1][runs]
        texts = pa.Array.from_buffers(pa.large_string(), len(runs) - 1, [None, pa.py_buffer(np.ascontiguousarray(bounds)), lines.buffers()[2]])
        yield pa.record_batch({
            "group": pa.array(group[runs[:-1]], pa.int32()), "depth": pa.array(depth[place[runs[:-1]]], pa.int32()),
            "lang": pa.array(names, pa.string()).take(pa.array(lang[place[runs[:-1]]])), "leaves": texts.cast(pa.string()),
            "n": pa.ListArray.from_arrays(pa.array(runs, pa.int32()), pa.array(count, pa.int64()))})


def _subtree(rows: pa.Table, least: int) -> pa.Table:
    """Nodes below a group's prefixes that occur often enough, with the totals of their leaves."""
    texts = rows.column("leaves").combine_chunks().cast(pa.large_string())
    counts = rows.column("n").combine_chunks()
    counts = counts.chunk(0) if isinstance(counts, pa.ChunkedArray) else counts
    texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts
    places = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    words = Words(np.frombuffer(texts.buffers()[2], np.uint8)[places[0]:places[-1]], np.zeros(1, np.int64))
    langs = rows.column("lang").combine_chunks().dictionary_encode()
    langs = langs.chunk(0) if isinstance(langs, pa.ChunkedArray) else langs
    sizes = counts.value_lengths().to_numpy(zero_copy_only=False)
    number = counts.flatten().to_numpy(zero_copy_only=False)
    root = np.repeat(langs.indices.to_numpy(zero_copy_only=False).astype(np.int64), sizes)
    depth = np.repeat(rows.column("depth").to_numpy(), sizes)
    at = np.flatnonzero(np.r_[True, ~words.linked[:-1]])
    line = np.full(len(words), -1, np.int64)
    line[at] = np.arange(len(at))
    ends = np.r_[at[1:], len(words)]
    out = []
    for size, (there, node, place) in enumerate(words.nodes(at, root, ends - at), 1):
        order = np.argsort(node, kind="stable")
        total = np.add.reduceat(number[line[there]][order], np.flatnonzero(np.r_[True, np.diff(node[order]) != 0]))
        kept = (total >= least) & (depth[line[place]] < size)
        place = place[kept]
        out.append(pa.table({
            "lang": langs.dictionary.take(pa.array(root[line[place]])).cast(pa.string()),
            "phrase": words.phrases(place, np.full(len(place), size)).cast(pa.string()),
            "size": pa.array(np.full(len(place), size), pa.int32()), "f": pa.array(total[kept], pa.int64())}))
    return pa.concat_tables(out)


def _packed(weights: np.ndarray, budget: int) -> np.ndarray:
    """The group of each cell: neighbouring cells share one while their weights fit."""
    groups = np.zeros(len(weights), np.int32)
    group, filled = 0, 0
    for cell in np.flatnonzero(weights).tolist():
        if filled and filled + weights[cell] > budget:
            group, filled = group + 1, 0
        filled += int(weights[cell])
        groups[cell] = group
    return groups


def phrase_counts(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, budget: int = BUDGET,
                  groups: int = GROUPS) -> tuple[DataFrame, DataFrame]:
    """All words with their counts, and all phrases of 2 to ``longest`` words that occur ``least`` times.

    ``docs`` has ``lang`` and ``text``. Both results are stored, with ``lang``, ``phrase`` and ``f``, the second with ``size`` too.
    """
    context = docs.sparkSession.sparkContext
    texts = docs.select(F.coalesce(F.col("lang"), F.lit(UNKNOWN)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    heavy: list[np.ndarray] = []
    shared: list = []
    levels: list[DataFrame] = []
    cells, weights, frequent = 0, np.zeros(0, np.int64), None
    for size in range(1, longest + 1):
        if size > 1 and not len(heavy[-1]):
            heavy += [np.zeros(0, np.int64)] * (longest - size)
            break
        above = shared[-1] if shared else None

        def count(batches, size=size, above=above, frequent=frequent):
            return _prefix_rows(batches, size, above and above.value, frequent and frequent.value)

        counted = stored(texts.mapInArrow(count, COUNTED).groupBy("lang", "phrase").agg(
            F.sum("n").alias("f"), F.min("route").alias("route")), f"prefixes-{size}")
        levels.append(counted)
        if size == longest:
            break
        if size == 1:
            total = counted.agg(F.sum("f")).first()[0] or 0
            budget = max(budget, -(-total // groups))
            cells = min(groups, 1 << max(4, int(16 * total // budget).bit_length()))
            weights = np.zeros(cells, np.int64)
            frequent = context.broadcast(bit_filter(counted.filter(F.col("f") >= least), "route"))
        found = counted.filter(F.col("f") > budget).select("route").distinct().toArrow()
        heavy.append(np.sort(found.column("route").to_numpy().astype(np.int64)))
        shared.append(context.broadcast(heavy[-1]))
        cell = F.shiftrightunsigned("route", 64 - (cells - 1).bit_length())
        light = counted.filter((F.col("f") <= budget) & (F.col("f") >= (least if size == 1 else 1)))
        weighed = light.groupBy(cell.alias("cell")).agg(F.sum("f").alias("f")).toArrow()
        np.add.at(weights, weighed.column("cell").to_numpy().astype(np.int64), weighed.column("f").to_numpy())
    words = levels[0].select("lang", "phrase", "f")
    phrases = [level.filter(F.col("f") >= least).select("lang", "phrase", F.lit(size).alias("size"), "f")
               for size, level in enumerate(levels[1:], 2)]
    if longest > 1:
        group_of = context.broadcast(_packed(weights, budget))

        rest = heavy[len(shared):]

        def leaves(batches):
            return _leaf_rows(batches, longest, [level.value for level in shared] + rest, frequent.value, group_of.value)

        below = texts.mapInArrow(leaves, LEAVES).groupBy("group").applyInArrow(
            lambda rows: _subtree(rows, least), "lang string, phrase string, size int, f long")
        phrases.append(below)
    if not phrases:
        return words, words.withColumn("size", F.lit(1)).limit(0)
    whole = phrases[0]
    for more in phrases[1:]:
        whole = whole.unionByName(more)
    return words, stored(whole, "phrases")


def _joined(words: Column, start: Column, size: Column) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, absorbed: int = ABSORBED, top: int = TOP,
                 budget: int = BUDGET) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    with small_batches(docs.sparkSession, BATCH_ROWS):
        words, phrases = phrase_counts(docs, longest, least, budget)
    split = phrases.withColumn("words", F.split("phrase", " "))
    cut = F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    cuts = split.select("lang", "phrase", F.col("f").alias("a"), "size", "words", cut)
    sides = cuts.select("lang", "phrase", "a", "k", F.explode(F.array(
        F.struct(F.lit("l").alias("side"), _joined(F.col("words"), F.lit(1), F.col("k")).alias("part")),
        F.struct(F.lit("r").alias("side"), _joined(F.col("words"), F.col("k") + 1, F.col("size") - F.col("k")).alias("part")),
    )).alias("s")).select("lang", "phrase", "a", "k", "s.side", "s.part")
    known = words.filter(F.col("f") >= least).unionByName(phrases.select("lang", "phrase", "f")).withColumnRenamed("phrase", "part")
    valued = lookup_join(sides, known, ["lang", "part"], "inner").select("lang", "phrase", "a", "k", "side", "f")
    # A phrase that stands in a longer candidate meets the count of that one.
    inner = split.filter("size > 2").select("lang", "words", "size", F.col("f").alias("over"),
                                            F.explode(F.expr("sequence(2, size - 1)")).alias("m"))
    inner = inner.select("lang", "words", "m", "over", F.explode(F.expr("sequence(1, size - m + 1)")).alias("start"))
    over = inner.groupBy("lang", _joined(F.col("words"), F.col("start"), F.col("m")).alias("phrase")).agg(F.max("over").alias("over"))
    together = valued.unionByName(over, allowMissingColumns=True)
    parts = [F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("f"))).alias(f"{side}{k}")
             for k in range(1, longest) for side in ("l", "r")]
    whole = together.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.max("over").alias("over"), *parts).filter("a IS NOT NULL")
    wide = {name: F.col(name).cast("decimal(19,0)") for name in ["a"] + [f"{s}{k}" for k in range(1, longest) for s in "lr"]}

    def scored(k: int) -> Column:
        # Counts multiply to at most 38 digits for tables of up to 10**15 words; the quotient is a whole number.
        square = (wide["a"] * wide["a"]).cast("decimal(38,0)") * F.lit(1_000_000).cast("decimal(7,0)")
        product = (wide[f"l{k}"] * wide[f"r{k}"]).cast("decimal(38,0)")
        return F.when(F.col(f"r{k}").isNotNull(), F.struct(
            F.call_function("div", square.cast("decimal(38,0)"), product).cast("long").alias("score"),
            F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))

    least_cut = F.array_min(F.array(*[scored(k) for k in range(1, longest)]))
    kept = whole.filter(F.col("over").isNull() | (100 * F.col("over") < absorbed * F.col("a")))
    best = kept.select("lang", "phrase", "a", least_cut.alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    sizes = words.groupBy("lang").agg(F.sum("f").alias("n"))
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), listed AS (
  SELECT row_number() OVER () AS id, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), placed AS (
  SELECT id, lang, unnest(w) AS w1, generate_subscripts(w, 1) AS i FROM listed
), spots AS (
  SELECT lang, w1, lead(w1) OVER piece AS w2, lead(w1, 2) OVER piece AS w3 FROM placed WINDOW piece AS (PARTITION BY id ORDER BY i)
), one AS (
  SELECT lang, w1, count(*) AS f FROM spots GROUP BY ALL
), two AS (
  SELECT lang, w1, w2, count(*) AS f FROM spots WHERE w2 IS NOT NULL GROUP BY ALL
), three AS (
  SELECT lang, w1, w2, w3, count(*) AS f FROM spots WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10
), n AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM one GROUP BY lang
), inside AS (
  SELECT lang, w1, w2, f FROM three UNION ALL SELECT lang, w2, w3, f FROM three
), over AS (
  SELECT lang, w1, w2, max(f) AS over FROM inside GROUP BY ALL
), cuts AS (
  SELECT c.lang, c.w1 || ' ' || c.w2 AS phrase, 1 AS k, c.f AS a, x.f AS l, y.f AS r
  FROM two c JOIN one x ON x.lang = c.lang AND x.w1 = c.w1 JOIN one y ON y.lang = c.lang AND y.w1 = c.w2
  LEFT JOIN over o ON o.lang = c.lang AND o.w1 = c.w1 AND o.w2 = c.w2
  WHERE c.f >= 10 AND (o.over IS NULL OR 100 * o.over < 50 * c.f)
  UNION ALL
  SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, 1, c.f, x.f, y.f
  FROM three c JOIN one x ON x.lang = c.lang AND x.w1 = c.w1 JOIN two y ON y.lang = c.lang AND y.w1 = c.w2 AND y.w2 = c.w3
  UNION ALL
  SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, 2, c.f, x.f, y.f
  FROM three c JOIN two x ON x.lang = c.lang AND x.w1 = c.w1 AND x.w2 = c.w2 JOIN one y ON y.lang = c.lang AND y.w1 = c.w3
), scored AS (
  SELECT *, CAST((1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS BIGINT) AS score FROM cuts
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best JOIN n USING (lang) QUALIFY rank <= 2000
"""


@query("op12_collocations", OP12_SQL)
def op12_collocations(spark, sf_dir):
    """The 2,000 best phrases of each language."""
    return collocations(read_table(spark, sf_dir, "documents").select("lang", "text"))
