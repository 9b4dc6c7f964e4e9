"""Fill-in-the-middle samples: texts cut into prefix, middle and suffix at whole characters.

Cuts are drawn in units (code points), but texts are bytes. ``UnitIndex`` finds the
byte that ends the k-th unit without decoding: the UTF-8 bytes are viewed as
64-bit words; arithmetic on whole words marks every byte that ends a unit, the
one before a byte that starts another; the marks of each word are counted
at once and summed up. A binary search over the sums finds the word of the k-th
mark, byte-wise prefix sums inside that word the byte. All texts of an Arrow
batch share one index, about 1.6 times the size of their bytes.

``with_fim`` adds ``n`` (units), ``form``, ``prefix_chars``, ``middle_chars`` and ``output``;
``restored`` is the way back. The cuts, the share of changed texts and that of suffix-first
ones follow from the SHA-256 of ``seed`` and the row's key alone, so equal keys are cut
alike in every run and layout.

Defined cases: a null text is empty, and an empty one stays plain; so does a text that
holds a sentinel; sentinels must be different and none may be the start of the rest of
another, which ``_checked`` enforces, so that outputs can be taken apart; a null key is
the empty string; repeated rows are cut alike; an empty table gives an empty
result; columns of the names added are replaced.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termwell.llm.common import read_table
from termwell.llm.registry import query

SENTINELS = ("<P>", "<S>", "<M>")  # prefix, suffix, middle
SEED = "1:"
CHANGED = 90  # of a hundred texts
SUFFIX_FIRST = 20  # of a hundred changed texts

ONES = np.uint64(0x0101010101010101)
TOPS = np.uint64(0x8080808080808080)


class UnitIndex:
    """Where units end in UTF-8 bytes."""

    def __init__(self, data: np.ndarray):
        padded = np.zeros(-(-len(data) // 8) * 8 + 8, np.uint8)
        padded[:len(data)] = data
        words = padded.view("<u8")
        # A byte starts a unit unless its two highest bits are 10. What follows the data starts one, so its last byte ends one.
        starts = ~((words >> np.uint64(7)) & (~words >> np.uint64(6))) & ONES
        # The byte before a start ends a unit: move the marks one byte down, the lowest of the next word into the top.
        self.marks = (starts[:-1] >> np.uint64(8)) | (starts[1:] << np.uint64(56))
        if tail := len(data) % 8:
            self.marks[-1] &= (np.uint64(1) << np.uint64(8 * tail)) - np.uint64(1)
        self.sums = np.cumsum(np.bitwise_count(self.marks), dtype=np.int64)

    def units_before(self, places: np.ndarray) -> np.ndarray:
        """Units that end before each place; places are counted in bytes."""
        if not len(self.marks):
            return np.zeros(len(places), np.int64)
        word = np.minimum(places >> 3, len(self.marks) - 1)
        inside = (8 * (places - 8 * word)).astype(np.uint64)
        below = np.where(inside < 64, (np.uint64(1) << (inside & np.uint64(63))) - np.uint64(1), ~np.uint64(0))
        return self.sums[word] - np.bitwise_count(self.marks[word] & ~below)

    def end_of(self, units: np.ndarray) -> np.ndarray:
        """The place after the k-th unit, counted from 1; 0 for the 0th."""
        if not len(self.marks):
            return np.zeros(len(units), np.int64)
        word = np.minimum(np.searchsorted(self.sums, units), len(self.marks) - 1)
        marks = self.marks[word]
        rank = units - self.sums[word] + np.bitwise_count(marks)  # among the marks of the word, from 1
        upto = marks * ONES  # byte j holds the number of marks in the bytes 0 to j
        reached = ((upto | TOPS) - np.maximum(rank, 0).astype(np.uint64) * ONES) & TOPS  # bytes with that many marks or more
        return np.where(units > 0, 8 * word + 9 - np.bitwise_count(reached), 0)


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, and where each begins."""
    texts = texts.fill_null("").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    places = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    return np.frombuffer(data or b"", np.uint8)[places[0]:places[-1]], places - places[0]


def _cut(texts: pa.Array, one: pa.Array, other: pa.Array, form: pa.Array, sentinels: tuple[str, str, str]) -> pa.Array:
    """Each text cut where two draws fall, and put together again in its form."""
    data, places = _bytes_of(texts)
    index = UnitIndex(data)
    before = index.units_before(places)
    n = np.diff(before)
    draws = np.sort([one.to_numpy(zero_copy_only=False) % (n + 1), other.to_numpy(zero_copy_only=False) % (n + 1)], axis=0)
    low, high = (np.maximum(index.end_of(before[:-1] + draw), places[:-1]) for draw in draws)
    whole = data.tobytes()
    first, second, third = (s.encode() for s in sentinels)
    outputs = []
    for kind, start, cut, end, stop in zip(form.to_pylist(), places[:-1].tolist(), low.tolist(), high.tolist(), places[1:].tolist(), strict=True):
        if kind == "plain":
            outputs.append(whole[start:stop])
        elif kind == "psm":
            outputs.append(b"".join((first, whole[start:cut], second, whole[end:stop], third, whole[cut:end])))
        else:
            outputs.append(b"".join((second, whole[end:stop], first, whole[start:cut], third, whole[cut:end])))
    plain = np.array([kind == "plain" for kind in form.to_pylist()], bool)
    output = pa.array(outputs, pa.large_binary()).cast(pa.large_string())
    if output.nbytes < 1 << 31:
        output = output.cast(pa.string())
    return pa.StructArray.from_arrays(
        [pa.array(n, pa.int64()), pa.array(draws[0], pa.int64(), mask=plain), pa.array(draws[1] - draws[0], pa.int64(), mask=plain), output],
        ["n", "prefix_chars", "middle_chars", "output"])


_CUT_TYPE = T.StructType([T.StructField("n", T.LongType()), T.StructField("prefix_chars", T.LongType()),
                          T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())])


def _checked(sentinels: tuple[str, str, str]) -> tuple[str, str, str]:
    """The sentinels, if no two of them can overlap in an output."""
    for a in sentinels:
        for b in sentinels:
            if not a or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)) + (a is not b))) or (a is not b and a in b):
                raise ValueError("sentinels must be three different strings that cannot overlap")
    return sentinels


def with_fim(docs: DataFrame, key: Column, text: str = "text", seed: str = SEED, changed: int = CHANGED,
             suffix_first: int = SUFFIX_FIRST, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """The rows with ``n``, ``form`` (plain, psm or spm), ``prefix_chars``, ``middle_chars`` and ``output``."""
    sentinels = _checked(tuple(sentinels))
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    draw = [F.conv(F.substring("_digest", 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    content = F.coalesce(F.col(text), F.lit(""))
    marked = F.lit(False)
    for sentinel in sentinels:
        marked = marked | content.contains(sentinel)
    plain = (content == "") | marked | (draw[2] % 100 >= changed)
    form = F.when(plain, "plain").when(draw[3] % 100 < suffix_first, "spm").otherwise("psm")

    def cut(texts: pa.Array, one: pa.Array, other: pa.Array, kinds: pa.Array) -> pa.Array:
        return _cut(texts, one, other, kinds, sentinels)

    names = {"n", "form", "prefix_chars", "middle_chars", "output"}
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in names - {text}]
    found = docs.select(*kept, content.alias("_content"), digest.alias("_digest")).withColumn("_form", form).withColumn(
        "_cut", F.arrow_udf(cut, _CUT_TYPE)("_content", draw[0], draw[1], "_form"))
    return found.select(*[F.col(f"`{c}`") for c in docs.columns if c not in names], "_cut.n", F.col("_form").alias("form"),
                        "_cut.prefix_chars", "_cut.middle_chars", "_cut.output")


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text an output was made of."""
    parts = F.split(output, "|".join(re.escape(s) for s in _checked(tuple(sentinels))), -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(parts[1], parts[3], parts[2])).otherwise(
        F.concat(parts[2], parts[3], parts[1]))


OP11_SQL = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS body, length(coalesce(text, '')) AS n,
    sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest
  FROM documents
), numbers AS (
  SELECT *, CAST('0x' || digest[1:8] AS BIGINT) AS h1, CAST('0x' || digest[9:16] AS BIGINT) AS h2,
    CAST('0x' || digest[17:24] AS BIGINT) AS h3, CAST('0x' || digest[25:32] AS BIGINT) AS h4 FROM drawn
), cuts AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
    CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') OR h3 % 100 >= 90 THEN 'plain'
         WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM numbers
), pieces AS (
  SELECT *, substring(body, 1, low) AS a, substring(body, low + 1, high - low) AS b, substring(body, high + 1) AS c FROM cuts
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN low END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN high - low END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b
         ELSE '<S>' || c || '<P>' || a || '<M>' || b END) AS output_sha256,
  sha256(body) AS restored_sha256
FROM pieces
"""


@query("op11_fim", OP11_SQL)
def op11_fim(spark, sf_dir):
    """Every document as a fill-in-the-middle sample, and the text that its output gives back."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    made = with_fim(docs, F.col("doc_id"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"))
