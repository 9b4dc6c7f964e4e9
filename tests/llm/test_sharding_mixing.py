"""Sharding and mixing: laws, groups, targets, edge cases."""

import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from termwell.llm.mixing import mix, mixed_rows, source_targets, word_count
from termwell.llm.sharding import assign_shards

SCHEMA = "doc_id long, text string, source string, row string, shard string, salt int, h int, size int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, s, "r", "x", 1, 2, 3) for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    rows = [(k, f"text {k} " + "word " * (k % 37), f"s{k % 4}") for k in range(600)]
    rows += [(1000 + k, "a copy that many share", "s0") for k in range(400)]  # a hot group
    rows += [(2000, None, None), (2001, "", "s1"), (None, "no id", "s2"), (2002, "long " * 20000, "s3")]
    rows += [(3000, "repeated row", "s1")] * 30
    return rows


def test_shards_are_whole_and_even(spark, texts):
    out = assign_shards(table(spark, texts), shards=6).select("doc_id", "text", "source", "shard", "slot", "salt").collect()
    assert Counter((r.doc_id, r.text, r.source) for r in out) == Counter(texts)
    sizes, slots = Counter(), defaultdict(list)
    for r in out:
        sizes[r.shard] += len((r.text or "").encode()) + 8
        slots[r.shard].append(r.slot)
    total = sum(sizes.values())
    longest = 5 * 20000 + 8
    assert max(sizes.values()) <= total / 6 + longest
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_even_without_long_documents(spark):
    rows = [(k, f"document {k} " + "x" * (k * 7 % 90), "s") for k in range(3000)]
    out = assign_shards(table(spark, rows), shards=8).groupBy("shard").agg(F.sum(F.octet_length("text") + 8).alias("b")).collect()
    sizes = [r.b for r in out]
    assert len(sizes) == 8 and max(sizes) < 1.05 * sum(sizes) / 8


def test_equal_texts_share_a_shard_unless_hot(spark):
    rows = [(k, f"text {k // 3}", "s") for k in range(3000)]
    out = assign_shards(table(spark, rows), shards=5).groupBy("text").agg(F.countDistinct("shard").alias("n")).filter("n > 1").count()
    assert out == 0
    hot = [(k, "one text", "s") for k in range(3000)]
    sizes = [r["count"] for r in assign_shards(table(spark, hot), shards=5).groupBy("shard").count().collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) < 40


def test_identical_rows_are_dealt_out(spark):
    out = assign_shards(table(spark, [(1, "same", "s")] * 1000), shards=4)
    assert {r["count"] for r in out.groupBy("shard").count().collect()} == {250}


def test_empty_table_shards(spark):
    out = assign_shards(table(spark, []), shards=4)
    assert out.count() == 0 and {"shard", "slot", "salt"} <= set(out.columns)


def test_query_columns(spark, sf):
    from termwell.llm.sharding import op6_sharding

    rows = op6_sharding(spark, sf).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    for r in rows:
        raw = (docs[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    """Water-filling, one source after the other."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        left = [s for s in names if s not in fixed]
        if not left:
            return fixed
        rest = total - sum(fixed.values())
        goal = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = [s for s in left if goal[s] >= cap * sizes[s]]
        if not over:
            return fixed | goal
        fixed |= {s: float(cap * sizes[s]) for s in over}


def test_targets(spark):
    for sizes in ({"a": 10, "b": 1000, "é": 500, "Z": 70, None: 400}, {"a": 5}, {"a": 0, "b": 9}, {f"s{k}": 100 for k in range(30)}):
        rows = spark.createDataFrame(list(sizes.items()), "source string, words long")
        got = {r.source: r.target for r in source_targets(rows).collect()}
        want = plain_targets(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)



def test_word_count_matches_pattern(spark):
    import re

    rows = ["", None, " a  b\tc\n\nd\x0be\x0cf\rg ", "é x y z", "a" * 100000, " \n "]
    got = [r.n for r in spark.createDataFrame([(t,) for t in rows], "text string").select(word_count().alias("n")).collect()]
    assert got == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in rows]


def test_mix_meets_targets(spark, texts):
    out = mix(table(spark, texts), word_count()).select("row.doc_id", "row.text", "row.source", "size", "source_size", "target", "copies").collect()
    assert Counter((r.doc_id, r.text, r.source) for r in out) == Counter(texts)
    sizes = Counter()
    for _, t, s in texts:
        sizes[s] += len((t or "").split())
    want = plain_targets(sizes)
    taken, largest = Counter(), Counter()
    for r in out:
        assert 0 <= r.copies <= 2 and r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        taken[r.source] += r.copies * r["size"]
        largest[r.source] = max(largest[r.source], r["size"])
    for s in want:
        assert abs(taken[s] - want[s]) <= 0.02 * want[s] + largest[s] / 2 + 1


def test_rates_are_tilted_by_one_number_per_source(spark):
    """The dual solution: below the cap, log(rate) / size is the same for all documents of a source."""
    from termwell.llm.mixing import _solve

    histogram = spark.createDataFrame([("a", n, 10) for n in (1, 5, 20, 90)] + [("b", n, 4) for n in (3, 8)], "source string, size long, n long")
    targets = spark.createDataFrame([("a", 1160, 700.0), ("b", 44, 60.0)], "source string, words long, target double")
    lam = {r.source: r.lam for r in _solve(histogram, targets, 2).collect()}
    import math

    for source, goal in (("a", 700.0), ("b", 60.0)):
        got = sum(r.n * r["size"] * min(2, math.exp(lam[source] * r["size"])) for r in histogram.collect() if r.source == source)
        assert abs(got - goal) < 1e-3


def test_mix_reruns_agree_and_returns_rows(spark, texts):
    df = table(spark, texts)
    one = Counter(tuple(r) for r in mixed_rows(df, word_count()).collect())
    two = Counter(tuple(r) for r in mixed_rows(df, word_count()).collect())
    assert one == two and mixed_rows(df, word_count()).columns == df.columns


def test_empty_mix(spark):
    assert mix(table(spark, []), word_count()).count() == 0
    assert mix(table(spark, [(1, "", "a"), (2, None, None)]), word_count()).agg(F.sum(F.col("size") * F.col("copies"))).first()[0] == 0


def test_mix_does_not_depend_on_the_layout(spark, texts):
    """Equal rows from one, five and seven partitions, repeats and nulls among them."""
    rows = [(k, t, f"s{k % 4}" if k % 9 else None) for k, t in enumerate(texts)] + [(7, "the same row", "s1")] * 40 + [(None, None, "s1"), (None, "s1", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = [Counter(map(str, mix(part, word_count()).collect())) for part in (
        df.coalesce(1), df.repartition(5), df.orderBy(F.desc("text")).repartition(7, "doc_id"))]
    assert found[0] == found[1] == found[2] and sum(found[0].values()) == len(rows)


@pytest.mark.parametrize("sizes", [[0] * 50, [None, 0, -3] * 20, [0, 5] * 30, [None] * 5])
def test_rows_without_size_are_placed_too(spark, sizes):
    df = spark.createDataFrame([(k, f"text {k}", s) for k, s in enumerate(sizes)], "doc_id long, text string, size long")
    out = assign_shards(df, shards=5, size=F.col("size")).collect()
    assert sorted(r.doc_id for r in out) == list(range(len(sizes)))
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(5))
    if len(sizes) == 50:
        assert max(map(len, slots.values())) <= 11


def test_shards_equal_a_plain_placement(spark):
    """Running bytes in the order of the text's hash, in equal parts; no group is hot."""
    df = spark.createDataFrame([(k, f"text number {k % 350} " * (1 + k % 7)) for k in range(700)] + [(900, None), (901, "")], "doc_id long, text string")
    rows = df.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).alias("size")).collect()
    total, upto, expected = sum(r["size"] for r in rows), 0, {}
    by_hash = defaultdict(list)
    for r in rows:
        by_hash[r["h"]].append(r)
    for h in sorted(by_hash):
        upto += sum(r["size"] for r in by_hash[h])
        expected.update({r["doc_id"]: (upto - 1) * 6 // total for r in by_hash[h]})
    found = assign_shards(df, shards=6, group_share=1.0).collect()
    assert {r.doc_id: r.shard for r in found} == expected
