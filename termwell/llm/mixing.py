"""Mixing sources to target weights by entropy balancing.

Every document gets a rate: how often it should stand in the mix. Among all
rates between 0 and ``CAP`` whose words meet the target of each source, those
nearest to 1 in relative entropy are ``min(CAP, exp(lambda * size))`` with one
dual variable per source. The dual is solved by Newton steps on the logarithm of
the words reached, each step one aggregation over the histogram (source, size),
kept inside a bracket that halves whenever a step leaves it. Targets at the cap
take every document ``CAP`` times.

Rates are then rounded to copies. Within chunks of about ``CHUNK`` documents of
one source, largest first, each document takes the lower or the upper whole
number, whichever keeps the words taken so far nearest to the words due, so a
chunk misses its share by about half its smallest document.

All of it is DataFrame and SQL functions. Per-source tables stay distributed;
only totals and the largest miss reach the driver.

Defined cases: a null text has size 0 and is taken once at most; a null source
is a source of its own, ordered last; an empty table gives an empty result;
repeated rows are documents of their own. Chunks and ties follow from the rows' own columns, so the
same rows give the same mix however the input is split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termwell.llm.common import read_table, stored
from termwell.llm.registry import query
from termwell.operators.scan import numbered

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
CHUNK = 500
TOLERANCE = 1e-6
MAX_STEPS = 100
LOWEST = -50.0


def word_count(text: str = "text") -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; 0 for null.

    The text is split at single separators and empty parts are not counted.
    """
    spaces = " \t\n\x0b\x0c\r"
    plain = F.translate(F.coalesce(F.col(text), F.lit("")), spaces, " " * len(spaces))
    return F.size(F.filter(F.split(plain, " "), lambda w: w != "")).cast("long")


def source_targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE,
                   cap: float = CAP) -> DataFrame:
    """Add ``target`` to a table of (source, words), one row per source.

    Weights go round by code point of the source, null last. No target exceeds
    ``cap`` times its source; what is cut off goes to the others by weight.
    """
    keyed = sources.select("source", "words", F.lit(0).alias("all"), F.col("source").isNull().alias("none"),
                           F.coalesce("source", F.lit("")).alias("name"))
    ranked = numbered(keyed, ["all"], ["none", "name"], "place")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    rows = stored(ranked.select(
        "source", "words", F.element_at(cycle, (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
        .alias("weight"), (F.col("words") * F.lit(float(cap))).alias("most")), "mix-sources")
    total = share * (rows.agg(F.sum("words")).first()[0] or 0)
    level, full = 0.0, -1
    while True:  # the water level rises until no further source is full
        done = F.col("weight") * F.lit(level) >= F.col("most")
        got = rows.agg(F.sum(F.when(done, F.col("most"))).alias("held"), F.sum(F.when(~done, F.col("weight"))).alias("open"),
                       F.count(F.when(done, 1)).alias("full")).first()
        if not got["open"] or got["full"] == full:
            break
        full, level = got["full"], (total - (got["held"] or 0.0)) / got["open"]
    return rows.select("source", "words", F.least("most", F.col("weight") * F.lit(level)).alias("target"))


def _solve(histogram: DataFrame, targets: DataFrame, cap: float) -> DataFrame:
    """The dual variable of each source: (source, target, lam); null where the target is at the cap or 0."""
    inner = (F.col("target") > 0) & (F.col("target") < F.col("words") * F.lit(float(cap)) * (1 - 1e-9))
    state = stored(targets.filter(inner).select(
        "source", "target", F.lit(0.0).alias("lam"), F.lit(LOWEST).alias("low"),
        F.lit(float(cap)).cast("double").alias("high"), F.lit(1.0).alias("miss")), "mix-dual")
    for _ in range(MAX_STEPS):
        lam = F.col("lam") * F.col("size")
        reached = F.col("n") * F.col("size") * F.least(F.lit(float(cap)), F.exp(F.least(lam, F.lit(50.0))))
        slope = F.when(lam < F.log(F.lit(float(cap))), reached * F.col("size")).otherwise(F.lit(0.0))
        sums = (histogram.join(state, histogram["source"].eqNullSafe(state["source"])).drop(histogram["source"])
                .groupBy("source", "target", "lam", "low", "high")
                .agg(F.sum(reached).alias("got"), F.sum(slope).alias("slope")))
        low = F.when(F.col("got") < F.col("target"), F.col("lam")).otherwise(F.col("low"))
        high = F.when(F.col("got") >= F.col("target"), F.col("lam")).otherwise(F.col("high"))
        step = F.col("lam") + F.log(F.col("target") / F.col("got")) * F.col("got") / F.col("slope")
        miss = F.abs(F.col("got") / F.col("target") - 1)
        moved = sums.withColumns({"low": low, "high": high, "step": step, "miss": miss})
        inside = F.col("step").isNotNull() & (F.col("step") > F.col("low")) & (F.col("step") < F.col("high"))
        state = stored(moved.select(
            "source", "target",
            F.when(F.col("miss") <= TOLERANCE, F.col("lam")).when(inside, F.col("step"))
            .otherwise((F.col("low") + F.col("high")) / 2).alias("lam"), "low", "high", "miss"), "mix-dual")
        if (state.agg(F.max("miss")).first()[0] or 0.0) <= TOLERANCE:
            break
    return state.select("source", F.round("lam", 14).alias("lam"))  # sums in another order differ in the last digits


def _told_apart(rows: DataFrame) -> DataFrame:
    """The rows with ``nth``, a number among rows of equal content (any order: they are the same)."""
    repeated = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    if not repeated.limit(1).count():
        return rows.withColumn("nth", F.lit(1).cast("long"))
    again = numbered(rows.join(repeated, "key", "left_semi"), ["key"], ["salt"], "nth").select(*rows.columns, F.col("nth").cast("long").alias("nth"))
    return rows.join(repeated, "key", "left_anti").withColumn("nth", F.lit(1).cast("long")).unionByName(again)


def mix(df: DataFrame, size: Column, source: str = "source", weights: Sequence[float] = WEIGHTS,
        share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(row, size, source_size, target, copies): the rows as a struct with what the mix takes of them."""
    rows = stored(df.select(F.struct("*").alias("row"), F.col(source).cast("string").alias("source"),
                            size.alias("size"), F.monotonically_increasing_id().alias("salt"),
                            F.xxhash64(*[x for c in df.columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]).alias("key")), "mix-rows")
    histogram = stored(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-sizes")
    targets = stored(source_targets(histogram.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("words"),
                                                                     F.sum("n").alias("docs"))
                                    .drop("docs"), weights, share, cap), "mix-targets")
    dual = _solve(histogram.filter(F.col("size") > 0), targets, cap)
    docs = histogram.groupBy("source").agg(F.sum("n").alias("docs"))
    on = lambda a, b: a["source"].eqNullSafe(b["source"])
    plan = (targets.join(docs, on(targets, docs)).drop(docs["source"]))
    plan = stored(plan.join(dual, on(plan, dual), "left").drop(dual["source"]), "mix-plan")

    rate = (F.when(F.col("words") == 0, F.lit(1.0)).when(F.col("target") <= 0, F.lit(0.0))
            .when(F.col("lam").isNull(), F.lit(float(cap)))
            .otherwise(F.least(F.lit(float(cap)), F.exp(F.least(F.col("lam") * F.col("size"), F.lit(50.0))))))
    sizes = _told_apart(rows.select("salt", "source", "size", "key"))
    chunks = F.greatest(F.lit(1), F.ceil(F.col("docs") / F.lit(CHUNK)))
    rated = sizes.join(plan, on(sizes, plan)).drop(plan["source"]).select(
        "salt", "source", "size", "key", "nth", F.col("words").alias("source_size"), "target", rate.alias("rate"),
        F.pmod(F.xxhash64("key", "nth"), chunks).alias("chunk"))
    lists = rated.groupBy("source", "chunk", "source_size", "target").agg(
        F.sort_array(F.collect_list(F.struct("size", "key", "nth", "salt", "rate")), asc=False).alias("docs"))
    taken = lists.select("source_size", "target", F.explode(F.expr("""
        aggregate(docs, named_struct('owed', 0D, 'out', array_repeat(named_struct('salt', 0L, 'copies', 0), 0)),
          (done, doc) -> transform(
            array(CASE WHEN doc.size = 0 THEN least(1D, floor(doc.rate)) ELSE
              least(ceil(doc.rate), greatest(floor(doc.rate), round((done.owed + doc.rate * doc.size) / doc.size))) END),
            c -> named_struct('owed', done.owed + (doc.rate - c) * doc.size,
              'out', concat(done.out, array(named_struct('salt', doc.salt, 'copies', CAST(c AS int))))))[0]).out
        """)).alias("pick")).select(F.col("pick.salt").alias("salt"), F.col("pick.copies").alias("copies"),
                                    "source_size", "target")
    return rows.join(taken, "salt").select("row", "size", "source_size", "target", "copies")


def mixed_rows(df: DataFrame, size: Column, **options) -> DataFrame:
    """The mix itself: each row as often as it is taken, in the columns of the input."""
    return mix(df, size, **options).filter(F.col("copies") > 0).select(
        "row", F.explode(F.expr("sequence(1, copies)"))).select("row.*")


@query("op7_mixing")
def op7_mixing(spark, sf_dir):
    """Every document with the words the mix takes of it."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", word_count().alias("words"))
    return mix(docs, F.col("words")).select(
        F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target",
        (F.col("size") * F.col("copies")).alias("taken"))
