"""Language identification by Bayesian fusion of evidence.

For each document the log posterior of a language is the sum of

* the text's likelihood under hashed character trigrams of each language,
  tempered so that a text never counts for more than ``TEXT_TRIGRAMS``
  independent trigrams;
* the likelihood of the declared (markup) language, from a table of how often
  each language is declared as each;
* a prior from the host, smoothed towards the prior of the address suffix, which
  is smoothed towards the prior of all documents. The counts behind these
  are sums of text posteriors from grouped aggregation; a document's own share
  is taken out of its host's before use.

A uniform trigram source competes as ``und``: text that no language explains
better than noise, and text without letters, is ``und`` and rejected.

The likelihoods are fitted on a sample of labelled rows, ``SAMPLE_PER_LANGUAGE``
expected per language and ``SAMPLE_CHARS`` of each text in pieces spread over all of it, for all labels, taken by
their primary tag, with ``MIN_LABELLED`` rows or more; every other figure
covers all documents and whole texts. Without such labels all is ``und``. A text that
would be ``und`` or unsure though it is declared as a language without a model has that
language and is accepted, unless it has no letters or is not among the languages wanted.

Defined cases: a null text is empty; a null or unknown declaration, host or
address adds no evidence of its own; an empty table gives an empty result;
repeated rows count each; input columns named like a result are replaced.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termwell.llm.common import read_table, spread_pieces, stored
from termwell.llm.registry import query

BUCKETS = 1 << 15
PIECE = 1 << 12
SAMPLE_PER_LANGUAGE = 2000
SAMPLE_CHARS = 4000
MIN_LABELLED = 5
SMOOTHING = 0.5
TEXT_TRIGRAMS = 64
HOST_STRENGTH = 20.0
SUFFIX_STRENGTH = 50.0
DECLARED_STRENGTH = 10.0
NOISE_PRIOR = 1e-3
LEAST_CONFIDENCE = 0.5
BROADCAST_HOSTS = 200_000
RESULTS = ("language", "confidence", "text_language", "accepted")

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)


def trigram_buckets(text: str | None) -> np.ndarray:
    """Buckets of the byte trigrams of the letters of a text, words parted by one space."""
    data = _FOLD[np.frombuffer((" " + (text or "").lower() + " ").encode(), np.uint8)]
    gap = data == 32
    kept = data[~(gap & np.r_[False, gap[:-1]])]
    if len(kept) < 3:
        return np.zeros(0, np.int64)
    codes = (kept[:-2] << np.uint32(16)) | (kept[1:-1] << np.uint32(8)) | kept[2:]
    return ((codes * np.uint32(0x9E3779B1)) >> np.uint32(17)).astype(np.int64)


@dataclass(frozen=True)
class TextModel:
    """Log probabilities of trigram buckets, one column per language."""

    languages: tuple[str, ...]
    table: np.ndarray

    def score(self, text: str | None) -> list[float]:
        """Tempered log likelihood of each language and of noise; all 0 but noise for a text without letters."""
        buckets = trigram_buckets(text)
        if not len(buckets):
            return [-1e3] * len(self.languages) + [0.0]
        weight = min(1.0, TEXT_TRIGRAMS / len(buckets))
        sums = sum(self.table[buckets[k:k + PIECE]].sum(axis=0, dtype=np.float64) for k in range(0, len(buckets), PIECE)) * weight
        return [*sums.tolist(), -np.log(BUCKETS) * len(buckets) * weight]


def primary_tag(tag: Column) -> Column:
    """Primary tag of a language tag in lower case; null where there is none."""
    found = F.lower(F.regexp_extract(tag, r"^\s*([A-Za-z]{2,8})(?:[-_]|\s*$)", 1))
    return F.when(found != "", found)


def fit_text_model(rows: DataFrame, key: Column, text: str = "text", label: str = "lang") -> TextModel:
    """Trigram counts of a bounded sample of labelled rows, drawn by the hash of ``key``."""
    labelled = rows.select(F.col(text).alias("text"), primary_tag(F.col(label)).alias("label"), key.alias("key")).filter(
        "label IS NOT NULL AND text IS NOT NULL")
    counts = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= MIN_LABELLED).collect()
    languages = tuple(sorted(r["label"] for r in counts))
    table = np.full((BUCKETS, len(languages)), SMOOTHING)
    if languages:
        share = F.create_map(*[F.lit(v) for r in counts for v in (r["label"], min(1.0, SAMPLE_PER_LANGUAGE / r["n"]))])
        drawn = labelled.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 40)) < share[F.col("label")] * float(1 << 40))

        def counted(frames):
            sums: dict[str, np.ndarray] = {}
            for frame in frames:
                for value, of in zip(frame["text"], frame["label"], strict=True):
                    sums.setdefault(of, np.zeros(BUCKETS, np.int64))
                    sums[of] += np.bincount(trigram_buckets(value), minlength=BUCKETS)
            for of, n in sums.items():
                seen = np.flatnonzero(n)
                yield pd.DataFrame({"label": of, "bucket": seen, "n": n[seen]})

        sums = (drawn.select("label", spread_pieces(F.col("text"), SAMPLE_CHARS).alias("text"))
                .mapInPandas(counted, "label string, bucket long, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")))
        column = {of: k for k, of in enumerate(languages)}
        for of, bucket, n in sums.toLocalIterator():
            table[bucket, column[of]] += n
    return TextModel(languages, np.log(table / table.sum(axis=0, keepdims=True)).astype(np.float32))


def host_of(address: Column) -> Column:
    """Host of an address in lower case, without port; null where there is none."""
    found = F.lower(F.regexp_extract(address, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(found != "", found)


def suffix_of(host: Column) -> Column:
    found = F.regexp_extract(host, r"\.([a-z0-9-]+)\.?$", 1)
    return F.when(found != "", found)


def declared_in(html: Column) -> Column:
    """Primary tag of the language the markup declares on its root element."""
    found = F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1))
    return F.when(found != "", found)


def visible_text(html: Column) -> Column:
    """Markup without scripts, styles, comments and tags."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(bare, r"<[^>]*>", " ")


def _softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    return F.transform(scores, lambda s: F.exp(s - top) / F.aggregate(
        scores, F.lit(0.0), lambda total, x: total + F.exp(x - top)))


def identify(df: DataFrame, model: TextModel, text: str = "text", declared: Column | None = None,
             address: Column | None = None, host: Column | None = None, wanted: list[str] | None = None) -> DataFrame:
    """The rows with ``language``, ``confidence``, ``text_language`` and ``accepted``.

    ``declared`` is a language tag, ``address`` gives suffix and host, ``host``
    may also be any grouping that documents of one origin share.
    """
    spark = df.sparkSession
    n = len(model.languages)
    if not n:
        return df.drop(*RESULTS).withColumns({
            "language": F.lit("und"), "confidence": F.lit(1.0), "text_language": F.lit("und"), "accepted": F.lit(False)})
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def likelihoods(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(text) for text in texts])

    names = F.array(*[F.lit(name) for name in model.languages], F.lit("und"))
    tag = primary_tag(declared) if declared is not None else F.lit(None)
    origin = host if host is not None else host_of(address) if address is not None else F.lit(None)
    suffix = suffix_of(host_of(address)) if address is not None else F.lit(None)
    rows = df.drop(*RESULTS).select(F.struct("*").alias("row"), F.col(text).alias("text"), tag.cast("string").alias("tag"),
                     origin.cast("string").alias("host"), suffix.cast("string").alias("suffix"))
    scored = rows.withColumn("ll", likelihoods("text")).drop("text").withColumn("stranger", F.when(
        ~F.col("tag").isin(*model.languages, "und") & (F.element_at("ll", n + 1) < 0), F.col("tag"))).withColumn(
        "tag", F.when(F.col("tag").isin(*model.languages), F.col("tag")))
    heard = _softmax(F.col("ll"))  # of the text alone; what counts as noise adds little to any language
    known = scored.withColumn("p", heard)

    # All counts in one aggregation, combined before the shuffle; every wider group sums narrower ones.
    sums = [F.sum(F.col("p")[i]).alias(f"p{i}") for i in range(n)]
    again = [F.sum(f"p{i}").alias(f"p{i}") for i in range(n)]
    per_group = stored(known.groupBy("suffix", "host", "tag").agg(*sums), "language-groups")
    whole = per_group.agg(*again).first()
    world = [((whole[i] or 0.0) + 1.0) / (sum(x or 0.0 for x in whole) + n) for i in range(n)]
    tags = per_group.filter("tag IS NOT NULL").groupBy("tag").agg(*again).collect()
    per_language = [sum(r[f"p{i}"] for r in tags) for i in range(n)]
    # One literal for the whole table, which has a row and a column per language.
    stated = F.from_json(F.lit(json.dumps({r["tag"]: [
        float(np.log((r[f"p{i}"] + DECLARED_STRENGTH / n) / (per_language[i] + DECLARED_STRENGTH))) for i in range(n)]
        for r in tags})), "map<string,array<double>>") if tags else None
    parent = F.array(*[F.lit(x) for x in world])

    def smoothed(strength: float, above: Column) -> Column:
        seen = F.array(*[F.col(f"p{i}") for i in range(n)])
        total = F.aggregate(seen, F.lit(0.0), lambda t, x: t + x)
        return F.transform(seen, lambda x, i: (x + strength * F.get(above, i)) / (total + strength))

    suffixes = per_group.filter("suffix IS NOT NULL").groupBy("suffix").agg(*again).select(
        "suffix", smoothed(SUFFIX_STRENGTH, parent).alias("above"))
    hosts = per_group.filter("host IS NOT NULL").groupBy("suffix", "host").agg(*again)
    hosts = hosts.join(suffixes, "suffix", "left").select(
        "host", "suffix", F.coalesce("above", parent).alias("above"),
        F.array(*[F.col(f"p{i}") for i in range(n)]).alias("seen"))
    hosts = stored(hosts, "language-hosts")
    if hosts.count() <= BROADCAST_HOSTS:
        hosts = F.broadcast(hosts)
    same = [known["host"] == hosts["host"], known["suffix"].eqNullSafe(hosts["suffix"])]
    joined = known.join(hosts, same, "left").drop(hosts["host"], hosts["suffix"])
    total = F.aggregate("seen", F.lit(0.0), lambda t, x: t + x)
    own = F.aggregate(F.slice("p", 1, n), F.lit(0.0), lambda t, x: t + x)
    prior = F.coalesce(
        F.transform("seen", lambda x, i: F.log((F.greatest(x - F.get("p", i), F.lit(0.0)) + HOST_STRENGTH * F.get("above", i))
                                               / (F.greatest(total - own, F.lit(0.0)) + HOST_STRENGTH))),
        F.transform(parent, lambda x: F.log(x)))
    none = F.array_repeat(F.lit(0.0), n)
    evidence = F.coalesce(F.element_at(stated, F.col("tag")), none) if stated is not None else none
    fused = F.transform(F.slice("ll", 1, n), lambda x, i: x + F.get("prior", i) + F.get("evidence", i)
                        + float(np.log(1 - NOISE_PRIOR)))
    noise = F.element_at("ll", n + 1) + float(np.log(NOISE_PRIOR))
    posterior = joined.withColumn("prior", prior).withColumn("evidence", evidence).withColumn(
        "posterior", _softmax(F.concat(fused, F.array(noise))))
    best = lambda column: F.element_at(names, F.array_position(column, F.array_max(column)).cast("int"))
    fits = F.col("_language").isin(*(wanted if wanted is not None else model.languages)) & (F.array_max("posterior") >= LEAST_CONFIDENCE)
    unsure = (F.col("_language") == "und") | (F.array_max("posterior") < LEAST_CONFIDENCE)
    foreign = F.col("stranger").isNotNull() & unsure
    kept = F.col("stranger").isin(*wanted) if wanted is not None else F.lit(True)
    return posterior.withColumn("_language", best(F.col("posterior"))).select(
        "row.*", F.when(foreign, F.col("stranger")).otherwise(F.col("_language")).alias("language"),
        F.array_max("posterior").alias("confidence"), best(F.col("p")).alias("text_language"),
        F.when(foreign, kept).otherwise(fits).alias("accepted"))


@query("op4_language_id")
def op4_language_id(spark, sf_dir):
    """The language of every document, from its text, its declared language and its source."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    model = fit_text_model(docs, F.col("doc_id"))
    return identify(docs, model, declared=F.col("lang"), host=F.col("source")).select(
        "doc_id", "language", "confidence", "text_language", F.col("lang").alias("declared"), "accepted")


@query("pages_language")
def pages_language(spark, sf_dir):
    """The language of every page, from its visible text, markup, address suffix and host."""
    docs = read_table(spark, sf_dir, "documents")
    model = fit_text_model(docs, F.col("doc_id"))
    pages = read_table(spark, sf_dir, "pages")
    rows = pages.select("page_id", "url", visible_text(F.col("html")).alias("text"), declared_in(F.col("html")).alias("tag"))
    return identify(rows, model, declared=F.col("tag"), address=F.col("url")).select(
        "page_id", "language", "confidence", "text_language", F.col("tag").alias("declared"), "accepted")
