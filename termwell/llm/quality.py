"""Quality scores from compression with dictionaries of good and of bad text.

Two Zstandard dictionaries are trained, one on texts labelled good, one on texts
labelled bad. A text is compressed in pieces of ``PIECE`` bytes with each; it is
the likelier good the more the good dictionary saves over the bad one. The
normalised difference of the compressed sizes and the compressed size per
byte become a probability by logistic regression on labelled texts that trained
neither dictionary.

Training uses a sample of labelled rows, ``SAMPLE_PER_LABEL`` expected per label,
half of it for the dictionaries (``TRAIN_BYTES`` of each text, in pieces spread over all of it) and half, whole
texts, for the calibration. Rows that ``held_out`` marks are never drawn. Scores
depend on texts alone and read them whole.

Defined cases: a null text is empty; empty texts score the share of good ones
among the calibration's empty texts, smoothed by the share among all; conflicting labels of
one document are decided by the majority, ties count as bad; with fewer than
``LEAST_PER_LABEL`` texts of either label every score is the share of good ones, 0.5 without
labels; an empty table gives an empty result; an input column ``score`` is
replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termwell.llm.common import read_table, spread_pieces, stored
from termwell.llm.registry import query

PIECE = 512
LEVEL = 3
DICTIONARY_BYTES = 112_640
SAMPLE_PER_LABEL = 2000
TRAIN_BYTES = 4000
LEAST_PER_LABEL = 4
RIDGE = 1e-3
KEEP = 0.3


def _pieces(data: bytes, size: int = PIECE) -> list[bytes]:
    return [data[k:k + size] for k in range(0, len(data), size)]


def _dictionary(texts: list[bytes]) -> tuple[bytes, bool]:
    """Content of a dictionary and whether it is raw text, which it is where there is too little to train on."""
    try:
        samples = [piece for text in texts for piece in _pieces(text)]
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes(), False
    except (zstandard.ZstdError, ValueError):
        return (b"\n".join(texts) + b" " * 8)[-DICTIONARY_BYTES:], True


@dataclass
class QualityModel:
    """Dictionaries, and a logistic curve over the compression features; ``weights`` is empty for a constant score."""

    good: tuple[bytes, bool]
    bad: tuple[bytes, bool]
    base: float
    empty: float
    low: np.ndarray
    high: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_packers"}

    @cached_property
    def _packers(self):
        kinds = (zstandard.DICT_TYPE_FULLDICT, zstandard.DICT_TYPE_RAWCONTENT)
        return [zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(
            content, dict_type=kinds[raw])) for content, raw in (self.good, self.bad)]

    def features(self, data: bytes) -> tuple[float, float]:
        """Normalised size difference (positive: nearer to good text) and log of the smaller size per byte."""
        good, bad = (sum(len(packer.compress(piece)) for piece in _pieces(data)) for packer in self._packers)
        return (bad - good) / max(good, bad), float(np.log(min(good, bad) / len(data)))

    def score(self, text: str | None) -> float:
        data = (text or "").encode()
        if not len(self.weights):
            return self.base
        if not data:
            return self.empty
        return float(self.curve(np.array([self.features(data)]))[0])

    def curve(self, features: np.ndarray) -> np.ndarray:
        z = np.clip(features, self.low, self.high)
        z = (np.c_[z, z[:, 1] ** 2] - self.mean) / self.scale
        return 1.0 / (1.0 + np.exp(-np.clip(np.c_[np.ones(len(z)), z] @ self.weights, -30, 30)))


def _calibrated(model: QualityModel, features: np.ndarray, labels: np.ndarray) -> QualityModel:
    """Fit the curve by Newton steps on the penalised likelihood."""
    model.low, model.high = features.min(axis=0), features.max(axis=0)
    wide = np.c_[features, features[:, 1] ** 2]
    model.mean, model.scale = wide.mean(axis=0), wide.std(axis=0) + 1e-9
    z = np.c_[np.ones(len(wide)), (wide - model.mean) / model.scale]
    penalty = RIDGE * len(z) * np.r_[1e-6, np.ones(z.shape[1] - 1)]
    weights = np.zeros(z.shape[1])
    for _ in range(100):
        p = 1.0 / (1.0 + np.exp(-np.clip(z @ weights, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (p - labels) + penalty * weights)
        weights = weights - step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    model.weights = weights
    return model


def held_out_fold(doc_id: Column) -> Column:
    """True for the fifth of documents that training must not see."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality") -> QualityModel:
    """Train on a bounded sample of the labelled documents; ``docs`` has doc_id and text."""
    votes = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.avg(F.col(label)).alias("vote"))
    known = votes.filter(~held_out_fold(F.col("doc_id"))).select("doc_id", (F.col("vote") > 0.5).alias("good"))
    counts = {r["good"]: r["n"] for r in known.groupBy("good").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    base = counts.get(True, 0) / total if total else 0.5
    nothing = np.zeros(0)
    model = QualityModel((b"", True), (b"", True), base, base, nothing, nothing, nothing, nothing, nothing)
    if min(counts.get(True, 0), counts.get(False, 0)) < LEAST_PER_LABEL:
        return model
    share = F.when(F.col("good"), F.lit(min(1.0, SAMPLE_PER_LABEL / counts[True]))).otherwise(
        F.lit(min(1.0, SAMPLE_PER_LABEL / counts[False])))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    drawn = stored(known.withColumn("share", share).filter(draw < F.col("share")).select(
        "doc_id", "good", "share", (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)) == 0).alias("trains")), "quality-sample")
    # The sample's rows are bounded by its parameter, so they may be broadcast; repeated documents count once.
    chosen = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    texts = stored(chosen.groupBy("doc_id", "good", "share", "trains").agg(F.min("text").alias("text")), "quality-texts")
    train = texts.filter("trains").select("doc_id", "good", spread_pieces(F.encode("text", "UTF-8"), TRAIN_BYTES).alias("head"))
    heads = sorted((r["doc_id"], r["good"], bytes(r["head"] or b"")) for r in train.collect())
    good, bad = ([h for _, g, h in heads if g is of and h] for of in (True, False))
    model.good, model.bad = _dictionary(good), _dictionary(bad)

    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measured(frames):
        for frame in frames:
            data = [(text or "").encode() for text in frame["text"]]
            found = [shared.value.features(d) if d else (float("nan"),) * 2 for d in data]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "good": frame["good"], "share": frame["share"],
                                "difference": [f[0] for f in found], "per_byte": [f[1] for f in found]})

    rows = sorted(tuple(r) for r in texts.filter("NOT trains").select("doc_id", "good", "share", "text").mapInPandas(
        measured, "doc_id long, good boolean, share double, difference double, per_byte double").collect())
    labelled = np.array([r[1] for r in rows], float)
    weight = np.array([1.0 / r[2] for r in rows])
    measures = np.array([r[3:] for r in rows], float).reshape(-1, 2)
    bare = np.isnan(measures[:, 0])
    model.empty = float((labelled[bare].sum() + 2 * base) / (bare.sum() + 2))
    if len(set(labelled[~bare].tolist())) < 2:
        return model
    model = _calibrated(model, measures[~bare], labelled[~bare])
    # The sample may hold labels in other proportions than the whole: shift the odds back.
    seen = labelled[~bare].mean()
    true = (weight * labelled)[~bare].sum() / weight[~bare].sum()
    model.weights[0] += np.log(true / (1 - true)) - np.log(seen / (1 - seen))
    return model


def with_quality(docs: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """The rows with ``score``, 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(texts: pa.Array) -> pa.Array:
        return pa.array([shared.value.score(value) for value in texts.to_pylist()], pa.float64())

    return docs.withColumn("score", F.arrow_udf(scored, T.DoubleType())(F.col(text)))


@query("op1_quality")
def op1_quality(spark, sf_dir):
    """The quality score of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, read_table(spark, sf_dir, "labels"))
    return with_quality(docs, model).select(
        "doc_id", held_out_fold(F.col("doc_id")).alias("held_out"), "score",
        F.when(F.col("score") >= KEEP, 1).otherwise(0).alias("predicted"))
