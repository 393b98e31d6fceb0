"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct byte n-grams of the lower-cased text, hashed. Of a
bounded sample of labelled texts, Spark counts each feature's texts by label; the
logarithm of the ratio of the two smoothed shares is the feature's scale. The
features with the largest scale, times the root of their number of texts, enter a
logistic regression, trained in numpy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from haltscope.llm.common import stored

BITS = 20
SIZES = (4, 5, 6)
#: Labelled texts per label that the classifier may see: a bounded sample by hashed id.
SAMPLE = 4000
#: Features that enter the regression.
FEATURES = 2048
#: Texts a feature must occur in.
MIN_TEXTS = 5
SMOOTHING = 1.0
THRESHOLD = 0.3
_PRIMES = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0x2545F491], dtype=np.uint64)


def is_held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def grams(text: bytes) -> np.ndarray:
    """Hashes below 2**BITS of all n-grams of a text, repeats included; white space is one blank."""
    data = np.frombuffer(b" " + b" ".join(text.lower().split()) + b" ", np.uint8).astype(np.uint64)
    out = []
    for n in SIZES:
        if len(data) >= n:
            h = np.zeros(len(data) - n + 1, np.uint64)
            for k in range(n):
                h = (h ^ data[k:len(data) - n + 1 + k]) * _PRIMES[k]
                h ^= h >> np.uint64(29)
            out.append(((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int32))
    return np.concatenate(out) if out else np.empty(0, np.int32)


def _sample(docs: DataFrame, labels: DataFrame, size: int) -> DataFrame:
    """At most ``size`` labelled texts per label, those with the smallest hashed id."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id"))).select("doc_id", "toxic")
    some = [known.filter(F.col("toxic") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size) for v in (0, 1)]
    picked = some[0].unionByName(some[1]).distinct()
    # At most 2 * size ids, so the small side is safe to send to every task.
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("toxic", F.coalesce("text", F.lit("")).alias("text"))


def _scales(sample: DataFrame, features: int) -> dict[int, float]:
    """The log-count ratios of the features with the largest ones; counting is Spark's, at most ``features`` rows come back."""

    def count(batches):
        total = np.zeros((2, 1 << BITS), np.int32)
        for batch in batches:
            for label, text in zip(batch.column("toxic").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                total[label, np.unique(grams(text))] += 1
        at = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0, at]), pa.array(total[1, at])], ["feature", "clean", "toxic"])

    texts = sample.groupBy().agg(F.sum(1 - F.col("toxic")).alias("c"), F.sum("toxic").alias("t")).first()
    n_clean, n_toxic = (texts["c"] or 0), (texts["t"] or 0)
    counts = sample.mapInArrow(count, "feature long, clean int, toxic int").groupBy("feature").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).filter(F.col("clean") + F.col("toxic") >= MIN_TEXTS)
    share = lambda c, n: (F.col(c) + F.lit(SMOOTHING)) / F.lit(n + 2 * SMOOTHING)
    rows = counts.select("feature", F.log(share("toxic", n_toxic) / share("clean", n_clean)).alias("r"),
                         F.sqrt(F.col("clean") + F.col("toxic")).alias("sure"))
    return {x["feature"]: x["r"] for x in rows.orderBy((F.abs("r") * F.col("sure")).desc(), "feature").limit(features).collect()}


def _train(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, steps: int = 500) -> tuple[np.ndarray, float]:
    """Logistic regression by accelerated gradient steps; the step length comes from the largest row."""
    w, b, y = np.zeros(x.shape[1], np.float32), 0.0, y.astype(np.float32)
    ahead_w, ahead_b = w, b
    step = float(4.0 / (np.square(x).sum(axis=1).max(initial=0.0) + 1.0))
    for k in range(steps):
        p = (1.0 / (1.0 + np.exp(-np.clip(x @ ahead_w + ahead_b, -30, 30)))).astype(np.float32)
        new_w = (ahead_w - step * ((p - y) @ x / len(y) + penalty * ahead_w)).astype(np.float32)
        new_b = ahead_b - step * float((p - y).mean())
        speed = k / (k + 3.0)
        ahead_w, ahead_b = (new_w + speed * (new_w - w)).astype(np.float32), new_b + speed * (new_b - b)
        w, b = new_w, new_b
    return w, b


class ToxicityModel:
    """Weights by hashed feature (zero for most) and an intercept."""

    def __init__(self, weights: np.ndarray, intercept: float):
        self.weights, self.intercept = weights, intercept
        self.used = weights != 0

    def score(self, text: bytes) -> float:
        found = grams(text)
        margin = self.intercept + float(self.weights[np.unique(found[self.used[found]])].sum())
        return float(1.0 / (1.0 + np.exp(-np.clip(margin, -30, 30))))


def train_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES) -> ToxicityModel:
    """Fit on labelled texts that are not held out; without both labels the score is the share of label 1 (0.5 without labels)."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
    n = known.groupBy().agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).first()
    n_all, n_toxic = n["n"], n["t"] or 0
    prior = float(np.log((n_toxic + 0.5) / (n_all - n_toxic + 0.5)))
    weights = np.zeros(1 << BITS)
    some = stored(_sample(docs, labels, sample), "toxicity-sample")
    scales = _scales(some, features)
    place = np.full(1 << BITS, -1, np.int32)
    order = sorted(scales)
    place[order] = np.arange(len(order))

    def present(batches):
        for batch in batches:
            found = [np.unique(place[grams(t)]) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([f[f >= 0].tobytes() for f in found], pa.binary())], ["toxic", "at"])

    # Bounded: 2 * sample rows of at most ``features`` small numbers.
    rows = sorted((r["toxic"], bytes(r["at"])) for r in some.mapInArrow(present, "toxic int, at binary").collect())
    y = np.array([r[0] for r in rows], float)
    if not order or not 0 < y.sum() < len(y):
        return ToxicityModel(weights, prior)
    x = np.zeros((len(rows), len(order)), np.float32)
    r = np.array([scales[f] for f in order], np.float32)
    for k, (_, at) in enumerate(rows):
        on = np.frombuffer(at, np.int32)
        x[k, on] = r[on]
    w, b = _train(x, y)
    weights[order] = w * r
    # The sample holds more of one label than the corpus does.
    return ToxicityModel(weights, b + prior - float(np.log(y.sum() / (len(y) - y.sum()))))


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every text.

    Only the text enters the score. A null text is empty and has a score too.
    Repeated rows score alike, other columns are ignored, an empty table gives no
    rows. Labels other than 0 and 1 and labels without a document are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS weights, whatever the corpus

    def judge(batches):
        for batch in batches:
            score = [sent.value.score(t or b"") for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64())], ["doc_id", "score"])

    rows = docs.select("doc_id", "text")
    out = rows.mapInArrow(judge, f"doc_id {dict(rows.dtypes)['doc_id']}, score double")
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score",
                      F.when(F.col("score") >= F.lit(threshold), 1).otherwise(0).alias("predicted"))
