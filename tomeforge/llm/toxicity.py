"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_hash, table

ORDERS = (3, 4, 5)
BUCKET_BITS = 21
#: Bounds of the fit: rows per class, characters of a row that may be drawn, features kept.
PER_CLASS, MAX_CHARS, FEATURES = 1500, 10_000, 30_000
THRESHOLD = 0.7
#: Code points that are scored at a time; it changes no score.
PIECE = 1 << 18


def coded(text: str | None) -> np.ndarray:
    """Code points of the lower-cased text with one space at either end."""
    return np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)


def ngram_buckets(codes: np.ndarray) -> np.ndarray:
    """Hash buckets of all 3- to 5-grams of code points."""
    prime, spread, shift = np.uint32(16777619), np.uint32(2654435761), np.uint32(32 - BUCKET_BITS)
    found, value = [], codes
    for n in range(2, ORDERS[-1] + 1):
        if len(codes) < n:
            break
        value = value[:-1] * prime + codes[n - 1 :]
        if n in ORDERS:
            found.append(((value + np.uint32(n)) * spread) >> shift)
    return np.concatenate(found) if found else np.empty(0, np.uint32)


@dataclass
class Model:
    """Buckets of the kept features, their weights (already scaled by the ratios) and the bias."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float

    def scorer(self):
        slot = np.zeros(1 << BUCKET_BITS, np.uint16)
        slot[self.buckets] = np.arange(1, len(self.buckets) + 1, dtype=np.uint16)
        weights = np.concatenate([[0.0], self.weights])
        seen = np.zeros(len(weights), bool)

        def score(text: str | None) -> float:
            seen[:] = False
            codes = coded(text)
            for at in range(0, len(codes), PIECE):  # pieces overlap so that each n-gram is whole in one
                seen[slot[ngram_buckets(codes[at : at + PIECE + ORDERS[-1] - 1])]] = True
            return float(1 / (1 + np.exp(-np.clip(self.bias + weights[seen].sum(), -30, 30))))

        return score


def fit(texts: list[str], labels: list[int], rounds: int = 120, decay: float = 1e-3) -> Model:
    """Fit on a bounded list of texts. With one class only, the model scores everything near that class."""
    y = np.array(labels, np.float32)
    rows = [np.unique(ngram_buckets(coded(x))) for x in texts]
    counts = np.zeros((2, 1 << BUCKET_BITS), np.float32)
    for row, label in zip(rows, labels):
        counts[label, row] += 1
    df = counts.sum(axis=0)
    able = np.flatnonzero(df >= 2)
    clean, toxic = counts[0, able] + 1, counts[1, able] + 1
    ratio = np.log((toxic / (len(y[y == 1]) + 2)) / (clean / (len(y[y == 0]) + 2)))
    best = np.argsort(-np.abs(ratio) * np.sqrt(df[able]), kind="stable")[:FEATURES]
    able, ratio = able[best], ratio[best].astype(np.float32)
    slot = np.full(1 << BUCKET_BITS, -1, np.int32)
    slot[able] = np.arange(len(able))
    parts = []
    rows.reverse()
    while rows:  # the full rows go as their kept features come
        kept = slot[rows.pop()]
        parts.append(kept[kept >= 0])
    del counts, df, slot
    sizes = np.array([len(x) for x in parts], np.int64)
    owner, index = np.repeat(np.arange(len(parts), dtype=np.int32), sizes), np.concatenate([*parts, np.empty(0, np.int32)])
    del parts
    scale = ratio[index]
    rate = y.mean() if len(y) else 0.0
    w = np.zeros(len(able), np.float32)
    bias = float(np.log((rate + 1e-3) / (1 - rate + 1e-3)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, rounds + 1 if len(able) else 1):
        z = np.bincount(owner, w[index] * scale, len(y)) + bias
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        gradient = np.bincount(index, error[owner] * scale, len(w)).astype(np.float32) + decay * w / len(y) * 100
        slope = float(error.sum())
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        mb, vb = 0.9 * mb + 0.1 * slope, 0.99 * vb + 0.01 * slope**2
        a, b = 1 - 0.9**step, 1 - 0.99**step
        w -= 0.01 * (m / a) / (np.sqrt(v / b) + 1e-8)
        bias -= 0.05 * (mb / a) / (np.sqrt(vb / b) + 1e-8)
    return Model(able, (w * ratio).astype(np.float64), bias)


def train(docs: DataFrame, labels: DataFrame, usable: Column | None = None) -> Model:
    """Fit on at most ``PER_CLASS`` labelled documents of each class, drawn by a hash of their id.

    Only ids for which ``usable`` (over doc_id) holds are drawn, and no texts longer
    than ``MAX_CHARS``. Rows without text or label are left out. An id counts once,
    before any are drawn: as toxic if one of its labels is, and with the least of its texts.
    """
    labels = labels.select("doc_id", "toxic").where("toxic in (0, 1)")
    if usable is not None:
        labels = labels.where(usable)
    labels = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("draw", F.xxhash64("doc_id", F.lit(6)))
    drawn = [labels.where(F.col("toxic") == k).orderBy("draw", "doc_id").limit(2 * PER_CLASS) for k in (0, 1)]
    drawn = F.broadcast(drawn[0].unionByName(drawn[1]))  # at most 4 * PER_CLASS rows of two numbers
    texts = docs.select("doc_id", "text").where(F.length("text") <= MAX_CHARS).join(drawn, "doc_id")
    texts = texts.groupBy("doc_id", "toxic", "draw").agg(F.min("text").alias("text"))
    parts = [texts.where(F.col("toxic") == k).orderBy("draw", "doc_id").limit(PER_CLASS) for k in (0, 1)]
    rows = {x.doc_id: (x.text, x.toxic) for x in parts[0].unionByName(parts[1]).collect()}
    kept = [rows[k] for k in sorted(rows)]
    return fit([x[0] for x in kept], [x[1] for x in kept])


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Add the toxicity of the whole text, 0 to 1. Null and empty texts get the score of an empty text."""
    made: dict = {}

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if "f" not in made:
            made["f"] = model.scorer()
        for batch in batches:
            yield pa.array([made["f"](x.as_py()) for x in batch], pa.float64())

    return df.withColumn(out, scored.asNondeterministic()(F.col(f"`{text}`")))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"), id_hash() % 3 != 1)
    scored = score(docs, model).select("doc_id", (id_hash() % 3 == 1).alias("held_out"), "score")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


QUERIES = {"op6_toxicity": op6_toxicity}
ORACLES: dict[str, str] = {}
