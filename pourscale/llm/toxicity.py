"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct words, word pairs and pairs with one word between them,
hashed to 2**BITS places. At most ``max_rows`` labelled rows (those with the smallest
hash of their id) are dealt to shards; each shard learns with per-coordinate rates
and L1 sparsity, and a coordinate's weight is the mean over the shards that saw it,
weighted by their sums of squared gradients. The non-zero weights, at most 2**BITS,
are broadcast to score every whole text.

Null and empty texts score the bare bias. A null label or id is not learned from; an
id with several labels counts as toxic if one of them is. With no labelled row all
weights are 0 and every score 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 20
MAX_ROWS = 40_000
SHARD_ROWS = 10_000
EPOCHS = 5
ALPHA, BETA, L1, L2 = 2.0, 1.0, 12.0, 0.0
TOXIC_WEIGHT = 4.0  # of a toxic row's gradient: they are few
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def features(text: str | None) -> np.ndarray:
    """Places of all words, pairs and skip-pairs, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()
    h = np.fromiter(map(crc32, words), np.uint32, len(words)) * np.uint32(0x9E3779B1)
    pairs = (h[:-1] ^ np.uint32(0x5BD1E995)) * np.uint32(0x85EBCA77) + h[1:]
    skips = (h[:-2] ^ np.uint32(0x1B873593)) * np.uint32(0xC2B2AE3D) + h[2:]
    return np.concatenate([h, pairs, skips]) >> np.uint32(32 - BITS)


@dataclass
class Learner:
    """FTRL-proximal state; the last place is the bias, which has no L1."""

    alpha: float = ALPHA
    beta: float = BETA
    l1: float = L1
    l2: float = L2
    toxic_weight: float = TOXIC_WEIGHT

    def __post_init__(self):
        self.z, self.n = np.zeros(2**BITS + 1), np.zeros(2**BITS + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == 2**BITS, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        g *= self.toxic_weight if label else 1.0
        grown = self.n[at] + g * g
        self.z[at] += g - (np.sqrt(grown) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] = grown


def _learn_shard(group: pd.DataFrame, epochs: int) -> pd.DataFrame:
    group = group.sort_values(["place", "doc_id"])
    rows = [np.append(np.unique(features(t)), 2**BITS).astype(np.int64) for t in group["text"]]
    learner = Learner()
    for _ in range(epochs):
        for at, label in zip(rows, group["toxic"]):
            learner.learn(at, int(label))
    at = np.flatnonzero(learner.n)
    return pd.DataFrame({"at": at, "n": learner.n[at], "w": learner.weights(at)})


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, shard_rows: int = SHARD_ROWS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights of 2**BITS places and the bias. docs: doc_id, text; labels: doc_id, toxic."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.withColumn("place", F.xxhash64("doc_id")).orderBy("place", "doc_id").limit(max_rows)
    shards = max(1, -(-known.count() // shard_rows))
    dealt = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").withColumn("shard", F.pmod(F.xxhash64("place"), F.lit(shards)))
    states = dealt.groupBy("shard").applyInPandas(lambda g: _learn_shard(g, epochs), "at bigint, n double, w double")
    merged = states.groupBy("at").agg((F.sum(F.col("n") * F.col("w")) / F.sum("n")).alias("w")).where("w <> 0").toPandas()
    weights = np.zeros(2**BITS + 1)
    weights[merged["at"]] = merged["w"]
    return weights


def score(weights: np.ndarray, text: str | None) -> float:
    at = features(text)
    total = weights[np.unique(at[weights[at] != 0])].sum() + weights[-1]
    return float(1 / (1 + np.exp(-np.clip(total, -35, 35))))


def scorer(spark, weights: np.ndarray):
    """A pandas UDF from text to a score from 0 to 1."""
    at = np.flatnonzero(weights)
    shared = spark.sparkContext.broadcast((at.astype(np.int32), weights[at]))

    @F.pandas_udf("double")
    def toxicity(texts: pd.Series) -> pd.Series:
        own = np.zeros(2**BITS + 1)
        own[shared.value[0]] = shared.value[1]
        return pd.Series([score(own, t) for t in texts], dtype="float64")

    return toxicity
