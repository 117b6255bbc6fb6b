"""Language identification by the nearest of several centroids per language.

A text becomes a normalised TF-IDF vector over hashed byte pairs and triples of its
lower-cased words. Document frequencies are counted over every labelled row. A
language's centroids come from spherical k-means over at most ``sample_rows`` of its
rows, those with the smallest hash of their id; every fourth of these is left out. A
text takes the language of the centroid with the largest cosine.

A short text has a smaller cosine than a long one of its language, so a cosine is
judged by its closeness: its share of the ``usual`` cosine of as many places. Radii are
set by the rows that no centroid was learned from, all of them: the radius of a
language's centroids is ``slack`` times the ``QUANTILE`` of its rows' closeness to
their own language. A text is rejected if its closeness is below the radius or if it
has no letter. A language of fewer than ``LEAST_ROWS`` such rows has the radius of
all languages together; if they are as few together, the learned rows count as well.

Null and empty texts have no letter: language ``und``, score 0, rejected. With no
labelled row every text is ``und`` and rejected. Ties go to the language that sorts
first. Rows with a null language or id are not learned from.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pourscale.llm.common import written

DIMS = 1 << 13
CENTROIDS = 3
#: Parts in which the rows of a language are ranked first.
PARTS = 64
SAMPLE_ROWS = 1500
ROUNDS = 8
SLACK = 0.6
QUANTILE = 0.05
LEAST_ROWS = 20
USUAL_PLACES = 200
STEPS = 1000
LEAST_SHARE = 0.05
UNKNOWN = "und"
_WORD_BYTES = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def gram_counts(text: str | None) -> np.ndarray:
    """Counts of hashed byte pairs and triples; words are parted by one space."""
    words = (text or "").lower().encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()
    if not words:
        return np.zeros(DIMS, np.int64)
    b = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint32)
    pairs = b[:-1] * np.uint32(0x9E3779B1) + b[1:] * np.uint32(0x85EBCA77)
    triples = pairs[:-1] * np.uint32(0xC2B2AE3D) + b[2:] * np.uint32(0x27D4EB2F)
    return np.bincount(np.concatenate([pairs, triples]) >> np.uint32(32 - 13), minlength=DIMS)


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


@dataclass
class Model:
    langs: list[str]  # of each centroid
    centres: np.ndarray  # unit rows
    radius: np.ndarray  # smallest closeness accepted
    idf: np.ndarray

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Places and values of a text's unit vector."""
        counts = gram_counts(text)
        at = np.flatnonzero(counts)
        x = np.log1p(counts[at]) * self.idf[at]
        return at, x / (np.linalg.norm(x) or 1.0)

    def nearest(self, text: str | None) -> tuple[str, float, bool]:
        """Language, cosine from 0 to 1, and whether the text is rejected."""
        if not self.langs or not has_letter(text):
            return UNKNOWN, 0.0, True
        at, x = self.vector(text)
        cos = x @ self.centres[at]
        best = int(cos.argmax())
        return self.langs[best], min(1.0, max(0.0, float(cos[best]))), bool(cos[best] < self.radius[best] * usual(len(at)))

    def closeness(self, text: str | None, lang: str) -> float | None:
        """Largest cosine with a centroid of lang as a share of the usual one; none without a letter or such a centroid."""
        own = [i for i, name in enumerate(self.langs) if name == lang]
        at, x = self.vector(text)
        if not own or not len(at) or not has_letter(text):
            return None
        return float((x @ self.centres[np.ix_(at, own)]).max()) / usual(len(at))


def usual(places: int) -> float:
    """About the cosine of a text that holds so many places with its own language."""
    return (places / (places + USUAL_PLACES)) ** 0.5


def document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """Number of texts and, for each place, of texts that hold it; over all rows."""

    def partial(batches):
        n, found = 0, np.zeros(DIMS, np.int64)
        for batch in batches:
            for text in batch["text"]:
                found += gram_counts(text) > 0
                n += 1
        yield pd.DataFrame({"place": np.arange(-1, DIMS), "n": np.concatenate([[n], found])}).query("n > 0")

    rows = texts.select("text").mapInPandas(partial, "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n"))
    total, found = 0, np.zeros(DIMS, np.int64)
    for r in rows.collect():  # DIMS + 1 rows at most
        if r["place"] < 0:
            total = r["n"]
        else:
            found[r["place"]] = r["n"]
    return total, found


def halves(x: np.ndarray) -> np.ndarray:
    """Whether each row lies above the median along the rows' main direction."""
    mean = x.mean(0)
    v = x[((x @ mean).argmin())] - mean
    for _ in range(10):
        along = x @ v - mean @ v
        v = along @ x - along.sum() * mean
        v /= max(np.linalg.norm(v), 1e-12)
    along = x @ v
    return along > np.median(along) + 1e-6


def cluster(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centres of spherical k-means from halved clusters; none of fewer rows than LEAST_SHARE of its even share."""
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    own = np.zeros(len(x), int)
    for i in range(1, min(k, len(x))):
        at = np.flatnonzero(own == np.bincount(own).argmax())
        upper = halves(x[at])
        if not upper.any():
            break
        own[at[upper]] = i
    for _ in range(rounds):
        rows = np.bincount(own)
        centres = unit(np.array([x[own == i].mean(0) for i in np.flatnonzero(rows >= max(1, LEAST_SHARE * len(x) / k))]))
        own = (x @ centres.T).argmax(1)
    return centres


def fit(docs: DataFrame, centroids: int = CENTROIDS, sample_rows: int = SAMPLE_ROWS, slack: float = SLACK) -> Model:
    """docs: doc_id, text, lang; all rows with an id and a language are learned from."""
    known = docs.select("doc_id", "text", "lang").where("doc_id is not null and lang is not null")
    total, found = document_frequencies(known)
    idf = np.log((1 + total) / (1 + found)) + 1.0
    # the first rows of a language are among the first of its parts: a frequent language is ranked by many tasks
    order, part = [F.xxhash64("doc_id"), F.col("doc_id")], F.pmod(F.hash("doc_id"), F.lit(PARTS)).alias("part")
    first = known.select("doc_id", "lang", part).withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
    first = first.where(F.col("place") <= sample_rows).withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    chosen = first.where((F.col("place") <= sample_rows) & (F.col("place") % 4 > 0)).select("doc_id", "lang").distinct()
    chosen = F.broadcast(written(chosen, "langid-sample"))  # sample_rows rows a language at most
    bare = Model([], np.zeros((0, DIMS), np.float32), np.zeros(0), idf)

    def centres_of(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "text"])  # sums in one order: the same model again
        x = np.zeros((len(group), DIMS), np.float32)
        for row, text in zip(x, group["text"]):
            at, values = bare.vector(text)
            row[at] = values
        x = x[x.any(1)]
        if not len(x):
            return pd.DataFrame({"lang": [], "centre": []})
        return pd.DataFrame({"lang": group["lang"].iloc[0], "centre": [c.tolist() for c in cluster(x, centroids)]})

    rows = known.join(chosen, ["doc_id", "lang"]).select("doc_id", "lang", "text").groupBy("lang").applyInPandas(centres_of, "lang string, centre array<float>").collect()
    rows.sort(key=lambda r: (r["lang"], r["centre"]))
    model = Model([r["lang"] for r in rows], np.ascontiguousarray(np.array([r["centre"] for r in rows], np.float32).reshape(len(rows), DIMS).T), np.zeros(len(rows)), idf)
    lows = least_closeness(model, known.join(chosen, ["doc_id", "lang"], "left_anti"), LEAST_ROWS)
    if rows and not lows:
        lows = least_closeness(model, known, LEAST_ROWS) or least_closeness(model, known, 1)
    model.radius = np.array([slack * lows.get(lang, lows.get(None, 0.0)) for lang in model.langs])
    return model


def least_closeness(model: Model, known: DataFrame, least: int) -> dict[str | None, float]:
    """The QUANTILE of the closeness of each language's rows, in STEPS; under None that of all rows. Groups of fewer than least rows have none."""
    shared = known.sparkSession.sparkContext.broadcast(model)

    def steps(batches):
        for batch in batches:
            found = [(lang, shared.value.closeness(text, lang)) for lang, text in zip(batch["lang"], batch["text"])]
            yield pd.DataFrame([(lang, int(c * STEPS)) for lang, c in found if c is not None], columns=["lang", "step"])

    counts = known.select("lang", "text").mapInPandas(steps, "lang string, step bigint").groupBy("lang", "step").agg(F.count(F.lit(1)).alias("n")).toPandas()
    groups = [(None, counts), *counts.groupby("lang")]
    out = {}
    for lang, group in groups:
        group = group.groupby("step")["n"].sum().sort_index()
        if group.sum() >= least:
            out[lang] = group.index[np.searchsorted(group.cumsum().to_numpy(), QUANTILE * group.sum(), side="right")] / STEPS
    return out


def identify(spark, model: Model):
    """A pandas UDF from text to struct(lang, score, rejected)."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, rejected boolean")
    def nearest(texts: pd.Series) -> pd.DataFrame:
        own = shared.value
        return pd.DataFrame([own.nearest(t) for t in texts], columns=["lang", "score", "rejected"])

    return nearest
