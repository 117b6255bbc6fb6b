import random

import numpy as np
from pyspark.sql import functions as F
from tables import CLASHING, documents, empty

from pourscale.llm import toxicity


def make(n=600):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(30)]
        if toxic := i % 7 == 0:
            text[rng.randrange(30)] = "nasty"
            text[rng.randrange(30)] = "vile"
        rows.append((" ".join(text), int(toxic)))
    return rows


def test_held_out_rows(spark):
    rows = make()
    docs = documents(spark, [t for t, _ in rows] + [None, "", "NASTY vile " * 40000], schema=CLASHING)
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows) if i % 3] + [(None, 1), (7, None)], "doc_id bigint, toxic int")
    for shard_rows in (10_000, 150):
        weights = toxicity.fit(docs, labels, shard_rows=shard_rows)
        assert 0 < np.count_nonzero(weights) < 2000  # sparse
        found = {r["doc_id"]: r["s"] for r in docs.select("doc_id", toxicity.scorer(spark, weights)("text").alias("s")).collect()}
        held = range(0, len(rows), 3)
        toxic, clean = [found[i] for i in held if rows[i][1]], [found[i] for i in held if not rows[i][1]]
        assert min(toxic) > max(clean) and sum(s >= 0.7 for s in toxic) >= 0.8 * len(toxic) and not any(s >= 0.7 for s in clean)
        assert found[len(rows)] == found[len(rows) + 1] < 0.7 <= found[len(rows) + 2]


def test_no_labels(spark):
    weights = toxicity.fit(empty(spark), spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert not weights.any() and toxicity.score(weights, "any text") == 0.5 == toxicity.score(weights, None)


def test_max_rows_bounds_the_sample(spark):
    docs = documents(spark, ["a b c"] * 50)
    labels = docs.select("doc_id", F.lit(1).alias("toxic"))
    learner = toxicity.Learner()
    at = np.append(np.unique(toxicity.features("a b c")), 2**toxicity.BITS).astype(np.int64)
    for _ in range(10 * toxicity.EPOCHS):
        learner.learn(at, 1)
    weights = toxicity.fit(docs, labels, max_rows=10)
    assert np.allclose(weights[at], learner.weights(at))
