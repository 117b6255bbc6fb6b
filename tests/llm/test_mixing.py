import re
from collections import defaultdict

import numpy as np
from tables import CLASHING, documents, empty

from pourscale.llm import mixing

KEYS = ["doc_id"]


def make(spark, n=300, sources=("b", "a", "a", "a", None, "ü")):
    texts = [" ".join(["w"] * (i * 7 % 53)) if i % 50 else None for i in range(n)] + ["", " \x0b\x1c ", "w " * 30000]
    return documents(spark, texts, sources=list(sources), schema=CLASHING), texts


def test_targets_by_hand():
    assert mixing.capped_targets([100, 100, 10], [1, 1, 2], 200).tolist() == [90, 90, 20]
    assert mixing.capped_targets([10, 10], [1, 3], 100).tolist() == [20, 20]
    assert mixing.capped_targets([0, 5], [1, 1], 5).tolist() == [0, 5]


def test_taken_words_meet_the_targets(spark):
    docs, texts = make(spark)
    for block in (16, 1024):
        rows, schedule = mixing.mix(docs, KEYS, block_words=block)
        rows = rows.collect()
        assert len(rows) == len(texts)
        got, size, target = defaultdict(int), defaultdict(int), {}
        for r in rows:
            assert r["mix_size"] == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r["doc_id"]] or "")) and 0 <= r["taken"] <= 2 * r["mix_size"]
            got[r["mix_source"]] += r["taken"]
            size[r["mix_source"]] += r["mix_size"]
            target[r["mix_source"]] = r["target"]
        order = sorted(size, key=lambda s: (s is None, s or ""))
        wanted = mixing.capped_targets([size[s] for s in order], [(3, 1, 2)[i % 3] for i in range(len(order))], 1.5 * sum(size.values()))
        assert np.allclose([target[s] for s in order], wanted)
        assert all(abs(got[s] - target[s]) <= 1 for s in order)
        assert all(r["source_size"] == size[r["mix_source"]] for r in rows)
        slots = sorted((tuple(r) for r in schedule.select("slot", "mix_source", "pass", "block").collect()), key=lambda s: s[0])
        assert len({s[0] for s in slots}) == len(slots) == len({s[1:] for s in slots})


def test_every_stretch_is_near_the_mix(spark):
    targets = np.array([50.0, 30.0, 20.0])
    slots = mixing.slot_ranks(spark, targets, np.array([500, 300, 200])).orderBy("slot").toPandas()
    assert slots.groupby("src")["rank"].apply(lambda r: sorted(r) == list(range(len(r)))).all()
    for start in range(0, 900, 100):
        part = slots["src"].iloc[start : start + 100].value_counts(normalize=True)
        assert all(abs(part[i] - targets[i] / 100) < 0.05 for i in range(3))


def test_reruns_agree(spark):
    docs, _ = make(spark)
    runs = [sorted((r["doc_id"], r["taken"]) for r in mixing.mix(d, KEYS)[0].collect()) for d in (docs, docs.repartition(5))]
    assert runs[0] == runs[1]


def test_repeated_rows_and_empty_table(spark):
    docs, texts = make(spark, 20)
    rows = mixing.mix(docs.unionByName(docs), KEYS)[0].collect()
    assert len(rows) == 2 * len(texts) and all(r["taken"] <= 2 * r["mix_size"] for r in rows)
    assert mixing.mix(empty(spark), KEYS)[0].count() == 0
    assert mixing.mix(documents(spark, [None, ""]), KEYS)[0].collect()[0]["taken"] == 0
