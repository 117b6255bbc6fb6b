import random

import numpy as np
from tables import CLASHING, documents, empty

from pourscale.llm import langid

WORDS = {"aa": "the and of thing other water".split(), "bb": "der und für über straße nicht".split(), "cc": "que é não para você água".split()}


def labelled(n=120):
    rng = random.Random(2)
    langs = sorted(WORDS)
    return [(" ".join(rng.choice(WORDS[langs[i % 3]]) for _ in range(3 + i % 60)), langs[i % 3]) for i in range(n)]


def test_held_out_accuracy_and_defined_cases(spark):
    rows = labelled()
    docs = spark.createDataFrame([(i, t, l if i % 4 else None, "s", 0, *["x"] * 3, *[1] * 5) for i, (t, l) in enumerate(rows)], CLASHING)
    model = langid.fit(docs)
    assert set(model.langs) == set(WORDS)
    odd = [None, "", "123 --- !!", "漢字かな交じり文", "the and of " * 50000, "water\x00of"]
    docs = documents(spark, [t for t, _ in rows] + odd, schema=CLASHING)
    found = {r["doc_id"]: r["f"] for r in docs.select("doc_id", langid.identify(spark, model)("text").alias("f")).collect()}
    assert sum(found[i]["lang"] == rows[i][1] for i in range(0, len(rows), 4)) == len(rows) // 4
    assert not any(found[i]["rejected"] for i in range(len(rows)))
    for i in range(len(rows), len(rows) + 3):
        assert (found[i]["lang"], found[i]["score"], found[i]["rejected"]) == ("und", 0.0, True)
    assert found[len(rows) + 3]["lang"] in WORDS and found[len(rows) + 3]["rejected"]
    assert found[len(rows) + 4]["lang"] == "aa" and all(0 <= f["score"] <= 1 for f in found.values())


def test_document_frequencies_cover_every_row(spark):
    texts = ["ab", "ab ab", None, "", "ba"]
    total, found = langid.document_frequencies(documents(spark, texts))
    assert total == len(texts)
    assert found.tolist() == sum((langid.gram_counts(t) > 0).astype(int) for t in texts).tolist()


def test_nothing_to_learn_from(spark):
    for docs in (empty(spark), documents(spark, ["abc"], langs=[None])):
        assert langid.fit(docs).nearest("some text") == ("und", 0.0, True)


def test_same_model_again(spark):
    docs = documents(spark, [t for t, _ in labelled()], langs=sorted(WORDS))
    a, b = langid.fit(docs), langid.fit(docs)
    assert a.langs == b.langs and (a.centres == b.centres).all()


SYLLABLES = {"aa": "the an ing wat er st ou".split(), "bb": "der ün ich ßen zu auf kl".split(), "cc": "que ção lh es ado mui ve".split(), "dd": "ska och på för jag inte vy".split()}


def sentences(lang, n, seed):
    rng = random.Random(f"{lang}{seed}")
    lexicon = ["".join(rng.choice(SYLLABLES[lang]) for _ in range(1 + i % 3)) for i in range(150)]
    return [" ".join(rng.choice(lexicon) for _ in range(10 + 5 * (i % 30))) for i in range(n)]


def test_what_was_not_learned_is_rejected(spark):
    rng = random.Random(3)
    outliers = ["zzqx " * 9, "kvvw jjq", "aa"]  # no cluster of their own
    rows = [(t, lang) for lang in ("aa", "bb", "cc") for t in sentences(lang, 150, 1) + outliers]
    model = langid.fit(documents(spark, [t for t, _ in rows], langs=[lang for _, lang in rows]))
    clean = [(t, lang) for lang in ("aa", "bb", "cc") for t in sentences(lang, 100, 2)]
    found = [model.nearest(t) for t, _ in clean]
    assert sum(f[0] == lang and not f[2] for f, (_, lang) in zip(found, clean)) >= 0.99 * len(clean)
    letters = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz      ") for _ in range(n)) for n in (60, 300, 2000) for _ in range(40)]
    chinese = ["".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(n)) for n in (20, 100, 700) for _ in range(40)]
    for text in letters + chinese + sentences("dd", 100, 1):
        assert model.nearest(text)[2], text


def test_clusters_hold_many_rows():
    rng = np.random.default_rng(4)
    x = np.abs(rng.normal(1, 0.2, (300, 40)))
    x[:3] = np.eye(40)[:3]  # outliers
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    own = (x @ langid.cluster(x, 3).T).argmax(1)
    assert np.bincount(own).min() >= 15
    assert len(langid.cluster(np.repeat(x[:1], 5, 0), 3)) == 1


def test_radius_is_a_low_quantile_of_rows_not_learned_from(spark):
    rows = [(t, lang) for lang in ("aa", "bb") for t in sentences(lang, 200, 1)]
    docs = documents(spark, [t for t, _ in rows], langs=[lang for _, lang in rows])
    model = langid.fit(docs, sample_rows=40)
    for lang, radius in zip(model.langs, model.radius):
        close = [model.closeness(t, lang) for t, own in rows if own == lang]
        assert langid.SLACK * (min(close) - 0.002) <= radius <= langid.SLACK * sorted(close)[12]
