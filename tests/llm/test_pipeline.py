import numpy as np
from pyspark.sql import functions as F
from tables import CLASHING, documents, empty
from tokenizers import Tokenizer

import corpus_pipeline
from pourscale.llm import langid, mixing, packing, secrets, simhash, tokens


def texts():
    words = "the and of thing other water stone house river light".split()
    rng = np.random.default_rng(5)
    made = [" ".join(rng.choice(words, 40 + i % 30)) + f" number{i}" for i in range(60)]
    made[10] += " password=hunter22 user=bob.smith"
    return made + [made[3], made[3] + " ", None, "", "12 34 !!", made[7]]


def test_stages_equal_brute_force(spark, tmp_path):
    all_texts = texts()
    docs = documents(spark, all_texts, sources=["a", "b", "a", None], schema=CLASHING)
    model = langid.fit(docs)
    wanted = [i for i, t in enumerate(all_texts) if not model.nearest(t)[2]]
    assert len(wanted) == 63
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        out = stage(spark, docs, "")
        if name != "packed":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        rows = docs.collect()
        if name == "language":
            assert sorted(r["doc_id"] for r in rows) == wanted
        elif name == "near_duplicates":
            prints = [(r["doc_id"], simhash.fingerprint(r["text"])) for r in sorted(before)]
            first = [i for k, (i, p) in enumerate(prints) if not any(((p ^ q) % (1 << 64)).bit_count() <= 2 for _, q in prints[:k])]
            assert sorted(r["doc_id"] for r in rows) == first  # groups here have no chains
        elif name == "secret_scan":
            assert {r["doc_id"]: r["text"] for r in rows} == {r["doc_id"]: r["text"] if not secrets.scan(r["text"]) else r["text"].split(" password=")[0] + " <assign> <login>" for r in before}
        elif name == "source_mix":
            taken = mixing.mix(spark.createDataFrame(before, docs.schema).withColumn("text_key", F.md5("text")), ["doc_id", "text_key"])[0].collect()
            assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in taken for _ in range(int(r["taken"] / r["mix_size"] + 0.5)))
        else:
            library = Tokenizer.from_file(tokens.TOKENIZER)
            assert sum(r["length"] for r in rows) == sum(len(library.encode(r["text"], add_special_tokens=False).ids) + 1 for r in before)
            assert all(r["sequence_id"] * packing.LENGTH + r["offset"] < sum(x["length"] for x in rows) for r in rows)


def test_stages_on_an_empty_table_and_repeated_rows(spark):
    docs = empty(spark, CLASHING)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0, name
    twice = documents(spark, texts(), schema=CLASHING)
    twice = twice.unionByName(twice)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, twice, "").count() > 0, name


def test_run_equals_the_stages(spark, tmp_path):
    documents(spark, texts()).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= 60
