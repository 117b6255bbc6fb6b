import random
import zlib

import numpy as np
from tables import CLASHING, documents, empty
from tokenizers import Tokenizer

from pourscale.llm import idfile, packing, tokens

TEXTS = [
    "Hello, World!! don't stop", None, "", "ÉTÉ à l'école ß İstanbul ǅ", "x\x1cy \x85 z w v", "été ́a", "<|endoftext|> a<|startoftext|>b", "日本語 text 123 4.5%",
    "under_score `tick` ''s 'tis 're", "😀 emoji‍👩", "w" * 3000, "many words " * 9000, "Σίσυφος ΟΔΟΣ", "Hello, World!! don't stop", "\x00 \x7f", "fiﬁ ª µ",
]


def ids_of(text, library=Tokenizer.from_file(tokens.TOKENIZER)):
    return library.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_the_library():
    rng = random.Random(4)
    pieces = ["the", "Ñandú", "re's", "!!", "***", "\n", "\t", " ", "12", "ÉÈ", "o'clock", "_a", "ﬁ", "̀", "İ", "$$$", "", "ça,"]
    texts = TEXTS + ["".join(rng.choice(pieces) for _ in range(30)) for _ in range(300)]
    own = tokens.TextEncoder()
    assert [np.frombuffer(b, own.dtype).tolist() for b in own.encode(texts)] == [ids_of(t) for t in texts]


def test_encoder_with_small_memo(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO", 3)
    own = tokens.TextEncoder()
    assert [np.frombuffer(b, own.dtype).tolist() for b in own.encode(TEXTS)] == [ids_of(t) for t in TEXTS]


def test_other_tokenizers_go_through_the_library():
    import public_tokenizers

    own = tokens.TextEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert not own.by_parts
    assert [np.frombuffer(b, own.dtype).tolist() for b in own.encode(TEXTS)] == [ids_of(t, own.library) for t in TEXTS]


def test_packing_round_trip(spark):
    docs = documents(spark, TEXTS, schema=CLASHING).repartition(3)
    for length in (7, 4096):
        pieces = packing.pack(docs, length)
        rows = pieces.collect()
        joined, at = {}, {}
        for r in sorted(rows, key=lambda r: r["start"]):
            got = joined.setdefault(r["doc_id"], [])
            assert len(got) == r["start"]
            got += np.frombuffer(bytes(r["ids"]), "<u4").tolist()
            assert r["begins"] == (r["start"] == 0) and r["ends"] == (len(got) == r["doc_tokens"])
        assert joined == {i: ids_of(t) + [2] for i, t in enumerate(TEXTS)}
        for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
            assert r["offset"] == at.get(r["sequence_id"], 0)
            at[r["sequence_id"]] = r["offset"] + len(r["ids"]) // 4
        assert sorted(at) == list(range(len(at))) and all(at[s] == length for s in range(len(at) - 1)) and at[len(at) - 1] <= length
        full = {r["sequence_id"]: r for r in packing.sequences(pieces, length).collect()}
        assert sum(r["n_ids"] for r in full.values()) == sum(map(len, joined.values()))
        assert all(len(r["ids"]) == (r["n_ids"] if r["n_ids"] & (r["n_ids"] - 1) == 0 else length) for r in full.values())


def test_packing_repeated_rows_and_empty_table(spark):
    docs = documents(spark, ["a b", None])
    rows = packing.pack(docs.unionByName(docs)).collect()
    assert len(rows) == 4 and {r["sequence_id"] for r in rows} == {0}
    assert packing.pack(empty(spark)).count() == 0
    assert packing.sequences(packing.pack(empty(spark))).count() == 0


def test_rank_coding_round_trip():
    rng = np.random.default_rng(0)
    for ranks in ([], [0], [255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1], rng.integers(0, 1 << 20, 1001), rng.integers(0, 200, 4096)):
        ranks = np.array(ranks, np.uint32)
        control, data = idfile.encode_ranks(ranks)
        assert len(control) == -(-len(ranks) // 4) and (idfile.decode_ranks(control, data, len(ranks)) == ranks).all()
    assert len(data) == 4096  # one byte for each frequent id


def test_files_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(idfile, "BLOCK_IDS", 50)
    docs = documents(spark, TEXTS, schema=CLASHING)
    docs = docs.unionByName(docs.limit(1)).repartition(3)
    files = idfile.write_ids(docs, f"{tmp_path}/ids")
    assert files.agg({"docs": "sum"}).first()[0] == len(TEXTS) + 1
    rows = sorted(idfile.read_ids(spark, f"{tmp_path}/ids").collect(), key=lambda r: (r["doc_id"], r["start"]))
    start = 0
    for i, r in zip([0, *range(len(TEXTS))], rows, strict=True):
        ids = np.array(ids_of(TEXTS[i]) + [1], "<u4")
        assert (r["doc_id"], r["start"], zlib.crc32(bytes(r["ids"]))) == (i, start, zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_files_of_an_empty_table_and_null_ids(spark, tmp_path):
    idfile.write_ids(empty(spark), f"{tmp_path}/none")
    assert idfile.read_ids(spark, f"{tmp_path}/none").count() == 0
    docs = spark.createDataFrame([(None, "b"), (-5, "a")], "doc_id bigint, text string")
    idfile.write_ids(docs, f"{tmp_path}/nulls")
    rows = sorted(idfile.read_ids(spark, f"{tmp_path}/nulls").collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, -5]
