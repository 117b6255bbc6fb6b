"""Token-id files: frequency-ranked ids in a byte-aligned variable-length coding.

Ids are replaced by their rank of frequency over the whole corpus, so that common
ones take one byte. Every four ranks share a control byte of four two-bit lengths;
control bytes lie apart from the data bytes, and a control byte looks up the four
lengths in a table when numpy decodes. A file holds a range of documents in ascending
doc_id order: ``MAGIC``, then blocks of at most ``BLOCK_IDS`` ids (or one longer
document), each with a header (documents, ids, control bytes, data bytes), the ids of
its documents, their lengths, control bytes and data bytes. The rank table and the
list of files, with the number of ids before each, are tables beside them; a file
counts once its task is listed, so a repeated task leaves nothing behind that is read.

Null and empty texts are the end id alone; rows with equal ids lie next to each
other; null ids come first. An empty table writes no document.
"""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pourscale.llm.common import written
from pourscale.llm.packing import tokenized
from pourscale.llm.tokens import TOKENIZER, encoder

MAGIC = b"RANKVB01"
HEADER = "<4Q"
END = 1
BLOCK_IDS = 1 << 18
FILE_BYTES = 128 << 20
_NO_ID = np.iinfo(np.int64).min
#: For each control byte the lengths of its four ranks.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.int64) + 1


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit ranks."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    more = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    padded[: len(ranks)] = more
    four = padded.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    used = np.arange(4) <= more[:, None]
    return control.tobytes(), ranks.view(np.uint8).reshape(-1, 4)[used].tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ranks that encode_ranks has written."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    starts = np.cumsum(lengths) - lengths
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = raw[starts].astype(np.uint32)
    for k in (1, 2, 3):
        longer = np.flatnonzero(lengths > k)
        out[longer] |= raw[starts[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _blocks(batches, dtype):
    """(doc ids, lengths, ids) of at most BLOCK_IDS ids or one document."""
    docs, lengths, ids, total = [], [], [], 0
    for batch in batches:
        for doc, raw in zip(batch["doc_id"].to_pylist(), batch["ids"].to_pylist()):
            n = len(raw) // dtype.itemsize
            if docs and total + n > BLOCK_IDS:
                yield docs, lengths, np.frombuffer(b"".join(ids), dtype)
                docs, lengths, ids, total = [], [], [], 0
            docs.append(_NO_ID if doc is None else doc)
            lengths.append(n)
            ids.append(raw)
            total += n
    if docs:
        yield docs, lengths, np.frombuffer(b"".join(ids), dtype)


def rank_table(tokens: DataFrame, dtype: np.dtype) -> DataFrame:
    """id and rank (0 is the most frequent, ties to the smaller id) of every id in the corpus; at most the vocabulary's rows."""

    def counted(batches):
        counts = np.zeros(0, np.int64)
        for batch in batches:
            for raw in batch["ids"].to_pylist():
                more = np.bincount(np.frombuffer(raw, dtype), minlength=len(counts))
                more[: len(counts)] += counts
                counts = more
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(counts)), pa.array(counts[counts > 0])], ["id", "n"])

    counts = tokens.select("ids").mapInArrow(counted, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    return counts.select("id", (F.row_number().over(Window.orderBy(F.desc("n"), "id")) - 1).cast("bigint").alias("rank"))


def write_ids(docs: DataFrame, folder: str, path: str = TOKENIZER, end: int = END, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the files of docs below folder; returns the list of files: file, part, docs, ids."""
    tokens = written(tokenized(docs, path, end).select("doc_id", "ids"), "idfile-ids", "zstd")
    dtype = encoder(path).dtype
    ranks = rank_table(tokens, dtype).toPandas()
    rank_of = np.zeros(int(ranks["id"].max()) + 1 if len(ranks) else 1, np.uint32)
    rank_of[ranks["id"]] = ranks["rank"]
    spark = docs.sparkSession
    spark.createDataFrame(ranks if len(ranks) else [], "id bigint, rank bigint").write.parquet(f"{folder}/ranks")
    shared = spark.sparkContext.broadcast(rank_of)

    def save(batches):
        part, name = TaskContext.get().partitionId(), f"{folder}/ids-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.bin"
        store, where = fs.FileSystem.from_uri(name)
        n_docs = n_ids = 0
        out = None
        for doc_ids, lengths, ids in _blocks(batches, dtype):
            if out is None:
                store.create_dir(where.rpartition("/")[0])
                out = store.open_output_stream(where)
                out.write(MAGIC)
            control, data = encode_ranks(shared.value[ids])
            out.write(struct.pack(HEADER, len(doc_ids), len(ids), len(control), len(data)))
            out.write(np.array(doc_ids, "<i8").tobytes() + np.array(lengths, "<u8").tobytes())
            out.write(control)
            out.write(data)
            n_docs, n_ids = n_docs + len(doc_ids), n_ids + len(ids)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in ([name], [part], [n_docs], [n_ids])], ["file", "part", "docs", "ids"])

    size = tokens.agg(F.coalesce(F.sum(F.length("ids")), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // file_bytes))
    ordered = tokens.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(save, "file string, part bigint, docs bigint, ids bigint").write.parquet(f"{folder}/files")
    return spark.read.parquet(f"{folder}/files")


def read_ids(spark, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids (little-endian unsigned 32 bit) of each document, from the files below folder."""
    ranks = spark.read.parquet(f"{folder}/ranks").toPandas()  # at most the vocabulary's rows
    id_of = np.zeros(len(ranks), "<u4")
    id_of[ranks["rank"]] = ranks["id"]
    shared = spark.sparkContext.broadcast(id_of)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    files = spark.read.parquet(f"{folder}/files").withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0)))

    def load(batches):
        for batch in batches:
            for name, base in zip(batch["file"].to_pylist(), batch["base"].to_pylist()):
                store, where = fs.FileSystem.from_uri(name)
                with store.open_input_stream(where) as f:
                    if f.read(len(MAGIC)) != MAGIC:
                        raise ValueError(f"{name} is no token-id file")
                    while head := f.read(struct.calcsize(HEADER)):
                        n_docs, n_ids, n_control, n_data = struct.unpack(HEADER, head)
                        docs, lengths = np.frombuffer(f.read(8 * n_docs), "<i8"), np.frombuffer(f.read(8 * n_docs), "<u8").astype(np.int64)
                        raw = shared.value[decode_ranks(f.read(n_control), f.read(n_data), n_ids)].tobytes()
                        stops = np.cumsum(lengths)
                        texts = [raw[4 * a : 4 * b] for a, b in zip(stops - lengths, stops)]
                        yield pa.RecordBatch.from_arrays([pa.array(docs, mask=docs == _NO_ID), pa.array(base + stops - lengths), pa.array(texts, pa.binary())], ["doc_id", "start", "ids"])
                        base += n_ids

    listed = files.select("file", "base")
    return listed.repartition(max(1, min(listed.count(), 4096)), "file").mapInArrow(load, "doc_id bigint, start bigint, ids binary")
