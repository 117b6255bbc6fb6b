"""Packing: concatenate and cut.

All documents, each followed by an end id, form one stream that is cut every
``length`` ids. The first pass tokenizes and writes each task's documents with their
offsets within the task and the task's token total; prefix sums over the totals give
every task's global offset. The second pass cuts the ids at the window bounds: a
document that crosses a bound yields a piece on either side. Only the last sequence
is short.

Null and empty texts are the end id alone. Rows with equal ids are packed each for
itself; an empty table gives no piece. The order is the order of the tasks.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pourscale.llm.common import written
from pourscale.llm.tokens import MEMO, TOKENIZER, encoder

LENGTH = 4096
END = 2
PIECE = "doc_id {id}, start bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint, begins boolean, ends boolean"


def tokenized(docs: DataFrame, path: str = TOKENIZER, end: int = END, memo: int = MEMO) -> DataFrame:
    """doc_id, ids (little-endian), n (ids), part (task) and base (ids of the task before it) for each row of docs."""

    def rows(batches):
        own, part, base = encoder(path, memo), TaskContext.get().partitionId(), 0
        last = np.array([end], own.dtype).tobytes()
        for batch in batches:
            ids = [x + last for x in own.encode(batch["text"].to_pylist())]
            n = np.array([len(x) for x in ids], np.int64) // own.dtype.itemsize
            first = base + np.cumsum(n) - n
            base += int(n.sum())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(ids, pa.binary()), pa.array(n), pa.array(np.full(len(n), part)), pa.array(first)], ["doc_id", "ids", "n", "part", "base"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(rows, f"doc_id {kind}, ids binary, n bigint, part bigint, base bigint")


def pack(docs: DataFrame, length: int = LENGTH, path: str = TOKENIZER, end: int = END, memo: int = MEMO) -> DataFrame:
    """The pieces: doc_id, start, ids (little-endian unsigned 32 bit), doc_tokens, sequence_id, offset, and whether the document begins or ends there."""
    found = written(tokenized(docs, path, end, memo), "packing-ids")
    totals = found.groupBy("part").agg(F.sum("n").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task of the first pass
    totals = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    dtype = encoder(path).dtype
    step = dtype.itemsize

    def cut(batches):
        for batch in batches:
            out = []
            for doc, raw, n, at in zip(*(batch[c].to_pylist() for c in ("doc_id", "ids", "n", "at"))):
                start = 0
                while start < n:
                    sequence, offset = divmod(at + start, length)
                    stop = min(n, start + length - offset)
                    piece = np.frombuffer(raw[start * step : stop * step], dtype).astype("<u4").tobytes()
                    out.append((doc, start, piece, n, sequence, offset, start == 0, stop == n))
                    start = stop
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 8, kinds)], names)

    doc = docs.schema["doc_id"].dataType.simpleString()
    schema = PIECE.format(id=doc)
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [None, pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
    placed = found.join(F.broadcast(totals), "part").select("doc_id", "ids", "n", (F.col("base") + F.col("first")).alias("at"))
    kinds[0] = _arrow_type(docs.schema["doc_id"].dataType)
    return placed.mapInArrow(cut, schema)


def _arrow_type(kind):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def sequences(pieces: DataFrame, length: int = LENGTH, pad: int = 0) -> DataFrame:
    """sequence_id, ids (array of length ids) and n_ids before padding; a sequence shorter than length stays so where its length is a power of two.

    A sequence has at most ``length`` pieces.
    """

    def joined(key, group):
        group = group.sort_by("offset")
        ids = np.frombuffer(b"".join(group["ids"].to_pylist()), "<u4").astype(np.int64)
        n = len(ids)
        full = ids if n & (n - 1) == 0 else np.concatenate([ids, np.full(length - n, pad)])
        return pa.table({"sequence_id": [key[0].as_py()], "ids": pa.array([full.tolist()], pa.list_(pa.int64())), "n_ids": [n]})

    return pieces.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInArrow(joined, "sequence_id bigint, ids array<bigint>, n_ids bigint")
