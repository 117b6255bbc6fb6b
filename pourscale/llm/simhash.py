"""SimHash near duplicates over pigeonhole blocks.

A fingerprint holds the majority of each bit over the hashes of a text's shingles.
Two fingerprints within ``distance`` bits agree on all but ``distance`` of the
``blocks`` blocks they are cut into, so they meet under one of the keys made of
``blocks - distance`` blocks. Keys are joined on distinct fingerprints: copies have
collapsed before. A key with over ``bucket`` fingerprints is dealt out in chunks;
each pair of chunks is a task of its own that returns a spanning forest of its
links, so that no group's pairs are written out. Links become components by
alternating large-star and small-star steps, each written to the shared folder.

Null texts count as empty; texts without words have fingerprint 0 and link like
any other. Rows with equal ids and texts are rows of one component. A null id never
becomes a component id unless a component holds no other.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pourscale.llm.common import text_digest, unused, written
from pourscale.llm.ordered import spread_join

WORDS = 3
SEED = 42
DISTANCE = 2
BLOCKS = 5
BUCKET = 256


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """64-bit fingerprint of the word shingles, repeats included."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    runs = zip(*(w[i:] for i in range(words))) if len(w) >= words else [w]
    hashes = np.array([xxhash.xxh64_intdigest(b" ".join(x), SEED) for x in runs], ">u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="int64")


def fingerprints(text: str):
    return F.pandas_udf(_fingerprints, "bigint")(text)


def block_masks(blocks: int = BLOCKS, distance: int = DISTANCE) -> list[int]:
    """For each choice of blocks - distance blocks the mask of their bits, as a signed 64-bit number."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    of = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(blocks)]
    masks = [sum(of[i] for i in chosen) for chosen in combinations(range(blocks), blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _forest(group: pd.DataFrame, distance: int) -> pd.DataFrame:
    """Links that join all of a chunk pair's fingerprints that its links join: fewer than it has fingerprints."""
    x = np.unique(group["fp"].to_numpy(np.int64)).view(np.uint64)
    left, made = np.ones(len(x), bool), []
    for start in range(len(x)):
        if not left[start]:
            continue
        left[start], queue = False, [start]
        while queue:
            at = queue.pop()
            hit = np.flatnonzero(left & (np.bitwise_count(x ^ x[at]) <= distance))
            left[hit] = False
            queue += hit.tolist()
            made += [(x[at], x[h]) for h in hit]
    pairs = np.array(made, np.uint64).reshape(-1, 2).view(np.int64)
    return pd.DataFrame({"a": pairs.min(1), "b": pairs.max(1)})


def links(prints: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, bucket: int = BUCKET) -> DataFrame:
    """Pairs a < b of distinct fingerprints (column fp) within distance that connect all that are linked."""
    keys = F.array(*(F.struct(F.lit(i).alias("block"), F.col("fp").bitwiseAND(F.lit(m).cast("bigint")).alias("key")) for i, m in enumerate(block_masks(blocks, distance))))
    dealt = prints.select("fp", F.inline(keys))
    sizes = dealt.groupBy("block", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    dealt = written(dealt.join(sizes, ["block", "key"]), "simhash-blocks")
    few = dealt.where(F.col("n") <= bucket).select("block", "key", "fp")
    pairs = few.withColumnRenamed("fp", "a").join(few.withColumnRenamed("fp", "b"), ["block", "key"]).where("a < b")
    pairs = pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance).select("a", "b")
    many = dealt.where(F.col("n") > bucket).withColumn("chunks", F.ceil(F.col("n") / bucket)).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("chunks")))
    many = many.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)))
    forest = many.select("block", "key", "fp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).groupBy("block", "key", "i", "j").applyInPandas(lambda g: _forest(g, distance), "a bigint, b bigint")
    return pairs.unionByName(forest).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root, the smallest node reachable, for each node of the pairs a < b."""
    state, edges = None, written(edges.select(F.col("b").alias("u"), F.col("a").alias("v")), "star")
    while True:
        # large star: each larger neighbour of u points to u's smallest neighbour
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours point to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = written(small.where("u <> v").distinct(), "star")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
        state = now


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, bucket: int = BUCKET) -> DataFrame:
    """doc_id, digest, fp, component_id and first_digest for each row of docs.

    component_id is the smallest doc_id of the component, first_digest the smallest digest of its texts.
    """
    rows = written(docs.select("doc_id", text_digest().alias("digest"), fingerprints("text").alias("fp")), "simhash-rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest"))
    prints = written(rows.groupBy("fp").agg(first.alias("first")), "simhash-prints")
    roots = written(components(links(prints.select("fp"), distance, blocks, bucket)), "simhash-roots")
    joined = prints.join(roots.withColumnRenamed("node", "fp"), "fp")
    firsts = joined.groupBy("root").agg(F.min("first").alias("least"))
    joined = joined.join(firsts, "root").select("fp", "least")
    of = prints.join(joined, "fp", "left").select("fp", F.coalesce("least", "first").alias("first"))
    return spread_join(rows, of, "fp", "doc_id").select("doc_id", "digest", "fp", F.col("first.doc_id").alias("component_id"), F.col("first.digest").alias("first_digest"))


def keep_one(docs: DataFrame, find: Callable[[DataFrame], DataFrame] = near_duplicates) -> DataFrame:
    """docs with one row of each component that find makes: its smallest doc_id (of equal ids the smallest digest of the text, of equal texts one row)."""
    own, digest, copies = unused(docs, "kept_id"), unused(docs, "kept_digest"), unused(docs, "kept_rows")
    found = find(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("digest") == F.col("first_digest")))
    kept = written(found.groupBy(F.col("doc_id").alias(own), F.col("digest").alias(digest)).agg(F.count(F.lit(1)).alias(copies)), "simhash-kept")
    rows = docs.join(kept, docs["doc_id"].eqNullSafe(kept[own]) & (text_digest(docs["text"]) == kept[digest]))
    single = rows.where(F.col(copies) == 1).select(docs.columns)
    return single.unionByName(rows.where(F.col(copies) > 1).dropDuplicates([own, digest]).select(docs.columns))
