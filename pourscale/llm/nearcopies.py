"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates come from op9's SimHash first: texts whose fingerprints differ in at most two
of 64 bits, by pigeonhole blocks (``simhash_pairs``). At a similarity of 0.8 fingerprints
differ in about 10 bits, further than such blocks reach, so MinHash adds the candidates
beyond: ``BANDS`` keys a text, each of the least values of ``ROWS`` hash functions over its
shingles. Two texts of similarity s share a key with probability 1 - (1 - s^ROWS)^BANDS:
0.99993 at 0.8. Every link of either is verified on the shingle sets themselves, in one
step, as ``setlinks`` tells.

Texts of one shingle set are one node.

Words are lower-cased and parted by ASCII white space; a text of fewer than five words
is one shingle. Null texts count as empty; texts without words are one node. Nodes are
64-bit hashes of the shingle sets.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pourscale.llm.common import text_digest, unused, written
from pourscale.llm.ordered import spread_join
from pourscale.llm.setlinks import links
from pourscale.llm.simhash import components, fingerprint
from pourscale.llm.simhash import links as print_links
from pourscale.llm.superminhash import shingles

SEED = 42
BANDS = 24
ROWS = 5
#: Similarity from which texts link, as a fraction.
LEAST = (4, 5)
_DRAWN = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * ROWS, 1), dtype=np.uint64)
_FACTORS, _SUMMANDS = _DRAWN[0] * np.uint64(2) + np.uint64(1), _DRAWN[1]


def band_keys(found: np.ndarray) -> list[int]:
    """A key for each band, as signed 64-bit numbers; none for an empty set."""
    if not len(found):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 2048):
        np.minimum(least, (found[at : at + 2048] * _FACTORS + _SUMMANDS).min(1), out=least)
    return [xxhash.xxh64_intdigest(row.tobytes(), i) - (1 << 63) for i, row in enumerate(least.reshape(BANDS, ROWS))]


def _signatures(texts: pd.Series) -> pd.DataFrame:
    made = [shingles(t) for t in texts]
    nodes = [xxhash.xxh64_intdigest(x.tobytes(), SEED) - (1 << 63) for x in made]
    return pd.DataFrame({"node": nodes, "n": [len(x) for x in made], "keys": [band_keys(x) for x in made], "fp": [fingerprint(t) for t in texts]})


def _sets(texts: pd.Series) -> pd.Series:
    return pd.Series([shingles(t).view(np.int64) for t in texts])


def simhash_pairs(rows: DataFrame) -> DataFrame:
    """Pairs a < b of nodes (of rows with node and fp) whose fingerprints link; they connect all that do.

    A fingerprint's smallest node stands for its nodes, which are paired with it.
    """
    held = written(rows.groupBy("fp", "node").agg(F.count(F.lit(1)).alias("rows")).select("fp", "node"), "copies-held")
    prints = written(held.groupBy("fp").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")), "copies-prints")
    several = prints.where("n > 1").select("fp", "first", "n")
    same = spread_join(held, several.drop("n"), "fp", "node", counts=several.select("fp", "n")).where("node <> first").select("node", "first")
    of = lambda side, node: prints.select(F.col("fp").alias(side), F.col("first").alias(node))
    near = print_links(prints.select("fp")).join(of("a", "node"), "a").join(of("b", "first"), "b").where("node <> first").select("node", "first")
    return same.unionByName(near).select(F.least("node", "first").alias("a"), F.greatest("node", "first").alias("b")).distinct()


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, digest, component_id and first_digest for each row of docs.

    component_id is the smallest doc_id of the component, first_digest the smallest digest of its texts.
    """
    found = docs.select("doc_id", text_digest().alias("digest"), F.pandas_udf(_signatures, "node bigint, n bigint, keys array<bigint>, fp bigint")("text").alias("found"))
    rows = written(found.select("doc_id", "digest", "found.*"), "copies-rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest"))
    nodes = written(rows.groupBy("node").agg(first.alias("first"), F.first("n").alias("n"), F.first("keys").alias("keys")), "copies-nodes")
    own, digest = unused(docs, "own_id"), unused(docs, "own_digest")
    of = nodes.select("node", F.col("first.doc_id").alias(own), F.col("first.digest").alias(digest))
    texts = docs.withColumn(unused(docs, "text_key"), text_digest()).join(of, F.col("doc_id").eqNullSafe(F.col(own)) & (F.col(unused(docs, "text_key")) == F.col(digest)))
    texts = texts.groupBy(of["node"]).agg(F.first("text").alias("text"))

    def sets_of(wanted: DataFrame) -> DataFrame:
        return texts.join(wanted, "node").select("node", F.pandas_udf(_sets, "array<bigint>")("text").alias("members"))

    close = written(simhash_pairs(rows.where("n > 0").select("fp", "node")), "copies-close")
    roots = written(components(links(nodes.select("node", "n", "keys"), sets_of, LEAST, also=close)), "copies-components")
    joined = nodes.join(roots, "node")
    firsts = joined.groupBy("root").agg(F.min("first").alias("least"))
    joined = joined.join(firsts, "root").select("node", "least")
    of = nodes.join(joined, "node", "left").select("node", F.coalesce("least", "first").alias("first"))
    return spread_join(rows.select("doc_id", "digest", "node"), of, "node", "doc_id").select("doc_id", "digest", F.col("first.doc_id").alias("component_id"), F.col("first.digest").alias("first_digest"))
