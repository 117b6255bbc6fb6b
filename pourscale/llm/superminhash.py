"""Near duplicates by SuperMinHash signatures.

A text's set is its distinct ``WORDS``-word shingles (fewer words: the whole sequence as one). Every member draws a
pseudo-random permutation of the signature's places, step by step; at step j it offers j plus a random fraction to its
j-th place, which keeps the least offer. The offers of one member are correlated so that its ranks over all places
are spread evenly, which makes estimates vary less than those of independent hash functions, and no member goes on
once no place holds more than j: large sets stop after a few steps.

``BANDS`` keys of ``ROWS`` places each join candidates: sets of similarity s share a key with probability
1 - (1 - s^ROWS)^BANDS, 0.9999992 at 0.85. Every candidate is verified on the whole sets (``setlinks``), links
are thinned by a union-find in each task and grouped by star contraction.

Words are lower-cased (A-Z) and parted by ASCII white space. Null texts count as empty; texts without words have an
empty set and are linked with nothing. Texts of one set are one node, so copies are collapsed before any join. Rows
with equal ids are rows of their own. A null id becomes a component's id only if it holds no other.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pourscale.llm.common import text_digest, written
from pourscale.llm.ordered import spread_join
from pourscale.llm.setlinks import links
from pourscale.llm.simhash import components

WORDS = 5
SEED = 42
BANDS = 24
ROWS = 5
#: Similarity from which texts link, as a fraction.
LEAST = (85, 100)
#: Members whose permutations are held at once.
SLICE = 1 << 15
_STEP = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2, _S1, _S2, _S3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(30), np.uint64(27), np.uint64(31)


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit number for each 64-bit number, one to one."""
    x = (x ^ (x >> _S1)) * _M1
    x = (x ^ (x >> _S2)) * _M2
    return x ^ (x >> _S3)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    del found
    width = min(words, len(each))
    made = np.full(len(each) - width + 1, width, np.uint64)
    for i in range(width):
        made = mixed(made) * _STEP + each[i : len(each) - width + 1 + i]
    return np.unique(mixed(made))


def _offer(least: np.ndarray, members: np.ndarray, owner: np.ndarray) -> None:
    """Lets members make their offers to the places (columns) of their owners (rows)."""
    places = least.shape[1]
    order = np.tile(np.arange(places, dtype=np.uint8 if places < 256 else np.uint16), (len(members), 1))
    going = np.arange(len(members))
    for j in range(places):
        going = going[(least.max(1) > j)[owner[going]]]
        if not len(going):
            return
        drawn = mixed(members[going] + np.uint64((2 * j + 1) * int(_STEP) % (1 << 64)))
        at = (j + mixed(drawn + _STEP) % np.uint64(places - j)).astype(np.int64)
        place = order[going, at]
        order[going, at] = order[going, j]
        order[going, j] = place
        np.minimum.at(least, (owner[going], place), j + (drawn >> np.uint64(11)) * 2.0**-53)


def signatures(sets: list[np.ndarray], places: int = BANDS * ROWS) -> np.ndarray:
    """A row of places for each set; empty sets stay at infinity."""
    least = np.full((len(sets), places), np.inf)
    start = 0
    while start < len(sets):
        stop, n = start + 1, len(sets[start])
        while stop < len(sets) and n + len(sets[stop]) <= SLICE:
            n, stop = n + len(sets[stop]), stop + 1
        members = np.concatenate(sets[start:stop])
        owner = np.repeat(np.arange(stop - start), [len(s) for s in sets[start:stop]])
        for at in range(0, len(members), SLICE):
            _offer(least[start:stop], members[at : at + SLICE], owner[at : at + SLICE])
        start = stop
    return least


def band_keys(signature: np.ndarray, rows: int = ROWS) -> list[int]:
    """A signed 64-bit key for each band."""
    return [xxhash.xxh64_intdigest(band.tobytes(), i) - (1 << 63) for i, band in enumerate(signature.reshape(-1, rows))]


def _signed(texts: pd.Series) -> pd.DataFrame:
    sets = [shingles(t) for t in texts]
    keys = [band_keys(s) if len(x) else [] for x, s in zip(sets, signatures(sets))]
    return pd.DataFrame({"digest": [xxhash.xxh3_128_digest(x.tobytes()) for x in sets], "n": [len(x) for x in sets], "keys": keys})


def _members(texts: pd.Series) -> pd.Series:
    return pd.Series([shingles(t).view(np.int64) for t in texts])


def thinned(edges: DataFrame, limit: int = 1 << 18) -> DataFrame:
    """Those of a task's links a, b that join what was not joined before, by union-find over at most limit nodes at once."""

    def forest(frames):
        parent: dict[int, int] = {}

        def root(x):
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        for frame in frames:
            if len(parent) > limit:
                parent.clear()
            kept = []
            for a, b in zip(frame["a"].tolist(), frame["b"].tolist()):
                p, q = root(a), root(b)
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    kept.append((a, b))
            yield pd.DataFrame(kept, columns=["a", "b"], dtype="int64")

    return edges.select("a", "b").mapInPandas(forest, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, least: tuple[int, int] = LEAST) -> DataFrame:
    """doc_id, n (members of the text's set) and component_id for each row of docs."""
    docs = docs.select("doc_id", "text")
    found = docs.select("doc_id", text_digest().alias("key"), F.pandas_udf(_signed, "digest binary, n bigint, keys array<bigint>")("text").alias("found"))
    rows = written(found.select("doc_id", "key", "found.*"), "super-rows")
    # of equal sets the text with the least id stands for all; the number of a written row is its node
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("first")
    sets = rows.where("n > 0").groupBy("digest").agg(first, F.first("n").alias("n"), F.first("keys").alias("keys"))
    nodes = written(sets.withColumn("node", F.monotonically_increasing_id()), "super-nodes")

    def sets_of(wanted: DataFrame) -> DataFrame:
        of = nodes.join(wanted, "node").select("node", F.col("first.doc_id").alias("of_id"), F.col("first.key").alias("of_key"))
        texts = docs.join(of, F.col("doc_id").eqNullSafe(F.col("of_id")) & (text_digest() == F.col("of_key")))
        texts = texts.groupBy("node").agg(F.first("text").alias("text"))
        return texts.select("node", F.pandas_udf(_members, "array<bigint>")("text").alias("members"))

    edges = links(nodes.select("node", "n", "keys"), sets_of, least)
    roots = written(components(thinned(edges)), "super-roots")
    placed = nodes.join(roots, "node", "left").select("digest", "first.no_id", "first.doc_id", F.coalesce("root", "node").alias("root"))
    firsts = placed.groupBy("root").agg(F.min(F.struct("no_id", "doc_id")).alias("least"))
    of = placed.join(firsts, "root").select("digest", F.col("least.doc_id").alias("component_id"))
    linked = spread_join(rows.where("n > 0").select("doc_id", "n", "digest"), of, "digest", "doc_id")
    alone = rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return linked.select("doc_id", "n", "component_id").unionByName(alone)
