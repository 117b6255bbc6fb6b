"""Prefix trie of conversations as a z-fast trie, held in tables.

A conversation is a string of turns. ``prefixes`` gives every turn the 128-bit hash of all turns up to it: the
exclusive or of hashes of (place, role, text), so that one conversation's prefixes can be made by several tasks
and a prefix's hash tells that of the one before it.

The trie is compacted: its nodes are the empty prefix, the prefixes at which conversations part or end. A
node stands for the edge above it, the depths from its parent's (``up``, exclusive) to its own (``depth``), and is
found by its handle: the hash of its prefix at the two-fattest depth of the edge, the one divisible by the
highest power of two. Conversations come in batches. Each finds the deepest node on its path by fat binary search: it
probes the two-fattest depth of the range left, and a hit moves the lower end to the node's depth, a miss the upper
end below the probe, so the number of probes is the number of binary digits of its length. One comparison with the edge
that begins like the conversation's next turn tells where it leaves the trie. What lies beyond is grouped into new
nodes, edges that were left in mid-way are split, and only these get new handles.

At the end the edges are expanded into a row for every depth. Sums over subtrees need no walk over the levels: each
node belongs to the least conversation through it, a conversation owns the end of its path, and so all sums are sums over
(conversation, node on its path).

Null roles and texts count as empty, null conversation ids take no part, turns are ordered nulls first, rows of one
turn by hash of role and text. Repeated rows are turns of their own. An empty table has no node at all. A conversation may be of
any length: only its end in ``ends`` (a running SHA-256 of ids) and the nodes on its path are read in order by one task.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pourscale.llm.common import written
from pourscale.llm.ordered import numbered, spread_join

#: Turns over which prefixes are summed up by one task at a time.
BLOCK = 4096
#: Depths of an edge that are expanded from one row at a time.
SPAN = 4096
#: Sixteenths of the conversations up to which the batches go.
BATCHES = (1, 4, 16)
P = ["p1", "p2"]


def two_fattest(low: Column, high: Column) -> Column:
    """The number in (low, high] that is divisible by the highest power of two."""
    x = low.bitwiseXOR(high)
    for n in (1, 2, 4, 8, 16, 32):
        x = x.bitwiseOR(F.shiftrightunsigned(x, n))
    return high.bitwiseAND(F.bitwise_not(F.shiftrightunsigned(x, 1)))


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), the turn's key (k1, k2) and size (code points of its text)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    half = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("bigint")
    rows = conversations.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", half(1).alias("k1"), half(16).alias("k2"), F.length(text).cast("bigint").alias("size"))
    return numbered(rows, "conv_id", ["turn", "k1", "k2"], "trie-turns").drop("turn", "part")


def rebuilt(turns: DataFrame, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns are replaced by those of the first one of their hundred.

    Gives the turns (conv_id, d from 1, key, size) and the conversations (conv_id, n turns).
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own")).withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % group)
    lengths = convs.select(F.col("conv_id").alias("base"), F.col("own").alias("has"))
    convs = convs.join(lengths, "base", "left").withColumn("given", F.least("h", F.coalesce("has", F.lit(0))))
    convs = written(convs.withColumn("n", F.col("given") + F.greatest(F.col("own") - F.col("h"), F.lit(0))), "trie-convs")
    firsts = turns.where(F.col("pos") < most - 1).withColumnRenamed("conv_id", "base")
    firsts = convs.where("h > 0").select("conv_id", "base", "h").join(firsts, "base").where(F.col("pos") < F.col("h"))
    firsts = firsts.select("conv_id", (F.col("pos") + 1).alias("d"), "k1", "k2", "size")
    rest = spread_join(turns.where(F.col("pos") >= h), convs.select("conv_id", "h", "given"), "conv_id", "pos")
    rest = rest.select("conv_id", (F.col("given") + F.col("pos") - F.col("h") + 1).alias("d"), "k1", "k2", "size")
    return firsts.unionByName(rest), convs.select("conv_id", "n")


def prefixes(turns: DataFrame) -> DataFrame:
    """turns (conv_id, d, k1, k2, size) with the hashes p1, p2 of the turns up to d, q1, q2 up to the one before, and total, their code points."""
    rows = turns.select("conv_id", "d", "size", F.xxhash64("k1", "k2", "d").alias("e1"), F.xxhash64("d", "k2", "k1").alias("e2"), F.floor((F.col("d") - 1) / BLOCK).alias("block"))
    rows = written(rows, "trie-rebuilt")
    blocks = rows.groupBy("conv_id", "block").agg(F.bit_xor("e1").alias("b1"), F.bit_xor("e2").alias("b2"), F.sum("size").alias("b"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv_id", "block", F.bit_xor("b1").over(before).alias("b1"), F.bit_xor("b2").over(before).alias("b2"), F.sum("b").over(before).alias("b")).where("block > 0")
    upto = Window.partitionBy("conv_id", "block").orderBy("d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.join(blocks, ["conv_id", "block"], "left")
    fore = lambda e, b: F.bit_xor(e).over(upto).bitwiseXOR(F.coalesce(b, F.lit(0)))
    rows = rows.select("conv_id", "d", "size", "e1", "e2", fore("e1", "b1").alias("p1"), fore("e2", "b2").alias("p2"), (F.sum("size").over(upto) + F.coalesce("b", F.lit(0))).alias("total"))
    return rows.select("conv_id", "d", "size", "p1", "p2", F.col("p1").bitwiseXOR(F.col("e1")).alias("q1"), F.col("p2").bitwiseXOR(F.col("e2")).alias("q2"), "total")


def ends(paths: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each distinct conversation: s (its least conv_id), n, p1, p2, total, weight and the SHA-256 of its conv_ids."""
    last = paths.groupBy("conv_id").agg(F.max(F.struct("d", "p1", "p2", "total")).alias("last"))
    none = F.lit(0).cast("bigint")
    last = last.select("conv_id", "last.*").unionByName(convs.where("n = 0").select("conv_id", *(none.alias(c) for c in ("d", "p1", "p2", "total"))))
    names = ["s", "n", "p1", "p2", "total", "weight", "sha256"]

    def hashed(batches):
        now, state, done = None, None, []
        for batch in batches:
            for conv, *key in zip(*(batch[c].to_pylist() for c in ("conv_id", "d", "p1", "p2", "total"))):
                if now is None or now[1:5] != key:
                    if now is not None:
                        done.append((*now, state.hexdigest()))
                    now, state = [conv, *key, 1], hashlib.sha256(str(conv).encode())
                else:
                    state.update(f",{conv}".encode())
                    now[5] += 1
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names)
                done = []
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*now, state.hexdigest())], names)

    last = last.repartition("d", *P).sortWithinPartitions("d", *P, "total", "conv_id").select("conv_id", "d", *P, "total")
    return last.mapInArrow(hashed, "s bigint, n bigint, p1 bigint, p2 bigint, total bigint, weight bigint, sha256 string")


NODE = "depth bigint, p1 bigint, p2 bigint, up bigint, witness bigint, handle bigint, h1 bigint, h2 bigint, c1 bigint, c2 bigint, u1 bigint, u2 bigint"


def _handled(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Nodes (depth, p1, p2, up, witness) with their handles, their edges' first prefixes (c1, c2) and their parents' (u1, u2)."""
    nodes = nodes.withColumn("handle", two_fattest(F.col("up"), F.col("depth")))
    at = paths.select(F.col("conv_id").alias("witness"), F.col("d").alias("handle"), F.col("p1").alias("h1"), F.col("p2").alias("h2"))
    first = paths.select(F.col("conv_id").alias("witness"), (F.col("d") - 1).alias("up"), F.col("p1").alias("c1"), F.col("p2").alias("c2"), F.col("q1").alias("u1"), F.col("q2").alias("u2"))
    return nodes.join(at, ["witness", "handle"]).join(first, ["witness", "up"]).select(*(c.split()[0] for c in NODE.split(", ")))


def located(batch: DataFrame, nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """For each conversation (s, n) of batch where it leaves the trie: m (depth), and depth, p1, p2, up of the edge's node if that is inside an edge."""
    own = lambda s, d, names: paths.select(F.col("conv_id").alias(s), F.col("d").alias(d), *(F.col(p).alias(n) for p, n in zip(P, names)))
    state = written(batch.select("s", "n", F.lit(0).cast("bigint").alias("low"), F.col("n").alias("high")), "trie-search")
    longest = state.agg(F.max("n")).first()[0] or 0
    handles = nodes.where("depth > 0").select("handle", "h1", "h2", "depth", F.col("p1").alias("e1"), F.col("p2").alias("e2"), "up")
    for _ in range(longest.bit_length()):
        open_, closed = state.where("low < high"), state.where("low = high")
        open_ = open_.withColumn("handle", two_fattest(F.col("low"), F.col("high"))).join(own("s", "handle", ["h1", "h2"]), ["s", "handle"])
        hit = spread_join(written(open_, "trie-probe"), handles, ["handle", "h1", "h2"], "s", "left")
        hit = hit.join(own("s", "depth", ["a1", "a2"]), ["s", "depth"], "left")
        whole = (F.col("a1") == F.col("e1")) & (F.col("a2") == F.col("e2"))
        miss = F.col("depth").isNull()
        low = F.when(miss, F.col("low")).when(whole, F.col("depth")).otherwise(F.col("up"))
        high = F.when(miss, F.col("handle") - 1).when(whole, F.col("high")).otherwise(F.col("up"))
        state = written(hit.select("s", "n", low.alias("low"), high.alias("high")).unionByName(closed), "trie-search")
    # the edge that begins like the next turn, and how far it goes on alike
    following = state.where("low < n").withColumn("d", F.col("low") + 1).join(own("s", "d", ["c1", "c2"]), ["s", "d"]).drop("d")
    edges = nodes.where("depth > 0").select(F.col("up").alias("low"), "c1", "c2", "depth", "p1", "p2", "up", "witness")
    inside = written(spread_join(written(following, "trie-next"), edges, ["low", "c1", "c2"], "s"), "trie-inside")
    alike = inside.select("s", "low", "depth", "witness").join(own("s", "d", P), "s").where("d > low and d < depth")
    alike = alike.join(own("witness", "d", P), ["witness", "d", *P]).groupBy("s").agg(F.max("d").alias("m"))
    inside = inside.join(alike, "s").select("s", "m", "depth", "p1", "p2", "up")
    return state.select("s", "n", "low").join(inside, "s", "left").withColumn("m", F.coalesce("m", "low")).drop("low")


def inserted(batch: DataFrame, nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """nodes after the conversations (s, n, p1, p2) of batch have come in."""
    left = written(located(batch, nodes, paths), "trie-located")
    beyond = paths.withColumnRenamed("conv_id", "s").join(left.where("m < n").select("s", "n", "m"), "s").where("d > m")
    beyond = written(beyond.select("s", "n", "m", "d", "p1", "p2", "q1", "q2"), "trie-beyond")
    child = F.struct("p1", "p2")
    parting = beyond.where("d > m + 1").groupBy((F.col("d") - 1).alias("d"), "q1", "q2").agg(F.min(child).alias("a"), F.max(child).alias("b")).where("a <> b")
    fresh = parting.select("d", F.col("q1").alias("p1"), F.col("q2").alias("p2")).unionByName(beyond.where("d = n").select("d", "p1", "p2")).distinct()
    fresh = spread_join(beyond.select("s", "m", "d", "p1", "p2"), fresh, ["d", *P], "s")
    before = Window.partitionBy("s").orderBy("d")
    fresh = fresh.withColumn("up", F.coalesce(F.lag("d").over(before), F.col("m")))
    fresh = fresh.groupBy(F.col("d").alias("depth"), "p1", "p2").agg(F.min("up").alias("up"), F.min("s").alias("witness"))
    # edges left in mid-way
    at = paths.select(F.col("conv_id").alias("s"), F.col("d").alias("m"), F.col("p1").alias("m1"), F.col("p2").alias("m2"))
    cuts = left.where(F.col("depth").isNotNull()).join(at, ["s", "m"]).groupBy("depth", "p1", "p2", "up", "m", "m1", "m2").agg(F.min("s").alias("witness"))
    cuts = written(cuts, "trie-cuts")
    above = Window.partitionBy("depth", *P).orderBy("m")
    split = cuts.select(F.col("m").alias("depth"), F.col("m1").alias("p1"), F.col("m2").alias("p2"), F.coalesce(F.lag("m").over(above), F.col("up")).alias("up"), "witness")
    lower = cuts.groupBy("depth", *P).agg(F.max("m").alias("now"))
    kept = nodes.join(lower.select("depth", *P), ["depth", *P], "left_anti")
    moved = nodes.join(lower, ["depth", *P]).select("depth", "p1", "p2", F.col("now").alias("up"), "witness")
    made = _handled(fresh.unionByName(split).unionByName(moved), paths)
    return written(kept.select(made.columns).unionByName(made), "trie-nodes")


def build(strings: DataFrame, paths: DataFrame) -> DataFrame:
    """The nodes of the compacted trie of distinct conversations (``ends``); paths holds their prefixes."""
    spark = strings.sparkSession
    nodes, done = spark.createDataFrame([(0, 0, 0, -1, *[None] * 8)], NODE), 0
    for upto in BATCHES:
        share = F.pmod(F.xxhash64("s"), F.lit(16))
        nodes = inserted(strings.where((share >= done) & (share < upto) & (F.col("n") > 0)), nodes, paths)
        done = upto
    return nodes


def expanded(nodes: DataFrame, strings: DataFrame, paths: DataFrame) -> DataFrame:
    """A row for every prefix: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    key = ["depth", *P]
    below = nodes.where("depth > 0").groupBy(F.col("up").alias("depth"), F.col("u1").alias("p1"), F.col("u2").alias("p2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = written(nodes.join(below, key, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-counted")
    leaf = nodes.where("n_children = 0").select(F.col("depth").alias("n"), *P, F.lit(1).alias("leaf"))
    strings = strings.join(leaf, ["n", *P], "left").withColumn("leaf", F.coalesce("leaf", F.lit(0)))
    # the nodes on the path of each conversation but for the root
    steps = spread_join(paths.select(F.col("conv_id").alias("s"), F.col("d").alias("depth"), *P, F.col("total").alias("upto")), nodes.where("depth > 0").select(key), key, "s")
    steps = written(steps, "trie-steps")
    owner = steps.groupBy(key).agg(F.min("s").alias("conv_id"))
    others = spread_join(steps, owner, key, "s").where("s <> conv_id").groupBy("s").agg(F.max("upto").alias("others"))
    strings = written(strings.join(others, "s", "left").withColumn("owned", F.col("total") - F.coalesce("others", F.lit(0))), "trie-strings")
    sums = [F.min(F.struct("s", "owned", "total")).alias("owner"), F.sum("weight").alias("n_convs"), F.sum("leaf").alias("n_leaves"),
            F.sum(F.col("weight") * F.col("total") - F.col("owned")).alias("saved")]
    each = spread_join(steps, strings.select("s", "weight", "leaf", "total", "owned"), "s", "depth").groupBy(key).agg(*sums)
    root = strings.agg(*sums).where("n_convs is not null").select(*(F.lit(0).cast("bigint").alias(c) for c in key), "*")
    each = each.unionByName(root).select(*key, "owner.s", "n_convs", "n_leaves", (F.col("saved") + F.col("owner.owned") - F.col("owner.total")).alias("saved"))
    each = written(each, "trie-sums")
    ending = strings.select(F.col("n").alias("depth"), *P, "sha256")
    edges = nodes.join(each, key).join(ending, key, "left")
    upper = each.select(F.col("depth").alias("up"), F.col("p1").alias("u1"), F.col("p2").alias("u2"), F.col("s").alias("parent"))
    edges = spread_join(written(edges, "trie-edges"), upper, ["up", "u1", "u2"], "s", "left")
    # every depth of an edge, from blocks of SPAN depths, with the code points before it
    spans = F.explode(F.sequence(F.floor(F.greatest(F.col("up"), F.lit(0)) / SPAN), F.floor(F.col("depth") / SPAN)))
    rows = edges.withColumn("span", spans).where(F.least("depth", (F.col("span") + 1) * SPAN - 1) > F.col("up"))
    rows = rows.withColumn("d", F.explode(F.sequence(F.greatest(F.col("up") + 1, F.col("span") * SPAN), F.least("depth", (F.col("span") + 1) * SPAN - 1))))
    before = paths.select(F.col("conv_id").alias("s"), "d", (F.col("total") - F.col("size")).alias("before"))
    rows = rows.join(before, ["s", "d"], "left")
    last = F.col("d") == F.col("depth")
    return rows.select(
        F.col("s").alias("conv_id"), F.col("d").alias("depth"), F.when(F.col("d") - 1 > F.col("up"), F.col("s")).otherwise(F.col("parent")).alias("parent_conv_id"), "n_convs",
        F.when(last, F.col("n_children")).otherwise(1).cast("bigint").alias("n_children"), F.col("n_leaves").cast("bigint").alias("n_leaves"),
        (F.col("saved") - (F.col("n_convs") - 1) * F.coalesce("before", F.lit(0))).alias("saved_tokens"),
        F.coalesce(F.when(last, F.col("sha256")), F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The expanded trie of conversations: turns (conv_id, d from 1, k1, k2, size) and convs (conv_id, n)."""
    every = written(prefixes(turns), "trie-prefixes")
    strings = written(ends(every, convs), "trie-ends")
    paths = written(spread_join(every, strings.select(F.col("s").alias("conv_id")), "conv_id", "d"), "trie-paths")
    return expanded(build(strings, paths), strings, paths)
