"""Verified links between sets that share a key.

Under each key every set is first compared with one of its sets, drawn by hash, so that the keys of a group of near
copies draw different ones. What these links join is settled, and keys that still hold sets of different components
draw again, ``ROUNDS`` times in all. After that, small keys have the pairs left compared. In larger ones candidates come from an exact prefix filter: two sets of Jaccard similarity t share one of the n - ceil(t n) + 1 rarest
members of either, with enough members behind it, so only such sets are compared, however common the rest of them
is. No pair is lost by it, and neither copies nor pages of one template have all their pairs written out.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pourscale.llm.common import written
from pourscale.llm.ordered import spread_join
from pourscale.llm.simhash import components

#: Nodes up to which a key's pairs are compared directly.
BUCKET = 32
#: Slots in which the members of sets are counted: 8 bytes each go to every task.
SLOTS = 1 << 17
#: How often keys draw a set to compare the others with.
ROUNDS = 3


def briefed(sets: DataFrame) -> DataFrame:
    """sets (node, members) with n and brief, the distinct first 16 bits of the members: a quarter of their bytes."""
    return sets.select("node", "members", F.size("members").alias("n"), F.array_distinct(F.transform("members", lambda x: F.shiftright(x, 48).cast("smallint"))).alias("brief"))


def _paired(pairs: DataFrame, sets: DataFrame, columns: list[str]) -> DataFrame:
    """pairs a, b with these columns of either set, named by its side."""
    side = lambda s: sets.select(F.col("node").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in columns))
    return spread_join(pairs, side("a"), "a", "b").join(side("b"), "b")


def close(pairs: DataFrame, sets: DataFrame, least: tuple[int, int]) -> DataFrame:
    """pairs a, b without those that the first 16 bits of their members (``briefed``) rule out.

    Shared members have shared first bits, and as many more as a set has than it has first bits may hide behind
    these: that bounds what two sets share from above.
    """
    over, under = least
    both = _paired(pairs, sets, ["n", "brief"])
    most = F.size(F.array_intersect("brief_a", "brief_b")) + F.least(F.col("n_a") - F.size("brief_a"), F.col("n_b") - F.size("brief_b"))
    return both.where(under * most >= over * (F.col("n_a") + F.col("n_b") - most)).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame, least: tuple[int, int]) -> DataFrame:
    """Those pairs a < b whose sets (``briefed``) have a Jaccard similarity of least (a fraction) or more.

    Whole sets travel only to the pairs that are ``close``.
    """
    over, under = least
    pairs = written(pairs.select("a", "b").distinct(), "links-pairs")
    both = _paired(written(close(pairs, sets, least), "links-close"), sets, ["members"])
    shared = F.size(F.array_intersect("members_a", "members_b"))
    return both.where(under * shared >= over * (F.size("members_a") + F.size("members_b") - shared)).select("a", "b")


def rare(sets: DataFrame, least: tuple[int, int]) -> DataFrame:
    """node, n, member and at (its place from 0) for the rarest members of each set: similar sets share one of them.

    Any order that is the same for all sets finds them all. Here members go by the count of their slot, of SLOTS slots
    by hash, which every task gets as one array, then by value.
    """
    over, under = least
    slot = F.pmod("member", F.lit(SLOTS)).cast("int").alias("slot")
    counts = np.zeros(SLOTS, np.int64)
    for r in sets.select(F.explode("members").alias("member")).groupBy(slot).count().collect():  # SLOTS rows at most
        counts[r["slot"]] = r["count"]
    shared = sets.sparkSession.sparkContext.broadcast(counts)

    def firsts(members: pd.Series) -> pd.Series:
        out = []
        for x in members:
            x = np.asarray(x, np.int64)
            order = np.lexsort((x, shared.value[x % SLOTS]))
            out.append(x[order[: len(x) - (len(x) * over + under - 1) // under + 1]])
        return pd.Series(out)

    chosen = sets.select("node", F.size("members").cast("bigint").alias("n"), F.pandas_udf(firsts, "array<bigint>")("members").alias("m"))
    return chosen.select("node", "n", F.posexplode("m").alias("at", "member"))


def sharing(firsts: DataFrame, least: tuple[int, int]) -> DataFrame:
    """Candidates a < b of ``rare`` rows (with root): pairs of different roots that share a rare member early enough.

    The smaller set of a similar pair has it among its first n - ceil(2 t n / (1 + t)) + 1. Behind the first member
    that two sets share lie at least the others they share, so too few left behind it rule the pair out. Of two sets
    of different roots one is not of the member's most frequent root: only these meet all others of the member.
    """
    over, under = least
    of_root = firsts.groupBy("member", "root").agg(F.count(F.lit(1)).alias("rows"))
    major = of_root.groupBy("member").agg(F.max(F.struct("rows", "root")).alias("m"), F.count(F.lit(1)).alias("roots")).where("roots > 1").select("member", F.col("m.root").alias("major"))
    firsts = spread_join(firsts, major, "member", "node").withColumn("minor", F.col("root") != F.col("major"))
    firsts = firsts.withColumn("early", F.expr(f"at <= n - (n * {2 * over} + {over + under - 1}) div {over + under}"))
    firsts = written(firsts.drop("major"), "links-firsts")
    x = firsts.where("minor").select("member", *(F.col(c).alias(f"x_{c}") for c in ("node", "n", "at", "root", "early")))
    smaller = (F.col("x_n") < F.col("n")) | (F.col("x_n") == F.col("n")) & (F.col("x_node") < F.col("node"))
    behind = F.least(F.col("x_n") - F.col("x_at"), F.col("n") - F.col("at"))
    close = (under * F.least("x_n", "n") >= over * F.greatest("x_n", "n")) & ((over + under) * behind >= over * (F.col("x_n") + F.col("n")))
    once = ~F.col("minor") | (F.col("x_node") < F.col("node"))
    both = x.join(firsts, "member").where((F.col("root") != F.col("x_root")) & once & close & F.when(smaller, F.col("x_early")).otherwise(F.col("early")))
    return both.select(F.least("x_node", "node").alias("a"), F.greatest("x_node", "node").alias("b"))


def links(nodes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], least: tuple[int, int], bucket: int = BUCKET, *, also: DataFrame | None = None) -> DataFrame:
    """Pairs a < b of similar nodes that connect all that are linked.

    nodes: node, n (members of its set) and keys; sets_of gives node and members for a table of nodes. also: pairs
    a < b that are compared in the first round, whether or not they share a key.
    """
    over, under = least
    fits = lambda m, n: (under * F.least(m, n) >= over * F.greatest(m, n))  # noqa: E731  # else the sizes alone forbid the similarity
    dealt = written(nodes.select("node", "n", F.explode("keys").alias("key")), "links-dealt")
    sizes = written(dealt.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "links-sizes")
    left = written(spread_join(dealt, sizes, "key", "node", counts=sizes.select("key", F.col("size").alias("n"))).withColumn("root", F.col("node")), "links-keys")
    wanted = left.select("node")
    if also is not None:
        wanted = wanted.unionByName(also.select(F.explode(F.array("a", "b")).alias("node")))
    sets = written(briefed(sets_of(wanted.distinct())), "links-sets")
    edges = None
    for drawn in range(ROUNDS):
        heads = left.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", "key", F.lit(drawn)), "node", "n", "root")).alias("head"))
        star = spread_join(left, heads, "key", "node").where((F.col("root") != F.col("head.root")) & fits(F.col("n"), F.col("head.n")))
        star = star.select(F.least("node", "head.node").alias("a"), F.greatest("node", "head.node").alias("b"))
        star = verified(star if drawn or also is None else star.unionByName(also.select("a", "b")), sets, least)
        edges = written(star if edges is None else edges.unionByName(star), "links-star")
        # of what is joined, a tree is enough; keys whose nodes are all in one component need no more pairs
        roots = written(components(edges), "links-roots")
        edges = roots.where("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b"))
        placed = written(left.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "links-placed")
        mixed = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
        left = written(spread_join(placed, mixed, "key", "node"), "links-left")
        if left.isEmpty():
            return edges
    small = left.where(F.col("size") <= bucket)
    other = small.select("key", F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("root").alias("root_b"))
    few = small.withColumnRenamed("node", "a").join(other, "key").where((F.col("a") < F.col("b")) & (F.col("root") != F.col("root_b")) & fits(F.col("n"), F.col("n_b"))).select("a", "b")
    large = left.where(F.col("size") > bucket).select("node", "root").distinct()
    firsts = written(rare(sets.join(large.select("node"), "node"), least).join(large, "node"), "links-rare")
    return edges.unionByName(verified(few.unionByName(sharing(firsts, least)), sets, least))
