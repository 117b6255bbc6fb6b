"""Mixing sources to target weights by a low-discrepancy schedule.

Golden-ratio points are mapped through the cumulative target weights, so that every
stretch of slots holds each source near its share. Each source's documents, shuffled
by a hash of their ids, form a stream that is cut into blocks of ``block_words``
words; the r-th slot of a source takes its r-th block, and passes begin anew when
the stream is used up. Ranks are prefix sums over chunks of slots and offsets are
prefix sums over hash buckets, so no source is ordered in one task.

A null text has size 0 and is never taken. Null sources form a source of their own,
which sorts last; rows with equal ids are taken each for itself. Targets stop at
``max_epochs`` times a source's size; the excess is shared out anew by weight.
The table of sources, a weight for each, is held by the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pourscale.llm.common import unused, written

GOLDEN = 0.6180339887498949
BLOCK_WORDS = 1024
CHUNK = 1 << 16
BUCKET_ROWS = 4096
MAX_EPOCHS = 2.0
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5


def word_count(text="text"):
    """Number of runs without ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def capped_targets(sizes: Sequence[float], weights: Sequence[float], total: float, max_epochs: float = MAX_EPOCHS) -> np.ndarray:
    """total shared by weight, none above max_epochs times its size, the excess shared anew."""
    sizes, weights = np.asarray(sizes, float), np.asarray(weights, float)
    out, free = max_epochs * sizes, np.ones(len(sizes), bool)
    while free.any():
        share = (total - out[~free].sum()) * weights / weights[free].sum()
        over = free & (share > max_epochs * sizes)
        if not over.any():
            out[free] = share[free]
            break
        free &= ~over
    return out


def points(first: int, n: int) -> np.ndarray:
    """Golden-ratio points of the slots first to first + n."""
    high, low = divmod(np.arange(first, first + n, dtype=np.int64), 1 << 20)
    return np.mod(np.mod(high * ((1 << 20) * GOLDEN % 1.0), 1.0) + low * GOLDEN, 1.0)


def slot_ranks(spark, targets: np.ndarray, quotas: np.ndarray) -> DataFrame:
    """slot, source number and rank (from 0), each source with exactly its quota of ranks."""
    total = int(quotas.sum())
    bounds = np.cumsum(targets)[:-1] / max(targets.sum(), 1e-300)
    chunks = -(-total // CHUNK)
    n = len(targets)

    def drawn(chunk: int) -> np.ndarray:
        return np.searchsorted(bounds, points(chunk * CHUNK, min(CHUNK, total - chunk * CHUNK)), side="right")

    def counted(batches):
        for batch in batches:
            for chunk in batch["id"]:
                counts = np.bincount(drawn(chunk), minlength=n)
                yield pd.DataFrame({"chunk": chunk, "src": np.arange(n), "n": counts}).query("n > 0")

    ids = spark.range(0, chunks, 1, max(1, min(chunks, 4096)))
    counts = ids.mapInPandas(counted, "chunk bigint, src bigint, n bigint")
    before = Window.partitionBy("src").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = written(counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "mix-counts")
    firsts = counts.groupBy("chunk").agg(F.collect_list(F.struct("src", "before")).alias("firsts"))

    def ranked(batches):
        for batch in batches:
            for chunk, firsts in zip(batch["chunk"], batch["firsts"]):
                src, base = drawn(chunk), np.zeros(n, np.int64)
                for f in firsts:
                    base[f["src"]] = f["before"]
                order = np.argsort(src, kind="stable")
                starts = np.searchsorted(src[order], np.arange(n))
                rank = np.empty(len(src), np.int64)
                rank[order] = np.arange(len(src)) - starts[src[order]]
                yield pd.DataFrame({"slot": chunk * CHUNK + np.arange(len(src)), "src": src, "rank": rank + base[src]})

    quota = spark.createDataFrame([(i, int(q)) for i, q in enumerate(quotas)], "src bigint, quota bigint")
    slots = firsts.mapInPandas(ranked, "slot bigint, src bigint, rank bigint").join(F.broadcast(quota), "src").where("rank < quota").select("slot", "src", "rank")
    # the points give a source its quota but for a few slots: those follow at the end
    given = counts.groupBy("src").agg(F.sum("n").alias("n"))
    late = quota.join(given, "src", "left").withColumn("n", F.coalesce("n", F.lit(0))).where("n < quota")
    late = late.select("src", F.explode(F.sequence("n", F.col("quota") - 1)).alias("rank"))
    return slots.unionByName(late.select((F.lit(total) + F.col("rank") * n + F.col("src")).alias("slot"), "src", "rank"))


def mix(docs: DataFrame, keys: list[str], weight_of: Callable[[int], float] = lambda i: WEIGHTS[i % len(WEIGHTS)], share: float = SHARE, max_epochs: float = MAX_EPOCHS, block_words: int = BLOCK_WORDS, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """Rows of docs (its columns ``keys``) with mix_source, mix_size, source_size, target and taken; and the schedule.

    weight_of gives the weight of the i-th source by code point. The schedule has slot, source, pass
    and block; block b of a source covers its stream from b * block_words on.
    """
    spark = docs.sparkSession
    held = [unused(docs, f"key_{i}") for i in range(len(keys))]
    rows = docs.select(*(F.col(k).alias(h) for k, h in zip(keys, held)), F.col("source").alias("mix_source"), word_count().alias("mix_size"))
    rows = written(rows.withColumn("mix_row", F.monotonically_increasing_id()), "mix-sizes")
    table = rows.groupBy("mix_source").agg(F.sum("mix_size").alias("size"), F.count(F.lit(1)).alias("n")).collect()  # a row for each source
    table.sort(key=lambda r: (r["mix_source"] is None, r["mix_source"] or ""))
    sizes = np.array([r["size"] for r in table], np.int64)
    targets = capped_targets(sizes, [weight_of(i) for i in range(len(table))], share * float(sizes.sum()), max_epochs)
    words = np.minimum(np.rint(targets), np.floor(max_epochs * sizes)).astype(np.int64)  # taken of each source
    whole, rest = np.divmod(words, np.maximum(sizes, 1))
    blocks = -(-sizes // block_words)
    quotas = whole * blocks - (-rest // block_words)
    listed = [(r["mix_source"], i, int(sizes[i]), float(targets[i]), int(words[i]), int(blocks[i]), max(1, -(-r["n"] // BUCKET_ROWS))) for i, r in enumerate(table)]
    sources = spark.createDataFrame(listed, "mix_source string, src bigint, source_size bigint, target double, words bigint, blocks bigint, buckets bigint")
    known = rows.join(F.broadcast(sources), rows["mix_source"].eqNullSafe(sources["mix_source"])).drop(sources["mix_source"])

    known = known.withColumn("draw", F.xxhash64(F.lit(seed), *held)).withColumn("bucket", F.pmod(F.xxhash64("draw"), "buckets"))
    sums = known.groupBy("src", "bucket").agg(F.sum("mix_size").alias("n"))
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("src", "bucket", F.coalesce(F.sum("n").over(before("src").orderBy("bucket")), F.lit(0)).alias("base"))
    within = F.coalesce(F.sum("mix_size").over(before("src", "bucket").orderBy("draw", "mix_row")), F.lit(0))
    stream = known.where("mix_size > 0").withColumn("within", within).join(sums, ["src", "bucket"]).withColumn("start", F.col("base") + F.col("within"))
    first, last = F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("mix_size") - 1) / block_words)
    pieces = stream.select("mix_row", "src", "start", (F.col("start") + F.col("mix_size")).alias("end"), F.explode(F.sequence(first, last)).alias("block"))

    schedule = slot_ranks(spark, targets, quotas).join(F.broadcast(sources), "src")
    schedule = schedule.withColumn("pass", F.floor(F.col("rank") / F.col("blocks"))).withColumn("block", F.col("rank") % F.col("blocks"))
    # the last slot of a source stops where its words are complete
    until = F.least((F.col("block") + 1) * block_words, F.col("words") - F.col("pass") * F.col("source_size"))
    slots = written(schedule.select("slot", "src", "mix_source", "pass", "block", until.alias("until")), "mix-slots")
    taken = pieces.join(slots.drop("mix_source"), ["src", "block"]).select(
        "mix_row", F.greatest(F.lit(0), F.least("end", "until") - F.greatest("start", F.col("block") * block_words)).alias("n")
    )
    taken = taken.groupBy("mix_row").agg(F.sum("n").alias("taken"))
    out = known.join(taken, "mix_row", "left").select(
        *(F.col(h).alias(k) for k, h in zip(keys, held)), "mix_source", "mix_size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken")
    )
    return out, slots.drop("src", "until")
