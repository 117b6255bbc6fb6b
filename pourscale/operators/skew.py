"""Joins on keys of which a few hold many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Keys that may be dealt out, the most frequent ones: a bound on what is broadcast.
MOST = 1000
#: Rows of a key that stay together.
EACH = 5000


def salted_join(left: DataFrame, right: DataFrame, on: list[str], by: str, how: str = "inner", each: int = EACH) -> DataFrame:
    """left joined with right; the rows of frequent keys of left are dealt out by the hash of column ``by``.

    A key with n rows in left is split into n / each shares, and its rows of right are repeated for each of them.
    """
    counts = left.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > each).orderBy(F.desc("_n"), *on).limit(MOST)
    hot = F.broadcast(counts.select(*on, F.ceil(F.col("_n") / each).cast("int").alias("_shares")))
    a = left.join(hot, on, "left").withColumn("_share", F.coalesce(F.pmod(F.xxhash64(by), "_shares").cast("int"), F.lit(0))).drop("_shares")
    b = right.join(hot, on, "left").withColumn("_share", F.explode(F.sequence(F.lit(0), F.coalesce("_shares", F.lit(1)) - 1))).drop("_shares")
    return a.join(b, [*on, "_share"], how).drop("_share")


#: Hashes that rows are counted by before keys are.
SLOTS = 65536


def frequent(rows: DataFrame, key: str, over: int) -> DataFrame:
    """The most frequent keys of those with more than ``over`` rows, MOST of them at most; keys beyond hold less than a share of 1 / MOST each.

    Rows are counted by hashes first, and keys only where a hash holds more: no shuffle of all keys, which may be many.
    """
    slot = F.pmod(F.xxhash64(key), F.lit(SLOTS)).alias("_slot")
    full = rows.groupBy(slot).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > over).select("_slot")
    held = rows.select(key, slot).join(F.broadcast(full), "_slot", "left_semi").where(F.col(key).isNotNull())
    return held.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > over).orderBy(F.desc("_n"), key).limit(MOST).select(key)
