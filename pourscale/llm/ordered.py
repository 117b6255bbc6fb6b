"""Helpers on ordered groups and frequent keys, neither of which puts a large group into one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pourscale.llm.common import written

#: A key that holds more than one in HOT rows is broadcast: there are fewer than HOT of them in any table.
HOT = 1000


def numbered(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """rows with pos, the row's number from 0 within its group by order (nulls first).

    The table is sorted as a whole, so a large group spreads over tasks. Each task numbers its rows by itself; the
    groups that reach over the bounds of tasks, at most one a bound, then have the rows of the tasks before added.
    Rows equal in all of order are numbered in any order.
    """
    schema = rows.select("*", F.lit(0).cast("bigint").alias("pos"), F.lit(0).alias("part"))
    made = [f.name for f in schema.schema]

    def number(batches):
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            key = batch.column(group)
            changes = np.ones(n, bool)
            if n > 1:
                a, b = key.slice(0, n - 1), key.slice(1)
                same = pa.compute.or_(pa.compute.fill_null(pa.compute.equal(a, b), False), pa.compute.and_(a.is_null(), b.is_null()))
                changes[1:] = ~same.to_numpy(zero_copy_only=False)
            first = key[0].as_py()
            goes_on = last is not None and last[0] == first
            at = np.arange(n)
            start = np.maximum.accumulate(np.where(changes, at, 0))
            pos = at - start
            if goes_on:
                pos[: np.flatnonzero(changes)[1] if changes.sum() > 1 else n] += seen
            last, seen = (key[n - 1].as_py(),), int(pos[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pos, pa.int64()), pa.array(np.full(n, part, np.int32))], made)

    done = written(rows.orderBy(group, *order).mapInArrow(number, schema.schema), name)
    firsts = done.groupBy("part").agg(F.min(F.struct(F.col(group).isNotNull(), group)).alias("f")).select(F.col(f"f.{group}").alias("edge")).distinct()
    counts = done.join(F.broadcast(firsts), F.col(group).eqNullSafe(F.col("edge"))).groupBy("edge", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("edge").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    before = counts.select("edge", F.col("part").alias("of"), before.alias("before")).where("before > 0")
    both = done.join(F.broadcast(before), F.col(group).eqNullSafe(F.col("edge")) & (F.col("part") == F.col("of")), "left")
    return both.withColumn("pos", F.col("pos") + F.coalesce("before", F.lit(0))).drop("part", "edge", "of", "before")


def _of(key: list[str]):
    return F.xxhash64(*key)


def join_by(rows: DataFrame, table: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """rows joined with table on key, frequent keys by broadcast.

    table has each key once and in count how many of the ``total`` rows hold it: fewer than HOT keys can be frequent.
    """
    hot = table.where(F.col(count) * HOT > total)
    frequent = _of([key]).isin([r[0] for r in hot.select(_of([key])).collect()])
    some = rows.where(frequent).join(F.broadcast(table.where(frequent & (F.col(count) * HOT > total))), key)
    rest = rows.join(table.where(F.col(count) * HOT <= total), key)
    return some.unionByName(rest)


def spread_join(rows: DataFrame, table: DataFrame, key: str | list[str], by: str, how: str = "inner", each: int = 256, counts: DataFrame | None = None) -> DataFrame:
    """rows joined with table, which has each key once; rows should be cheap to read twice and keys not null.

    Of the keys with over ``each`` rows the HOT most frequent ones are dealt out into shares by the hash of column
    ``by``, and their rows of table are repeated for every share, so no task has to take all rows of a frequent
    key. The driver sees the hashes of these keys and the rows of the largest: that gives the number of shares.
    counts: key and n, the rows of each frequent key, where these are known already.
    """
    key = [key] if isinstance(key, str) else key
    known = rows.groupBy(_of(key).alias("h")).agg(F.count(F.lit(1)).alias("n")) if counts is None else counts.select(_of(key).alias("h"), "n")
    hot = known.where(F.col("n") > each).orderBy(F.desc("n"), "h").limit(HOT).collect()
    if not hot:
        return rows.join(table, key, how)
    frequent, shares = _of(key).isin([r["h"] for r in hot]), min(HOT, -(-hot[0]["n"] // each))
    left = rows.withColumn("share", F.when(frequent, F.pmod(F.xxhash64(by), F.lit(shares)).cast("int")).otherwise(0))
    right = table.withColumn("share", F.explode(F.when(frequent, F.sequence(F.lit(0), F.lit(shares - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, [*key, "share"], how).drop("share")
