"""Exact top-k search without random access (the NRA method).

Candidates and queries are dealt into blocks by hash and every query block meets
every candidate block in a task of its own. In a block each component has a list
sorted by value, which a query reads from the end that helps it. After each round of
reading, a row's score lies between the sum of what was read of it plus the lists'
least values and that sum plus the lists' present values. Rows whose upper bound lies
below the k-th largest lower bound are outsiders; reading stops when only ``few`` rows
can still qualify or the lists end, and their scores are then resolved. The best k of
a block's rows meet those of the other blocks by query. Nothing is looked up by row before that: a row's sum grows only
as its entries come up in the lists. The queries of a block read to the same depths, so the
bounds of all of them are made at once.

Ties go to the smaller id, and bounds keep rows that may tie. Vectors of unequal
length are compared as if filled with zeros. Scores are exact up to 2**63.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pourscale.llm.common import written
from pourscale.llm.vectors import matrix

BLOCK_ROWS = 4096
QUERY_ROWS = 512
FEW = 64
#: Bounds are compared when so many of a list's STRIDES parts have been read.
STRIDES = 16
STOPS = (1, 2, 4, 8, 12, 14, 15, 16)


class SortedLists:
    """A block's rows as lists, one for each component: its values in order, each with its row's number."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        order = np.argsort(rows, axis=0, kind="stable")
        self.values = np.take_along_axis(rows, order, axis=0)
        self.place = np.empty(rows.shape, np.int32)  # where in each list a row comes up
        np.put_along_axis(self.place, order, np.broadcast_to(np.arange(len(rows), dtype=np.int32)[:, None], rows.shape), axis=0)
        self.entries_read = 0  # entries of all lists, over all searches

    def search(self, query: np.ndarray, own: int, k: int, few: int = FEW) -> tuple[np.ndarray, np.ndarray]:
        """The ids and scores of the k best rows but the query's own."""
        return self.search_all(query[None], np.array([own]), k, few)[0]

    def search_all(self, queries: np.ndarray, own: np.ndarray, k: int, few: int = FEW) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the ids and scores of its k best rows but its own.

        Lists are read from the end that helps a query, all queries to the same depth, so one product of matrices makes
        the bounds of all of them. A row counts with its value in the lists where it was met; in the others with the
        list's present value for the upper bound and its least one for the lower.
        """
        n, used = len(self.rows), np.count_nonzero(queries, axis=1)
        found = [None] * len(queries)
        going = np.flatnonzero((used > 0) & (n > max(few, k)))
        # a list read from its top, and the same list read from its bottom
        weights = np.hstack([np.maximum(queries, 0), np.minimum(queries, 0)])
        alive = self.ids != own[going, None]
        depth = 0
        for until in self._depths():
            if not len(going):
                break
            self.entries_read += int(used[going].sum()) * (until - depth)
            depth = until
            high, low = self.values[n - depth], self.values[depth - 1]
            upper = weights[going] @ np.hstack([np.maximum(self.rows, high), np.minimum(self.rows, low)]).T
            lower = weights[going] @ np.hstack([
                np.where(self.place >= n - depth, self.rows, self.values[0]), np.where(self.place < depth, self.rows, self.values[-1])
            ]).T
            lower = np.where(alive, lower, lower.min(1, keepdims=True) - 1)
            alive &= upper >= np.partition(lower, n - k, axis=1)[:, n - k, None]
            open_ = alive.sum(1) > max(few, k)
            for i in np.flatnonzero(~open_):
                found[going[i]] = self._best(np.flatnonzero(alive[i]), queries[going[i]], k)
            going, alive = going[open_], alive[open_]
        for i, at in enumerate(going):
            found[at] = self._best(np.flatnonzero(alive[i]), queries[at], k)
        return [self._best(np.flatnonzero(self.ids != own[i]), queries[i], k) if f is None else f for i, f in enumerate(found)]

    def _depths(self) -> list[int]:
        """Depths at which bounds are compared: close together near either end, where they part first and last."""
        return sorted({max(1, -(-len(self.rows) * s // STRIDES)) for s in STOPS}) if len(self.rows) else []

    def _best(self, at: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        scores = self.rows[at] @ query
        if len(at) > k:
            near = scores >= np.partition(scores, len(at) - k)[len(at) - k]
            at, scores = at[near], scores[near]
        best = np.lexsort((self.ids[at], -scores))[:k]
        return self.ids[at[best]], scores[best]


def _search_blocks(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    both = matrix([*queries["vector"], *rows["vector"]], np.int64)
    largest = int(np.abs(both).max(initial=0))
    if largest**2 * both.shape[1] < 1 << 53:
        both = both.astype(np.float64)  # exact, and faster
    own = queries["id"].to_numpy(np.int64)
    lists = SortedLists(rows["id"].to_numpy(np.int64), both[len(queries) :])
    found = lists.search_all(both[: len(queries)], own, k)
    return pd.DataFrame({
        "query_id": np.repeat(own, [len(f[0]) for f in found]),
        "id": np.concatenate([f[0] for f in found] or [[]]).astype(np.int64), "score": np.concatenate([f[1] for f in found] or [[]]).astype(np.int64),
    })


def top_k(vectors: DataFrame, is_query: Column, k: int, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank (from 1), id and score, the inner product, of each query's k best other rows.

    vectors: id and vector, an array of whole numbers; is_query marks the queries among them.
    """
    vectors = written(vectors.select("id", "vector", is_query.alias("asks")), "topk-vectors")
    sizes = vectors.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    blocks, groups = max(1, -(-sizes[0] // block_rows)), max(1, -(-sizes[1] // query_rows))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    asked = vectors.where("asks").select("id", "vector", deal(groups).alias("g"), every(blocks).alias("b"))
    rows = vectors.select("id", "vector", deal(blocks).alias("b"), every(groups).alias("g"))
    found = asked.groupBy("g", "b").cogroup(rows.groupBy("g", "b")).applyInPandas(lambda q, r: _search_blocks(q, r, k), "query_id bigint, id bigint, score bigint")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
