import math

import numpy as np
from pyspark.sql import functions as F

from pourscale.llm import nndescent, topk, vectors

SCHEMA = "vec_id bigint, embedding array<float>, id string, vector string, asks string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y", "z") for i, v in rows], SCHEMA)


def odd_rows():
    return [(100, None), (200, [1.0, None]), (300, [math.nan, 1.0]), (400, [math.inf, 0.0]), (None, [1.0, 1.0])]


def test_usable_leaves_out_what_takes_no_part(spark):
    rows = table(spark, odd_rows() + [(1, [2.0]), (1, [1.0]), (2, []), (3, [0.0, 0.0])])
    assert {r["id"]: list(r["vector"]) for r in vectors.usable(rows).collect()} == {1: [1.0], 2: [], 3: [0.0, 0.0]}


def whole(spark, rows):
    return vectors.usable(table(spark, rows)).select("id", F.transform("vector", lambda x: F.floor(x * 256)).alias("vector"))


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 6)).round(1)
    x[50:200] = x[50]  # many ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + odd_rows()
    m = np.floor(256 * x.astype(np.float32).astype(float)).astype(np.int64)
    for block, groups in ((64, 5), (4096, 512)):
        got = {}
        for r in topk.top_k(whole(spark, rows), F.col("id") % 50 == 0, 5, block, groups).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["score"]))
        for q in range(0, 700, 50):
            s = m @ m[q]
            best = [i for i in np.lexsort((np.arange(700), -s)) if i != q][:5]
            assert sorted(got[q]) == [(k + 1, i, s[i]) for k, i in enumerate(best)]
        assert len(got) == 14


def test_reading_stops_before_the_lists_end():
    rng = np.random.default_rng(1)
    rows = np.round(rng.normal(size=(2000, 3)) * 50)
    queries, own = np.array([[1.0, -2.0, 0.0], [3.0, 1.0, -1.0], [0.0, 0.0, 0.0]]), [-1, 7, 9]
    scores = rows @ queries.T
    for j, (query, id_) in enumerate(zip(queries, own)):
        lists = topk.SortedLists(np.arange(2000), rows)
        ids, got = lists.search(query, id_, 5)
        wanted = [i for i in np.lexsort((np.arange(2000), -scores[:, j])) if i != id_][:5]
        assert ids.tolist() == wanted and (got == scores[wanted, j]).all()
        assert lists.entries_read < 2000 * np.count_nonzero(query) or j == 2, lists.entries_read
    assert topk.SortedLists(np.arange(0), rows[:0]).search(queries[0], 1, 5)[0].tolist() == []


def test_every_entry_is_read_where_bounds_never_part():
    lists = topk.SortedLists(np.arange(500), np.ones((500, 4)))
    ids, got = lists.search(np.array([1.0, 2.0, -1.0, 1.0]), 3, 5)
    assert ids.tolist() == [0, 1, 2, 4, 5] and (got == 3).all() and lists.entries_read == 2000


def test_queries_read_together_find_what_each_finds_alone():
    rng = np.random.default_rng(2)
    for dtype in (np.float64, np.int64):
        rows = np.round(rng.normal(size=(900, 5)) * 40).astype(dtype)
        queries = np.round(rng.normal(size=(40, 5)) * 40).astype(dtype)
        queries[7], queries[8, 1:], own = 0, 0, np.arange(40) * 3
        together, read = topk.SortedLists(np.arange(900), rows), 0
        for query, id_, (ids, scores) in zip(queries, own, together.search_all(queries, own, 5)):
            whole_scores = rows @ query
            wanted = [i for i in np.lexsort((np.arange(900), -whole_scores)) if i != id_][:5]
            assert ids.tolist() == wanted and (scores == whole_scores[wanted]).all()
            alone = topk.SortedLists(np.arange(900), rows)
            alone.search(query, id_, 5)
            read += alone.entries_read
        assert together.entries_read == read < 900 * np.count_nonzero(queries)


def test_top_k_of_few_large_and_empty(spark):
    big = [(0, [1e6, 1e6]), (1, [1e6, -3e6]), (2, [])]
    got = [tuple(r) for r in topk.top_k(whole(spark, big), F.col("id") == 0, 5).orderBy("rank").collect()]
    assert got == [(0, 1, 2, 0), (0, 2, 1, -2 * 256000000**2)]
    assert topk.top_k(whole(spark, odd_rows()), F.col("id") % 50 == 0, 5).count() == 0
    assert topk.top_k(whole(spark, [(50, [1.0])]), F.col("id") % 50 == 0, 5).count() == 0


def test_neighbours_recall(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[100:400] = x[100]  # copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + odd_rows() + [(500_000, [0.0] * 16)]
    got = {}
    for r in nndescent.nearest(vectors.usable(table(spark, rows)), F.col("id") % 100 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["score"]))
    assert set(got) == set(range(0, 1500, 100))
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        best = [i for i in np.lexsort((np.arange(1500), d)) if i != q][:10]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11)) and all(abs(d[i] - s) < 1e-12 for _, i, s in found)
        assert found == sorted(found, key=lambda f: (f[2], f[1]))
        hits += len(set(best) & {f[1] for f in found})
    assert hits >= 0.95 * 150
    assert [f[1] for f in got[200]] == list(range(100, 110))


def test_neighbours_of_few_rows_and_none(spark):
    few = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (3, [4.0, 4.0]), (4, [4.0])]
    got = [tuple(r) for r in nndescent.nearest(vectors.usable(table(spark, few)), F.col("id") == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 100, 0.0), (0, 2, 4, 3.0), (0, 3, 3, 5.0)]
    assert nndescent.nearest(vectors.usable(table(spark, odd_rows())), F.col("id") % 100 == 0).count() == 0
