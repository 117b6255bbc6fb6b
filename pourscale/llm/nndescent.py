"""Approximate nearest neighbours: NN-descent builds a graph, queries search it greedily.

Equal vectors are one node, so copies neither crowd the graph nor hide each other.
The graph starts from random cells: rows with the same signs of ``bits`` random
projections, in groups of at most ``CELL``, are compared with one another. Then each
round joins every node's neighbours and the nodes that have it as a neighbour: these
neighbours of neighbours are compared, and a pair is kept where it improves on the
worse neighbour of either side. Only pairs with a neighbour that is new since the last
round are compared.

A query starts from fixed entry nodes and, where its vector is a node, from that
node's neighbours. Each round it expands the nearest nodes of its beam that it hasn't
expanded, by a join with the graph, and keeps the ``beam`` nearest; it ends when all
are expanded. The nodes found are expanded to rows, and distances are computed from
the original vectors in double precision.

Zero vectors take no part. Ties go to the smaller id. Every row is in the index: no
sample is drawn but for the ``entries`` entry nodes, those with the smallest hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pourscale.llm.common import written

NEIGHBOURS = 24
CELLS = 4
CELL = 512
ROUNDS = 3
BEAM = 384
STEP = 128
ENTRIES = 64
PAIRS = "node bigint, other bigint, dist float"


def _floats(column) -> np.ndarray:
    """Rows of an Arrow column of binary float32 vectors."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(len(column), -1)


def _packed():
    def to_bytes(batches):
        for b in batches:
            rows = [np.array(v, np.float32).tobytes() for v in b["vector"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["node"], pa.array(rows, pa.binary())], ["node", "vec"])

    return to_bytes


def _groups(batches):
    """Whole groups of a stream sorted by its first column, as lists of tables' columns."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        rest = table if rest is None else pa.concat_tables([rest, table])
        key = rest.column(0).to_numpy()
        if len(key) and key[0] != key[-1]:
            last = int(np.searchsorted(key, key[-1]))
            yield rest.slice(0, last)
            rest = rest.slice(last)
    if rest is not None and len(rest):
        yield rest


def _spans(key: np.ndarray):
    cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
    return zip(cut[:-1], cut[1:])


def _distances(x: np.ndarray) -> np.ndarray:
    sq = np.einsum("ij,ij->i", x, x)
    return np.maximum(sq[:, None] + sq[None] - 2 * (x @ x.T), 0)


def _emit(out):
    nodes, others, dists = (np.concatenate([o[i] for o in out]) for i in range(3))
    return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(others, pa.int64()), pa.array(dists, pa.float32())], ["node", "other", "dist"])


def _cell_pairs(k: int):
    """From rows (cell, node, vec) sorted by cell: each node's k nearest of its cell."""

    def pairs(batches):
        for table in _groups(batches):
            node, x, out = table["node"].to_numpy(), _floats(table["vec"]), []
            for a, b in _spans(table["cell"].to_numpy()):
                if b - a > 1:
                    d = _distances(x[a:b])
                    np.fill_diagonal(d, np.inf)
                    near = np.argpartition(d, min(k, b - a - 1) - 1, axis=1)[:, : min(k, b - a - 1)]
                    out.append((np.repeat(node[a:b], near.shape[1]), node[a:b][near.ravel()], np.take_along_axis(d, near, 1).ravel()))
            if out:
                yield _emit(out)

    return pairs


def _joined_pairs(batches):
    """From rows (hub, node, worst, fresh, vec) sorted by hub: pairs of a hub's nodes, one of them fresh, that improve on a node's worst neighbour."""
    for table in _groups(batches):
        node, worst, fresh, x, out = table["node"].to_numpy(), table["worst"].to_numpy(), table["fresh"].to_numpy(zero_copy_only=False), _floats(table["vec"]), []
        for a, b in _spans(table["hub"].to_numpy()):
            f = fresh[a:b]
            if b - a > 1 and f.any():
                d = _distances(x[a:b])
                better = (f[:, None] | f[None]) & (d < worst[a:b, None]) & (node[a:b, None] != node[None, a:b])
                i, j = np.nonzero(better)
                if len(i):
                    out.append((node[a + i], node[a + j], d[i, j]))
        if out:
            yield _emit(out)


def _nearest(pairs: DataFrame, k: int) -> DataFrame:
    """The k nearest others of each node; fresh where the pair came without the mark of an old one."""
    once = pairs.groupBy("node", "other").agg(F.min("dist").alias("dist"), F.min("fresh").alias("fresh"))
    near = Window.partitionBy("node").orderBy("dist", "other")
    return once.withColumn("place", F.row_number().over(near)).where(F.col("place") <= k)


def build_graph(nodes: DataFrame, width: int, k: int = NEIGHBOURS, cells: int = CELLS, rounds: int = ROUNDS, seed: int = 11) -> DataFrame:
    """node, other, dist (squared), fresh and place: k neighbours of each of the nodes (node, vec)."""
    spark = nodes.sparkSession
    n = nodes.count()
    bits = max(0, int(np.log2(max(n, 1) / (CELL / 2))))
    planes = np.random.default_rng(seed).normal(size=(cells, width, bits)).astype(np.float32)

    def celled(batches):
        for b in batches:
            x = _floats(b["vec"])
            for i in range(cells):
                sign = (x @ planes[i] > 0) @ (1 << np.arange(bits, dtype=np.int64)) if bits else np.zeros(len(x), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(sign * cells + i), b["node"], b["vec"]], ["cell", "node", "vec"])

    marked = nodes.mapInArrow(celled, "cell bigint, node bigint, vec binary")
    # a cell with more rows than CELL is dealt into groups by hash
    sizes = marked.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CELL)
    dealt = marked.join(sizes, "cell", "left").withColumn("cell", F.xxhash64("cell", F.pmod(F.xxhash64("node"), F.coalesce(F.ceil(F.col("n") / (CELL / 2)), F.lit(1)))))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 20_000)
    first = dealt.select("cell", "node", "vec").repartition(parts, "cell").sortWithinPartitions("cell").mapInArrow(_cell_pairs(k), PAIRS)
    graph = written(_nearest(first.withColumn("fresh", F.lit(True)), k), "nn-graph")
    for _ in range(rounds):
        worst = graph.groupBy("node").agg(F.max("dist").alias("worst"), F.count(F.lit(1)).alias("n"))
        worst = nodes.join(worst, "node", "left").select("node", "vec", F.when(F.col("n") >= k, F.col("worst")).otherwise(F.lit(float("inf"))).cast("float").alias("worst"))
        # of the nodes that have a node as neighbour, k take part: which ones is a hash, so hubs don't grow
        back = Window.partitionBy("hub").orderBy(F.desc("fresh"), "draw")
        reverse = graph.select(F.col("other").alias("hub"), "node", "fresh", F.xxhash64("node", "other").alias("draw")).withColumn("at", F.row_number().over(back)).where(F.col("at") <= k)
        members = graph.select(F.col("node").alias("hub"), F.col("other").alias("node"), "fresh").unionByName(reverse.select("hub", "node", "fresh"))
        members = members.groupBy("hub", "node").agg(F.max("fresh").alias("fresh")).join(worst, "node").select("hub", "node", "worst", "fresh", "vec")
        more = members.repartition(parts, "hub").sortWithinPartitions("hub").mapInArrow(_joined_pairs, PAIRS).withColumn("fresh", F.lit(True))
        graph = written(_nearest(more.unionByName(graph.select("node", "other", "dist", F.lit(False).alias("fresh"))), k), "nn-graph")
    return graph


def _advance(beam: int, step: int):
    """One query's beam (arrays near, dist, done) with the candidates found, and the next nodes to expand."""

    def advance(batches):
        for table in _groups(batches):
            query = table["query"].to_numpy()
            lists = [table[c].to_pylist() for c in ("ids", "dists", "done")]
            out = []
            for a, b in _spans(query):
                ids, dists, done = (np.concatenate([np.asarray(x, t) for x in c[a:b]]) for c, t in zip(lists, (np.int64, np.float32, bool)))
                order = np.lexsort((~done, ids))  # of equal nodes the expanded one
                ids, dists, done = ids[order], dists[order], done[order]
                keep = np.r_[True, ids[1:] != ids[:-1]]
                ids, dists, done = ids[keep], dists[keep], done[keep]
                order = np.lexsort((ids, dists))[:beam]
                ids, dists, done = ids[order], dists[order], done[order]
                todo = ids[~done][:step]
                done = done | np.isin(ids, todo)
                out.append((query[a], ids.tolist(), dists.tolist(), done.tolist(), todo.tolist()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float32()), pa.list_(pa.bool_()), pa.list_(pa.int64())))], ["query", "ids", "dists", "done", "todo"])

    return advance


def _measured(batches):
    """From rows (query, asked, nodes, vecs): the distances from the query's vector to the nodes."""
    for b in batches:
        out = []
        for query, asked, nodes, vecs in zip(*(b[c].to_pylist() for c in ("query", "asked", "nodes", "vecs"))):
            q = np.frombuffer(asked, np.float32)
            d = np.frombuffer(b"".join(vecs), np.float32).reshape(len(nodes), -1) - q
            out.append((query, nodes, np.einsum("ij,ij->i", d, d).tolist(), [False] * len(nodes)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float32()), pa.list_(pa.bool_())))], ["query", "ids", "dists", "done"])


def search(nodes: DataFrame, graph: DataFrame, asked: DataFrame, beam: int = BEAM, step: int = STEP, entries: int = ENTRIES) -> DataFrame:
    """query and node for the beam of each of the queries (query, own node or null, asked: its vector)."""
    spark = nodes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    state_schema = "query bigint, ids array<bigint>, dists array<float>, done array<boolean>"
    adjacent = graph.join(nodes.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.collect_list("other").alias("nodes"), F.collect_list("vec").alias("vecs"))
    adjacent = written(adjacent.repartition(parts, "node"), "nn-adjacent")
    gates = nodes.orderBy(F.xxhash64("node"), "node").limit(entries).agg(F.collect_list("node").alias("nodes"), F.collect_list("vec").alias("vecs"))
    asked = written(asked, "nn-queries")
    first = asked.crossJoin(F.broadcast(gates)).select("query", "asked", "nodes", "vecs")  # one row of entry nodes
    own = asked.join(adjacent.withColumnRenamed("node", "own"), "own").select("query", "asked", "nodes", "vecs")
    found = first.unionByName(own).mapInArrow(_measured, state_schema)
    while True:
        state = found.repartition(parts, "query").sortWithinPartitions("query").mapInArrow(_advance(beam, step), state_schema + ", todo array<bigint>")
        state = written(state, "nn-beam")
        todo = state.select("query", F.explode("todo").alias("node"))
        if todo.isEmpty():
            return state.select("query", F.explode("ids").alias("node"))
        # the beam's worst distance is known only to the next round; the graph's rows carry their neighbours' vectors
        met = todo.join(asked.select("query", "asked"), "query").join(adjacent, "node").select("query", "asked", "nodes", "vecs")
        found = met.mapInArrow(_measured, state_schema).unionByName(state.select("query", "ids", "dists", "done"))


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, neighbours: int = NEIGHBOURS, beam: int = BEAM, rounds: int = ROUNDS) -> DataFrame:
    """query_id, rank (from 1), id and score, the Euclidean distance, of the k nearest other rows found for each query.

    vectors: id and vector (array of double, all of one length: others are filled with zeros); is_query marks the queries.
    """
    width = max(1, vectors.agg(F.max(F.size("vector"))).first()[0] or 1)
    filled = F.concat("vector", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("vector")))
    zero = F.forall("vector", lambda x: x == 0)
    rows = written(vectors.where(~zero).select("id", filled.alias("vector"), is_query.alias("asks"), F.xxhash64(F.transform(filled, lambda x: x + 0.0)).alias("node")), "nn-rows")
    # a node stands for its rows with the smallest ids: no query needs more than k and its own
    few = Window.partitionBy("node").orderBy("id")
    members = rows.select("node", "id").withColumn("at", F.row_number().over(few)).where(F.col("at") <= k + 1).select("node", "id")
    nodes = written(rows.groupBy("node").agg(F.min_by("vector", "id").alias("vector")).mapInArrow(_packed(), "node bigint, vec binary"), "nn-nodes")
    graph = build_graph(nodes, width, neighbours, rounds=rounds)
    asking = rows.where("asks")
    asked = asking.select(F.col("id").alias("query"), F.col("node").alias("own")).join(nodes.withColumnRenamed("node", "own"), "own").select("query", "own", F.col("vec").alias("asked"))
    found = search(nodes, graph, asked, beam=beam).unionByName(asked.select("query", F.col("own").alias("node"))).distinct()
    pairs = found.join(members, "node").where("id <> query").select("query", "id")
    pairs = pairs.join(rows.select("id", "vector"), "id").join(asking.select(F.col("id").alias("query"), F.col("vector").alias("from")), "query")
    square = F.zip_with("vector", "from", lambda a, b: (a - b) * (a - b))
    scored = pairs.select(F.col("query").alias("query_id"), "id", F.sqrt(F.aggregate(square, F.lit(0.0), lambda s, x: s + x)).alias("score"))
    best = Window.partitionBy("query_id").orderBy("score", "id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
