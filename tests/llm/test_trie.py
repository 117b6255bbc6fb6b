import hashlib
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from pourscale.llm import ordered, queries, trie

TURNS = "conv_id bigint, turn bigint, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def tie(row):
    role, text = row[2] or "", row[3] or ""
    digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
    return (row[1] is not None, row[1] or 0, int(digest[:15], 16), int(digest[15:30], 16))


def brute(rows):
    given = defaultdict(list)
    for r in sorted((r for r in rows if r[0] is not None), key=tie):
        given[r[0]].append((r[2] or "", r[3] or ""))
    members, ends = defaultdict(list), defaultdict(list)
    for c, own in sorted(given.items()):
        h = zlib.crc32(str(c).encode()) % 6
        made = tuple(given.get(c - c % 100, [])[:h] + own[h:])
        for d in range(len(made) + 1):
            members[made[:d]].append(c)
        ends[made].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    out, leaves, saved = [], {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in children[p]) or 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(saved[k] for k in children[p])
        parent = members[p[:-1]][0] if p else None
        out.append((members[p][0], len(p), parent, len(members[p]), len(children[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends.get(p, []))).encode()).hexdigest()))
    return sorted(out, key=str)


def asked(spark, given, tmp_path, schema=TURNS):
    table = spark.createDataFrame(given, TURNS).withColumn("pos", F.lit(1)).withColumn("depth", F.lit("x")).withColumn("s", F.lit(1))
    table.write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    out = queries.op13_prefix_trie(spark, str(tmp_path))
    assert out.columns == COLUMNS and [f.dataType.simpleString() for f in out.schema] == ["bigint"] * 7 + ["string"]
    return sorted((tuple(r) for r in out.collect()), key=str)


def conversations(seed, n, texts=4, longest=9):
    draw, out = random.Random(seed), []
    for conv in draw.sample(range(700), n):
        for turn in range(draw.randint(1, longest)):
            out.append((conv, draw.choice([turn, turn, None]), draw.choice(["user", "user", "assistant", None]), draw.choice(["", None, "é", "x" * 700, *"abcdefgh"][: texts + 2])))
    return out


def test_equal_to_brute_force_with_nulls_ties_and_repeated_rows(spark, tmp_path):
    given = conversations(1, 150) + [(None, 1, "user", "a"), (None, None, None, None)]
    given += given[:30]
    assert asked(spark, given, tmp_path) == brute(given)


def test_long_conversations_by_small_blocks_and_frequent_keys(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 7)
    monkeypatch.setattr(trie, "SPAN", 5)
    monkeypatch.setattr(ordered.spread_join, "__defaults__", ("inner", 3))
    draw = random.Random(5)
    trunk = [("user", draw.choice("abc")) for _ in range(130)]
    given = conversations(2, 60, texts=2)
    for conv in (801, 802, 817, 900, 905, 977, 1000, 1001, 1002, 1003):
        at = draw.choice([3, 40, 64, 65, 100, 130])
        given += [(conv, t, *x) for t, x in enumerate(trunk[:at] + [("assistant", draw.choice("pq"))] * draw.choice([0, 1, 30]))]
    assert asked(spark, given, tmp_path) == brute(given)


def test_copies_turnless_conversations_and_an_empty_table(spark, tmp_path):
    assert asked(spark, [], tmp_path) == []
    one = [(c, t, "user", "abc"[t]) for c in range(100, 400) for t in range(3)]
    assert asked(spark, one, tmp_path) == brute(one)
    turnless = [(c, 0, "user", "a") for c in range(1, 40)]  # no conversation 0: short ones lose all turns
    rows = brute(turnless)
    assert any(r[1] == 0 and r[7] != hashlib.sha256(b"").hexdigest() for r in rows)
    assert asked(spark, turnless, tmp_path) == rows


def test_two_fattest_number(spark):
    pairs = [(a, b) for a in range(40) for b in range(a + 1, 41)] + [(2**40, 2**41 + 5)]
    rows = spark.createDataFrame(pairs, "a bigint, b bigint").select("a", "b", trie.two_fattest(F.col("a"), F.col("b")).alias("f")).collect()
    low = lambda x: x & -x
    assert all(a < f <= b for a, b, f in rows)
    assert all(low(f) == max(map(low, range(a + 1, b + 1))) for a, b, f in rows if b < 100)


def test_search_finds_where_conversations_leave_the_trie(spark):
    draw = random.Random(9)
    strings = sorted({tuple(draw.choice("ab") for _ in range(draw.randint(1, 20))) for _ in range(120)})
    turns = spark.createDataFrame([(i, d + 1, ord(x), 1, 1) for i, s in enumerate(strings) for d, x in enumerate(s)], "conv_id bigint, d bigint, k1 bigint, k2 bigint, size bigint")
    convs = spark.createDataFrame([(i, len(s)) for i, s in enumerate(strings)], "conv_id bigint, n bigint")
    paths = trie.written(trie.prefixes(turns), "paths")
    found = trie.written(trie.ends(paths, convs), "ends")
    root = spark.createDataFrame([(0, 0, 0, -1, *[None] * 8)], trie.NODE)
    half = trie.inserted(found.where("s % 2 = 0"), root, paths)
    known = {s[:d] for i, s in enumerate(strings) if i % 2 == 0 for d in range(len(s) + 1)}
    rows = trie.located(found.where("s % 2 = 1"), half, paths).collect()
    assert {r["s"]: r["m"] for r in rows} == {i: max(d for d in range(len(s) + 1) if s[:d] in known) for i, s in enumerate(strings) if i % 2}
