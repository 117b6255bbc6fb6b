import random

import xxhash
from pyspark.sql import functions as F
from tables import CLASHING, documents, empty

import corpus_pipeline
from pourscale.llm import nearcopies, simhash


def fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", words) if w]
    if not words:
        return 0
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(prints, distance=2):
    """Component of each by comparing all pairs."""
    parent = {p: p for p in prints}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in parent:
        for b in parent:
            if (a ^ b).bit_count() <= distance:
                parent[max(top(a), top(b))] = min(top(a), top(b))
    return {p: top(p) for p in parent}


def make_texts():
    rng = random.Random(5)
    long = [" ".join(rng.choice("ab cd ef Gh ij klé mn op".split()) + str(rng.randrange(50)) for _ in range(400)) for _ in range(4)]
    near = [t.replace(" ", "  ", 3) for t in long] + [t + " extra" for t in long]
    return long + near + [long[0]] * 5 + [None, "", " \t\n", "one", "One two", "one two three", "x " * 30000] + ["ÉCOLE du soir"]


def test_components_equal_brute_force(spark):
    texts = make_texts()
    rows = simhash.near_duplicates(documents(spark, texts, schema=CLASHING)).collect()
    assert len(rows) == len(texts)
    top = groups({fingerprint(t) for t in texts})
    least = {}
    for i, t in enumerate(texts):
        least.setdefault(top[fingerprint(t)], i)
    for r in rows:
        assert r["fp"] % (1 << 64) == fingerprint(texts[r["doc_id"]])
        assert r["component_id"] == least[top[fingerprint(texts[r["doc_id"]])]]


def test_links_in_hot_buckets_lose_nothing(spark):
    rng = random.Random(1)
    centres = [rng.getrandbits(64) for _ in range(3)]
    prints = {c ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for c in centres for _ in range(60)} | {rng.getrandbits(64) for _ in range(50)}
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    frame = spark.createDataFrame(signed, "fp bigint")
    wanted = groups(prints)
    for bucket in (4, 256):
        roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(frame, bucket=bucket)).collect()}
        found = {}
        for (s,) in signed:
            found.setdefault(roots.get(s, s), set()).add(s % (1 << 64))
        expected = {}
        for p, t in wanted.items():
            expected.setdefault(t, set()).add(p)
        assert sorted(map(sorted, found.values())) == sorted(map(sorted, expected.values()))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001)], "a bigint, b bigint")
    roots = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert roots == {i: 0 for i in range(201)} | {1000: 1000, 1001: 1000}


def test_keep_one(spark):
    texts = make_texts()
    docs = documents(spark, texts, schema=CLASHING)
    docs = docs.unionByName(docs).unionByName(spark.createDataFrame([(None, "a text of its own here", None, None, None, *["x"] * 3, *[1] * 5)], CLASHING))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    top = groups({fingerprint(t) for t in texts})
    least = {}
    for i, t in enumerate(texts):
        least.setdefault(top[fingerprint(t)], i)
    assert sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in kept.collect()) == sorted([-1, *least.values()])


def test_empty_table(spark):
    assert simhash.near_duplicates(empty(spark)).count() == 0 and simhash.keep_one(empty(spark)).count() == 0


def edited(text, n, rng):
    words = text.split()
    for at in rng.sample(range(len(words)), n):
        words[at] = f"changed{rng.randrange(10**6)}"
    return " ".join(words)


def similarity(a, b):
    runs = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} for w in (a.lower().split(), b.lower().split())]
    return len(runs[0] & runs[1]) / len(runs[0] | runs[1])


def test_near_copies_equal_brute_force_on_edited_copies(spark):
    rng = random.Random(11)
    texts = [" ".join(f"w{rng.randrange(500)}" for _ in range(300)) for _ in range(40)]
    texts += [edited(t, n, rng) for t, n in zip(texts, [1, 2, 4, 6, 8, 20] * 7)] + ["one two", "One  two", "one three", "", None]
    parent = list(range(len(texts)))
    for i, a in enumerate(texts):
        for j in range(i):
            if parent[i] != parent[j] and (similarity(a, texts[j]) if a and texts[j] else not a and not texts[j] or -1) >= 0.8:
                low, high = sorted((parent[i], parent[j]))
                parent = [low if p == high else p for p in parent]
    docs = documents(spark, texts, schema=CLASHING)
    found = {r["doc_id"]: r["component_id"] for r in nearcopies.near_copies(docs).collect()}
    assert found == dict(enumerate(parent))
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(parent))


def test_near_copies_take_simhash_links_that_share_no_key(spark):
    rng = random.Random(13)
    centres = [rng.getrandbits(64) for _ in range(3)]
    prints = [c ^ (1 << rng.randrange(64)) for c in centres for _ in range(6)] + centres + [rng.getrandbits(64) for _ in range(4)] + centres[:1]
    signed = [(p - (1 << 64) if p >> 63 else p, node) for node, p in enumerate(prints)]
    top = groups(set(prints))
    pairs = nearcopies.simhash_pairs(spark.createDataFrame(signed + signed[:5], "fp bigint, node bigint")).cache()
    least = {}
    for node, p in enumerate(prints):
        least.setdefault(top[p], node)
    roots = {r["node"]: r["root"] for r in nearcopies.components(pairs).collect()}
    assert all(roots.get(node, node) == least[top[p]] for node, p in enumerate(prints))
    # nodes without any key are linked by these pairs where their sets are similar, and only there
    sets = {node: list(range(100 * (node % 2), 100 * (node % 2) + 50 + node)) for node in range(len(prints))}
    frame = spark.createDataFrame(list(sets.items()), "node bigint, members array<bigint>")
    bare = frame.select("node", F.size("members").cast("bigint").alias("n"), F.array().cast("array<bigint>").alias("keys"))
    linked = nearcopies.links(bare, lambda wanted: frame.join(wanted, "node"), (4, 5), also=pairs).collect()
    like = lambda a, b: len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b]))
    wanted = [(r["a"], r["b"]) for r in pairs.collect() if like(r["a"], r["b"]) >= 0.8]
    parent = {}
    for a, b in sorted(wanted):
        parent[b] = parent.get(a, a)
    assert wanted and {n: r for n, r in parent.items() if n != r}.keys() == {r["b"] for r in linked}


def test_near_copies_in_large_groups_lose_no_pair(spark):
    rng = random.Random(12)
    base = " ".join(f"w{i}" for i in range(300))
    chain = [base]
    for _ in range(30):  # far ends are linked only through what lies between
        chain.append(edited(chain[-1], 5, rng))
    rng.shuffle(chain)
    docs = documents(spark, chain + [edited(base, 2, rng) for _ in range(60)])
    assert {r["component_id"] for r in nearcopies.near_copies(docs).collect()} == {0}
