import numpy as np
from pyspark.sql import functions as F
from tables import CLASHING, documents, empty

from pourscale.llm import queries, setlinks, superminhash
from pourscale.llm.common import prepare


def words(text):
    out = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in out.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]


def whole_set(text):
    w = words(text)
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {" ".join(w)} - {""}


def brute(rows):
    """(doc_id, size, component_id) of each row, all pairs of sets compared."""
    sets = [whole_set(t) for _, t in rows]
    of = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 85 * (len(a) + len(sets[j]) - both) and of[i] != of[j]:
                old = of[i]
                of = [of[j] if x == old else x for x in of]
    least = {c: min((r[0] for r, x in zip(rows, of) if x == c and r[0] is not None), default=None) for c in set(of)}
    return sorted(((r[0], len(s), least[c]) for r, s, c in zip(rows, sets, of)), key=str)


def texts(seed=3):
    draw, out = np.random.default_rng(seed), []
    common = "alpha Beta gamma delta epsilon zeta eta theta iota kappa".split()
    for i in range(25):
        base = list(draw.choice(common, 60)) + [f"own{i}x{j}" for j in range(30)]
        out.append(" ".join(base))
        for edits in (1, 1, 2, 3, 5, 8):
            near = list(base)
            for at in draw.choice(len(base), edits, replace=False):
                near[at] = f"new{i}"
            out.append((" \n" if edits % 2 else "\t").join(near))
    return out + [None, "", " \t\n", "a", "A", "a b", "one two three four five", "ONE two\x0bthree four five", "Ö ö ä", "ö ö ä", out[0], out[0].upper(), "z " * 30_000, "z " * 40_000]


def found(spark, table):
    prepare(spark)
    return sorted((tuple(r) for r in superminhash.near_duplicates(table).select("doc_id", "n", "component_id").collect()), key=str)


def test_equal_to_brute_force(spark, tmp_path):
    given = texts()
    table = documents(spark, given, schema=CLASHING).withColumn("digest", F.lit(1)).withColumn("node", F.lit(1))
    table = table.unionByName(table.where("doc_id % 7 = 0")).unionByName(table.where("doc_id in (3, 9)").withColumn("doc_id", F.lit(None).cast("bigint")))
    rows = [(r["doc_id"], r["text"]) for r in table.collect()]
    assert found(spark, table) == brute(rows)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op12_superminhash(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out.collect())


def test_large_keys_by_rare_members(spark, monkeypatch):
    monkeypatch.setattr(setlinks, "BUCKET", 2)
    monkeypatch.setattr(setlinks.links, "__defaults__", (2,))
    given = texts(8)
    assert found(spark, documents(spark, given)) == brute(list(enumerate(given)))


def test_pages_of_one_template_are_not_compared_in_pairs(spark, monkeypatch):
    seen = []
    true = setlinks.verified
    monkeypatch.setattr(setlinks, "verified", lambda pairs, *a: (seen.append(pairs.distinct().count()), true(pairs, *a))[1])
    shared = " ".join(f"w{i}" for i in range(300))
    given = [f"{shared} " + " ".join(f"own{k}x{j}" for j in range(40)) for k in range(300)]
    given += [given[5] + " more", given[250] + " more"]
    assert found(spark, documents(spark, given)) == brute(list(enumerate(given)))
    # a draw compares each text once a key; a full comparison would take 45 451 pairs
    assert sum(seen) <= superminhash.BANDS * setlinks.ROUNDS * len(given), seen


def test_pairs_ruled_out_by_first_bits_need_no_whole_sets(spark):
    draw, sets = np.random.default_rng(4), []
    for i in range(40):
        made = np.unique(draw.integers(-(1 << 63), 1 << 63, 300))
        if i >= 30:  # members behind the same first bits
            made = (made >> 56 << 56) + np.arange(len(made))
        keep = [0, 3, 20, 60, 120][i % 5]
        other = np.concatenate([made[keep:], draw.integers(-(1 << 63), 1 << 63, keep)])
        sets += [made.tolist(), np.unique(other).tolist()]
    frame = setlinks.briefed(spark.createDataFrame(list(enumerate(sets)), "node bigint, members array<bigint>")).cache()
    given = [(i, i + 1) for i in range(0, 80, 2)] + [(i, i + 2) for i in range(0, 78, 2)]
    pairs, least = spark.createDataFrame(given, "a bigint, b bigint"), (85, 100)
    like = {(a, b): len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b])) for a, b in given}
    left = {tuple(r) for r in setlinks.close(pairs, frame, least).collect()}
    similar = {p for p, s in like.items() if s >= 0.85}
    assert similar <= left and {tuple(r) for r in setlinks.verified(pairs, frame, least).collect()} == similar
    assert all(like[p] > 0.8 or min(p) >= 60 for p in left)


def test_empty_table(spark):
    assert found(spark, empty(spark)) == []


def test_signature_agrees_as_often_as_sets_do():
    draw, off = np.random.default_rng(1), []
    for _ in range(200):
        members = draw.integers(0, 1 << 63, 400, dtype=np.uint64)
        a, b = superminhash.signatures([members[:300], members[60:360]])
        off.append((a == b).mean() - 240 / 360)
    assert abs(np.mean(off)) < 0.01 and np.var(off) < 240 * 120 / 360**2 / 120  # below independent hash functions


def test_signatures_do_not_depend_on_slices_or_batches(monkeypatch):
    sets = [superminhash.shingles(t) for t in texts()]
    whole = superminhash.signatures(sets)
    monkeypatch.setattr(superminhash, "SLICE", 50)
    assert (superminhash.signatures(sets) == whole).all()
    assert all((superminhash.signatures([s])[0] == w).all() for s, w in zip(sets, whole) if len(s))
