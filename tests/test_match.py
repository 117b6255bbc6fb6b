"""Gate candidates against brute force, and similarity values."""

import itertools
import random

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from pourscale.functions import similarity as sim
from pourscale.functions.items import parse_items
from pourscale.operators import match as mt


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for ch in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if ch == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def indel(a, b):
    return 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


def token_sort(a, b):
    return indel(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a, b):
    wa, wb = set(a.split()), set(b.split())
    if not wa or not wb:
        return 0.0
    both = sorted(wa & wb)
    x, y = (" ".join(both + sorted(w - set(both))) for w in (wa, wb))
    if both and (len(both) == len(wa) or len(both) == len(wb)):
        return 1.0
    c = len(" ".join(both))
    return max(indel(x, y), *(2 * c / (c + len(z)) for z in (x, y)))


def jaro(a, b):
    if a == b:
        return 1.0
    reach, used, hits = max(max(len(a), len(b)) // 2 - 1, 0), set(), []
    for j, ch in enumerate(b):
        found = [i for i in range(max(0, j - reach), min(len(a), j + reach + 1)) if i not in used and a[i] == ch][:1]
        used |= set(found)
        hits += [ch] * len(found)
    m = len(hits)
    if not m:
        return 0.0
    sim = (m / len(a) + m / len(b) + (m - sum(x != a[i] for x, i in zip(hits, sorted(used))) // 2) / m) / 3
    same = [x == y for x, y in zip(a[:4], b[:4])]
    return sim + (same + [False]).index(False) * 0.1 * (1 - sim) if sim > 0.7 else sim


TEXTS = st.lists(st.tuples(st.text("abc dé", max_size=30), st.text("abc dé", max_size=90) | st.text("ab ", max_size=9)), max_size=40)


@settings(max_examples=100, deadline=None)
@given(TEXTS)
def test_batches_equal_single_pairs(pairs):
    a, b = [list(x) for x in zip(*pairs)] or ([], [])
    a, b = a + b, b + a
    assert sim.lcs_lengths(a, b).tolist() == [lcs(x, y) for x, y in zip(a, b)]
    assert all(abs(x - jaro(y, z)) < 1e-12 for x, y, z in zip(sim.jaro_winklers(a, b), a, b))


def sample(n, seed=1):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdé") for _ in range(draw.randint(1, 7)))
    pool = [word() for _ in range(12)]
    text = lambda: " ".join(draw.choice([word(), *pool]) for _ in range(draw.randint(0, 14)))
    out = [(text(), text()) for _ in range(n)]
    return out + [(x, x) for x, _ in out[:5]] + [("", ""), ("", "a"), ("opus one", "one opus napa"), ("martha", "marhta")]


def test_similarity_columns_equal_their_definition(spark):
    rows = [(i, *p) for i, p in enumerate(sample(300))] + [(-1, None, "a"), (-2, "a", None)]
    df = spark.createDataFrame(rows, "i int, a string, b string")
    a, b = F.col("a"), F.col("b")
    one = df.select("i", sim.indel_similarity(a, b), sim.token_sort_similarity(a, b), sim.token_set_similarity(a, b), sim.jaro_winkler(a, b))
    four = sim.pair_scores(df, "a", "b", "s").select("i", "s.ratio", "s.sort", "s.set", "s.jaro")
    for out in (one, four):
        got = {r[0]: tuple(r)[1:] for r in out.collect()}
        assert got.pop(-1)[0] is None and got.pop(-2)[0] is None
        for i, x, y in rows[:-2]:
            want = indel(x, y), token_sort(x, y), token_set(x, y), jaro(x, y)
            assert all(abs(g - w) < 1e-12 for g, w in zip(got[i], want)), (x, y, got[i], want)


def test_bounds_lie_above_the_scores(spark):
    rows = sample(500, 7)
    df = spark.createDataFrame(rows, "a string, b string").withColumns({"x": mt.shape(F.col("a")), "y": mt.shape(F.col("b"))})
    x, y = F.col("x"), F.col("y")
    df = df.withColumns({"m": mt.score_bounds(x["bag"], y["bag"], x["words"], y["words"]), "c": mt.common_letters(x["bag"], y["bag"])})
    rows = df.select("a", "b", "c", "m.*").collect()
    for r in rows:
        assert r["c"] >= lcs(r["a"], r["b"])
        for name, f in (("ratio", indel), ("sort", token_sort), ("set", token_set), ("jaro", jaro)):
            assert r[name] >= f(r["a"], r["b"]) - 1e-9, (name, r)
    assert sum(r["ratio"] < 0.8 for r in rows) > len(rows) / 4


def names(spark, n=150):
    draw = random.Random(3)
    words = "red cold hot large small anvil ring bolt gear plate house estate economy standard castle hill".split()
    rows = []
    for i in range(n):
        name, producer = " ".join(draw.sample(words, draw.randint(1, 4))), " ".join(draw.sample(words, 2))
        rows.append((f"w{i}", i, name, producer, draw.choice(["napa", "rioja", None]), "c", draw.choice(["merlot", ""]), draw.choice(["red", "white"]), [f"{producer} {name}"]))
    return spark.createDataFrame(rows, "id string, catalog_ordinal int, name string, producer string, region string, country string, varietal string, wine_type string, aliases array<string>")


def test_pruned_matches_equal_all_scored_matches(spark):
    index = mt.catalog_index(names(spark))
    texts = [f"{r['producer']}, {r['name']}" for r in names(spark, 40).collect()] + ["zzz", "house", "napa red 2015", "cold hous anvl"]
    items = parse_items(spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "item_id int, menu_text string, vintage int"))
    for gate in ("strict", "open"):
        got = {(r["item_id"], r["rank"]): (r["wine_id"], r["score"]) for r in mt.fuzzy_match(items, index, 3, gate, ["item_id"]).collect()}
        keyed = items.withColumn("_mk", mt.text_key(mt.match_key(items))).select("item_id", "_mk")
        profiles, members = mt.catalog_profiles(index, 1000)
        every = mt.match_scores(mt.query_profiles(items), profiles, gate).where("score >= 0.55").join(members, "profile_id")
        every = keyed.join(every.withColumn("_mk", mt.text_key(mt.KEY)).select("_mk", "wine_id", "score", "catalog_ordinal"), "_mk").collect()
        want = {}
        for item in {r["item_id"] for r in every}:
            best = sorted((-r["score"], r["catalog_ordinal"], r["wine_id"]) for r in every if r["item_id"] == item)[:3]
            want |= {(item, n + 1): (w, -s) for n, (s, _, w) in enumerate(best)}
        assert got == want and len(got) > 30


def test_profiles_of_one_text_are_cut_by_their_bonuses_before_they_meet_queries(spark):
    # 60 products of one name differ in region, grape and style; their order in the catalog is not that of their bonuses
    rows = [(f"w{i}", (i * 37) % 60, "red anvil", "castle house", ["napa", "rioja", "jura", "etna", ""][i % 5], "c", ["merlot", "syrah", ""][i % 3], ["red", "white"][i % 2], ["house anvil"]) for i in range(60)]
    index = mt.catalog_index(spark.createDataFrame(rows, names(spark, 1).schema))
    keys = [("red anvil", "castle house", r, v, t, y, True) for r in ("napa", None) for v in ("merlot", None) for t in ("red", None) for y in (True, False)]
    queries = spark.createDataFrame([(*k, ["red", "anvil"]) for k in keys], "q string, q_gate string, q_region string, q_varietal string, q_type string, q_year boolean, q_gated boolean, q_tokens array<string>")
    profiles, members = mt.catalog_profiles(index, 60)
    kinds = queries.select(mt.text_key(mt.KIND).alias("_kind"), *mt.KIND).distinct()
    met = kinds.crossJoin(profiles.select(mt.text_key(mt.P_TEXT).alias("_pt")).distinct())
    assert mt.leading_profiles(met, profiles, 3).groupBy("_kind").count().agg(F.max("count")).first()[0] < profiles.count() / 2
    got = {(r["_mk"], m["rank"]): (m["wine_id"], m["score"]) for r in mt.match_texts(queries, index, 3).collect() for m in r["matches"]}
    every = mt.match_scores(queries, profiles).join(members, "profile_id").select(mt.text_key(mt.KEY).alias("_mk"), "wine_id", "score", "catalog_ordinal").collect()
    want = {}
    for key in {r["_mk"] for r in every}:
        best = sorted((-r["score"], r["catalog_ordinal"], r["wine_id"]) for r in every if r["_mk"] == key)[:3]
        want |= {(key, n + 1): (w, -s) for n, (s, _, w) in enumerate(best)}
    assert got == want and len(got) == 3 * len(keys)


def test_products_of_one_text_are_normalized_once(spark, monkeypatch):
    # 90 products of 9 texts as given; those of one name differ in case only, so that 6 comparison texts are left
    rows = [(f"w{i}", (i * 37) % 90, ["Red Anvil", "RED ANVIL", "bolt"][i % 3], "castle house", ["napa", None, ""][i // 3 % 3], "c", "", "red", ["x"]) for i in range(90)]
    index = mt.catalog_index(spark.createDataFrame(rows, names(spark, 1).schema))
    groups = {}
    for r in index.withColumn("profile_id", mt.text_key(mt.PROFILE)).collect():
        groups.setdefault(r["profile_id"], []).append((r["catalog_ordinal"], r["id"]))
    counted, true = [], mt.catalog_index
    monkeypatch.setattr(mt, "catalog_index", lambda catalog: (counted.append(catalog.count()), true(catalog))[1])
    profiles, members = mt.catalog_profiles(index, 4)
    assert counted == [9] and "regexp_replace" not in members._jdf.queryExecution().optimizedPlan().toString()
    got = {r["profile_id"]: (r["first_ordinal"], r["products"]) for r in profiles.collect()}
    assert got == {k: (min(g)[0], len(g)) for k, g in groups.items()} and len(got) == 6
    assert {tuple(r) for r in members.collect()} == {(k, w, n) for k, g in groups.items() for n, w in sorted(g)[:4]}


def test_items_meet_only_the_results_of_their_texts(spark):
    index = mt.catalog_index(names(spark))
    texts = [f"{r['producer']}, {r['name']} 2015" for r in names(spark, 10).collect()] + ["zzz", None]
    items = spark.createDataFrame([(i, texts[i % 12], 2012 if i % 5 == 0 else None) for i in range(120)], "item_id int, menu_text string, given_vintage int")
    out = mt.match_items(items, index, 3)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "extract" not in plan.lower()  # texts are parsed once, not for each item
    parsed = parse_items(items).withColumn("vintage", F.coalesce("given_vintage", "parsed_vintage"))
    row = lambda r: (r["item_id"], r["rank"], r["wine_id"], r["score"])
    got = sorted(map(row, out.select("item_id", F.inline("matches")).collect()))
    assert got == sorted(map(row, mt.fuzzy_match(parsed, index, 3, item_cols=["item_id"]).collect())) and len(got) > 100


def test_alternatives_of_an_item_of_several_rows(spark):
    of = lambda *ids: [(n + 1, w, 0.9 - n / 10, "high") for n, w in enumerate(ids)]
    rows = spark.createDataFrame([(1, of("a", "b", "c")), (1, of("d", "e")), (2, of("f"))], "item_id int, matches array<struct<rank int, wine_id string, score double, confidence_level string>>")
    got = {r["item_id"]: (r["wine_id"], r["confidence"], r["alternatives"]) for r in mt.best_and_alternatives(rows, "item_id").collect()}
    assert got == {1: ("d", 0.9, ["b", "e", "c"]), 2: ("f", 0.9, [])}


def test_search_scores_few_and_finds_what_all_scored_give(spark, monkeypatch):
    index = mt.catalog_index(names(spark, 400))
    asked = ["red anvil castle", "qqq", "economy hill", "cold"]
    counted, true = [], mt.text_scores
    monkeypatch.setattr(mt, "text_scores", lambda pairs: (counted.append(pairs.count()), true(pairs))[1])
    got = {(r["query"], r["rank"]): (r["id"], r["score"]) for r in mt.search(index, asked, 5).collect()}
    queries = mt.search_profiles(spark.createDataFrame([(x,) for x in asked], "query string"))
    profiles, members = mt.catalog_profiles(index, 1000)
    pairs = queries.select(*mt.Q_TEXT).crossJoin(profiles.select(*mt.P_TEXT).distinct())
    every = mt.with_bonuses(mt.candidate_pairs(true(pairs), queries.drop("query"), profiles)).join(members, "profile_id").select("q", "wine_id", "score", "catalog_ordinal").collect()
    of = {r["q"]: r["query"] for r in queries.collect()}
    for q, query in of.items():
        best = sorted((-r["score"], r["catalog_ordinal"], r["wine_id"]) for r in every if r["q"] == q)[:5]
        assert [got[query, n + 1] for n in range(5)] == [(w, -s) for s, _, w in best], query
    assert len(got) == 20 and sum(counted) < 0.7 * pairs.count(), (counted, pairs.count())  # one text shares no token: it needs all


def test_gate_finds_every_pair_brute_force_finds(spark):
    base = ["chateau margaux", "patz hall", "domaine leroy", "opus one winery", "monte tondo estate vineyards", "josh cellars",
            "realm cellars", "bond", "e guigal", "chateau lafite rothschild pauillac", "harlan estate napa valley"]
    near = [b[:-1] for b in base] + [b + "s" for b in base] + [b.replace("a", "", 1) for b in base]
    extra = [b + " j" for b in base] + [" ".join(reversed(b.split())) for b in base] + [b + " grand vin" for b in base]
    q = sorted(set(base + near + extra))
    e = sorted(set(base + near))
    left = spark.createDataFrame([(x,) for x in q], "q_gate string")
    right = spark.createDataFrame([(x,) for x in e], "gate_text string")
    got = {(r["q_gate"], r["gate_text"]) for r in mt.producer_gate(left, right).collect()}
    want = {(a, b) for a, b in itertools.product(q, e) if token_set(a, b) >= 0.93}
    assert got == want


def test_join_keys_push_no_parsing_into_the_scan(spark):
    from pourscale.checks import registry

    registry.load()
    plan = registry.QUERIES["fuzzy_match_join"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") < 1000


def test_text_key_is_never_null(spark):
    from pourscale.operators.match import text_key

    df = spark.createDataFrame([(None, "a"), ("b", None)], "x string, y string").select(text_key(["x", "y"]).alias("k"))
    assert not df.schema["k"].nullable and df.distinct().count() == 2
