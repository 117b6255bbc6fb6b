"""Entity matching of item texts to a catalog.

Work runs on distinct texts on both sides and is joined back to rows at the
end, so a text that fills a third of the input is scored once.  No step forms
all pairs of a group: candidates come from equi-joins on keys that a pair must
share to pass the producer gate and the token test.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from pourscale import fixed_values as fv
from pourscale.functions import similarity as sim
from pourscale.functions.items import override_vintage, parse_items
from pourscale.functions.pricing import confidence_level, is_strong
from pourscale.operators.skew import salted_join
from pourscale.session import staged
from pourscale.functions.text import (
    normalize_producer, normalize_text, producer_key, significant_tokens, strip_accents,
)

GATE = fv.GATE_MINIMUM / 100.0


# ------------------------------------------------------------------ index
def catalog_index(catalog: DataFrame) -> DataFrame:
    """Catalog with its comparison texts.  Worth writing once when reused."""
    aliases = F.coalesce(F.col("aliases"), F.array().cast("array<string>"))
    return (
        catalog.withColumns(
            {
                "n_name": normalize_text(F.col("name")),
                "n_producer": normalize_text(F.col("producer")),
                "n_aliases": F.transform(aliases, normalize_text),
                "gate_text": normalize_producer(F.col("producer")),
                "n_region": normalize_text(F.col("region")),
                "n_varietal": normalize_text(F.col("varietal")),
            }
        )
        .withColumn("tokens", significant_tokens(F.concat_ws(" ", F.col("n_name"), F.col("n_aliases"))))
    )


PROFILE = ["n_name", "n_producer", "n_aliases", "gate_text", "n_region", "n_varietal", "wine_type", "tokens"]


def text_key(columns: list) -> Column:
    """Digest of several columns as one short join key; nulls count as values.

    It is never null, so a join on it gives the optimizer no null test to push
    through the parsing of the texts below.
    """
    return F.coalesce(F.md5(F.to_json(F.struct(*columns))), F.lit(""))


#: What the comparison texts of a product are made of.
RAW = ["name", "producer", "aliases", "region", "varietal", "wine_type"]


def catalog_profiles(index: DataFrame, top_k: int) -> tuple[DataFrame, DataFrame]:
    """Distinct comparison texts, and the first ``top_k`` products of each.

    Products with equal texts score equally and rank by catalog order, so later
    ones of a text can never enter a result of ``top_k``.
    Texts are normalized once for each distinct text as given (``RAW``), not for each product.
    """
    alike = index.groupBy(*RAW).agg(F.min("catalog_ordinal").alias("first_ordinal"), F.count(F.lit(1)).alias("products"))
    texts = catalog_index(alike).withColumns({"_raw": text_key(RAW), "profile_id": text_key(PROFILE)})
    texts = staged(texts.select("_raw", "profile_id", *PROFILE, "first_ordinal", "products"), "catalog-texts")
    profiles = texts.groupBy("profile_id", *PROFILE).agg(F.min("first_ordinal").alias("first_ordinal"), F.sum("products").alias("products"))

    def first(rows: DataFrame, key: str) -> DataFrame:
        w = Window.partitionBy(key).orderBy("catalog_ordinal")
        return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top_k).drop("_r")

    members = first(index.select(text_key(RAW).alias("_raw"), F.col("id").alias("wine_id"), "catalog_ordinal"), "_raw")
    members = first(members.join(texts.select("_raw", "profile_id"), "_raw"), "profile_id")
    return profiles, members.select("profile_id", "wine_id", "catalog_ordinal")


def query_profiles(items: DataFrame) -> DataFrame:
    """Distinct query texts of parsed items (columns of ``parse_items`` plus ``vintage``)."""
    return (
        items.select(*match_key(items))
        .distinct()
        .withColumn("q_tokens", significant_tokens(F.col("q")))
    )


#: What of an item its match and price depend on, where the items have it.
GIVEN = ["menu_text", "given_vintage", "pinned_id"]


def given_columns(items: DataFrame) -> list[str]:
    return [c for c in GIVEN if c in items.columns]


def item_texts(items: DataFrame) -> DataFrame:
    """Distinct texts of unparsed items (menu_text, given_vintage [, pinned_id]), parsed and written once, with their key _tk."""
    given = given_columns(items)
    texts = parse_items(items.select(*given).distinct())
    texts = texts.withColumn("vintage", override_vintage(F.col("given_vintage"), F.col("parsed_vintage")))
    return staged(texts.withColumn("_tk", text_key(given)), "item-texts")


def join_texts(items: DataFrame, texts: DataFrame, how: str = "inner") -> DataFrame:
    """Items with the columns of their text (``item_texts``)."""
    given = given_columns(items)
    return items.withColumn("_tk", text_key(given)).join(texts.drop(*given), "_tk", how).drop("_tk")


def match_key(items: DataFrame) -> list[Column]:
    plausible = F.coalesce(F.col("vintage").between(1950, 2030), F.lit(False))
    return [
        F.col("normalized_search").alias("q"),
        normalize_producer(F.coalesce("parsed_producer", F.lit(""))).alias("q_gate"),
        F.col("parsed_region").alias("q_region"),
        F.col("parsed_varietal").alias("q_varietal"),
        F.col("parsed_type").alias("q_type"),
        plausible.alias("q_year"),
        (F.coalesce(F.col("parsed_producer"), F.lit("")) != "").alias("q_gated"),
    ]


KEY = ["q", "q_gate", "q_region", "q_varietal", "q_type", "q_year", "q_gated"]


# ------------------------------------------------------------------ blocking
def block_on_tokens(queries: DataFrame, profiles: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Pairs that share at least one significant token (and the columns ``on``), each pair once.

    A pair meets under every shared token; it is kept only under the smallest, so no distinct over pairs
    is needed. The rows of a frequent token are dealt out to many tasks.
    """
    left = queries.withColumn("_token", F.explode("q_tokens"))
    right = profiles.withColumn("_token", F.explode("tokens"))
    first = F.array_min(F.array_intersect("q_tokens", "tokens"))
    return salted_join(left, right, ["_token", *(on or [])], "q").where(F.col("_token") == first).drop("_token")


def _common_last(words: Column) -> Column:
    """Words from telling to common: listed common words last, longer words first."""
    common = F.array(*[F.lit(w) for w in fv.STOP_WORDS])
    rank = F.transform(
        words,
        lambda w: F.struct(F.array_contains(common, w).alias("c"), (-F.length(w)).alias("l"), w.alias("w")),
    )
    return F.transform(F.array_sort(rank), lambda s: s["w"])


def _grams(words: Column) -> Column:
    """Trigrams of the padded words; a repeated one is told apart by its number."""
    per_word = F.transform(
        words,
        lambda w: F.transform(
            F.sequence(F.lit(1), F.length(w)), lambda i: F.substring(F.concat(F.lit(" "), w, F.lit(" ")), i, F.lit(3))
        ),
    )
    flat = F.flatten(per_word)
    once = F.array_distinct(flat)
    repeats = F.size(flat) - F.size(once)
    numbered = F.flatten(
        F.transform(
            once,
            lambda g: F.transform(
                F.sequence(F.lit(1), F.size(F.filter(flat, lambda x: x == g))), lambda i: F.concat(g, i.cast("string"))
            ),
        )
    )
    return F.when(repeats == 0, F.transform(once, lambda g: F.concat(g, F.lit("1")))).otherwise(numbered)


def gate_keys(df: DataFrame, words: str, side: str) -> DataFrame:
    """Join keys that any pair passing the gate must share; one row per key.

    Three ways to reach 93 %, with T the summed length of both word lists:

    * one list lacks at most m words of the other, where the missing text is
      at most 0.1308 L - 1 characters long (L: own length), m = 0 for subsets.
      Then one of the m + 1 leading words of the smaller list occurs in the
      other.
    * the rests differ by d <= 0.07 T edits.  Each edit touches at most three
      trigrams, so the 3d + 1 leading trigrams (any fixed order) of both meet,
      and the lengths differ by at most d: tested on the pairs that meet.
    """
    w = F.col(words)
    text = F.array_join(w, " ")
    size = F.length(text)
    missing = F.greatest(F.lit(0), F.floor(size * 0.1308 / 2).cast("int"))
    lead = F.slice(_common_last(w), F.lit(1), missing + 1)
    edits = F.floor(size * 0.1506).cast("int")
    ordered = F.transform(
        F.array_sort(F.transform(F.col("_all_grams"), lambda g: F.struct(F.xxhash64(g).alias("h"), g.alias("g")))),
        lambda s: s["g"],
    )
    none = F.array().cast("array<string>")
    mine, other = ("Q:", "E:") if side == "q" else ("E:", "Q:")
    keys = F.concat(
        F.transform(lead, lambda x: F.concat(F.lit(mine), x)),
        F.transform(w, lambda x: F.concat(F.lit(other), x)),
        F.transform("_grams", lambda g: F.concat(F.lit("G:"), g)),
    )
    staged = (
        df.where(F.size(w) > 0)
        .withColumn("_all_grams", F.when(edits >= 1, _grams(w)).otherwise(none))
        .withColumn("_grams", F.slice(ordered, F.lit(1), edits * 3 + 1))
        .withColumns({f"_size_{side}": size, f"_edits_{side}": edits})
    )
    return staged.withColumn("_key", F.explode(keys)).drop("_all_grams", "_grams")


def gate_candidates(query_texts: DataFrame, catalog_texts: DataFrame) -> DataFrame:
    """(q_gate, gate_text) pairs that may pass the producer gate, with their bound."""
    q = gate_keys(query_texts.withColumn("_qw", sim.word_set(F.col("q_gate"))), "_qw", "q")
    e = gate_keys(catalog_texts.withColumn("_ew", sim.word_set(F.col("gate_text"))), "_ew", "e")
    near = ~F.startswith("_key", F.lit("G:")) | (F.abs(F.col("_size_q") - F.col("_size_e")) <= F.col("_edits_q"))
    met = q.join(e, "_key").where(near).select("q_gate", "gate_text", "_qw", "_ew").distinct()
    bound = sim.token_set_bound(F.col("_qw"), F.col("_ew"))
    return met.withColumn("_bound", bound).where(F.col("_bound") >= GATE).select("q_gate", "gate_text", "_bound")


def producer_gate(query_texts: DataFrame, catalog_texts: DataFrame) -> DataFrame:
    """Distinct producer text pairs with a token-set similarity of at least 93 %.

    Subset pairs are decided by word lists; only near-equal ones are scored.
    """
    pairs = gate_candidates(spread_out(query_texts.select("q_gate").distinct()), catalog_texts.select("gate_text").distinct())
    sure = pairs.where(F.col("_bound") > 1.0)
    open_ = pairs.where(F.col("_bound") <= 1.0).where(
        sim.token_set_similarity(F.col("q_gate"), F.col("gate_text")) >= GATE
    )
    return sure.unionByName(open_).select("q_gate", "gate_text")


#: What the text scores depend on, on either side.
Q_TEXT = ["q", "q_gate", "q_gated"]
P_TEXT = ["n_name", "n_producer", "n_aliases", "gate_text"]


def spread_out(df: DataFrame) -> DataFrame:
    """The rows dealt over all shuffle partitions: few short rows become many pairs, which adaptive coalescing by bytes
    would leave to one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def text_pairs(queries: DataFrame, profiles: DataFrame, gate: str = "strict") -> DataFrame:
    """Pairs of distinct query and product texts worth scoring (``Q_TEXT`` and ``P_TEXT``).

    queries and profiles are read several times and should be cheap to read (``staged``).
    """
    queries, profiles = queries.select(*Q_TEXT, "q_tokens").distinct(), profiles.select(*P_TEXT, "tokens").distinct()
    if gate != "strict":
        return open_candidates(queries, profiles).select(*Q_TEXT, *P_TEXT)
    # pairs share the producer text and a token; a text without tokens needs the producer text alone
    gated = staged(spread_out(queries.where("q_gated").join(producer_gate(queries.where("q_gated"), profiles), "q_gate")), "match-gated")
    some = block_on_tokens(gated.where(F.size("q_tokens") > 0), profiles, ["gate_text"])
    bare = gated.where(F.size("q_tokens") == 0).join(profiles, "gate_text")
    # a text without producer has no gate to pass
    free = open_candidates(queries.where(~F.col("q_gated")), profiles)
    return reduce(DataFrame.unionByName, (x.select(*Q_TEXT, *P_TEXT) for x in (some, bare, free)))


def candidate_pairs(pairs: DataFrame, queries: DataFrame, profiles: DataFrame) -> DataFrame:
    """Rows of queries and profiles whose texts are a pair, with the pair's further columns."""
    key = lambda df, columns, name: df.withColumn(name, text_key(columns))
    more = [c for c in pairs.columns if c not in Q_TEXT + P_TEXT]
    out = key(key(pairs, Q_TEXT, "_qt"), P_TEXT, "_pt").select("_qt", "_pt", *more)
    out = out.join(key(queries, Q_TEXT, "_qt").select("_qt", *KEY, "q_tokens"), "_qt")
    return out.join(key(profiles, P_TEXT, "_pt").select("_pt", "profile_id", "first_ordinal", *PROFILE), "_pt").drop("_qt", "_pt")


def open_candidates(queries: DataFrame, profiles: DataFrame) -> DataFrame:
    """Candidates without the gate: a shared significant token.

    Texts without such tokens are compared by any shared word, or by lengths
    within a factor of five; outside both no score reaches the minimum.
    """
    key = lambda kind, c: F.concat(F.lit(kind), c.cast("string"))
    words = lambda c: F.transform(F.split(c, " "), lambda w: key("W:", w))
    texts = F.concat(F.array("n_name", "n_producer"), F.col("n_aliases"))
    right_keys = F.concat(words(F.array_join(texts, " ")), F.transform(texts, lambda t: key("L:", F.length(t))))
    n = F.greatest(F.length("q"), F.lit(1))
    spread = F.transform(F.sequence(F.ceil(n / 5).cast("int"), (n * 5).cast("int")), lambda i: key("L:", i))
    left_keys = F.when(F.col("q") != "", F.concat(words(F.col("q")), spread))
    some = block_on_tokens(queries.where(F.size("q_tokens") > 0), profiles)
    left = queries.where(F.size("q_tokens") == 0).withColumn("_key", F.explode(F.array_distinct(left_keys)))
    right = profiles.withColumn("_key", F.explode(F.array_distinct(right_keys)))
    bare = left.join(right, "_key").select(*Q_TEXT, *P_TEXT).distinct()
    return some.select(*Q_TEXT, *P_TEXT).unionByName(bare)


# ------------------------------------------------------------------ scoring
def name_score(s: Column) -> Column:
    w = fv.NAME_WEIGHTS
    return s["sort"] * w["sort"] + s["set"] * w["set"] + sim.adaptive(s) * w["adaptive"] + s["jaro"] * w["jaro"]


def producer_score(s: Column) -> Column:
    return s["sort"] * fv.PRODUCER_WEIGHTS["sort"] + s["set"] * fv.PRODUCER_WEIGHTS["set"]


def alias_score(s: Column) -> Column:
    return s["sort"] * fv.ALIAS_WEIGHTS["sort"] + s["set"] * fv.ALIAS_WEIGHTS["set"]


def base_text_score() -> Column:
    return F.greatest(
        F.col("name_score"),
        F.col("producer_score") * fv.PRODUCER_WEIGHTS["share"],
        F.col("alias_score") * fv.ALIAS_WEIGHTS["share"],
    )


def vintage_bonus(year: Column) -> Column:
    return F.when(year, fv.BONUSES["vintage"]).otherwise(0.0)


def structural_bonus(region_score: Column, year: Column | None = None) -> dict[str, Column]:
    """Bonuses by name; zero when they do not apply."""
    b = fv.BONUSES
    r = F.coalesce(region_score, F.lit(0.0))
    return {
        "vintage_bonus": vintage_bonus(F.col("q_year") if year is None else year),
        "region_bonus": F.when(r >= 0.8, b["region"]).when(r >= 0.5, b["region_part"]).otherwise(0.0),
        "varietal_bonus": F.when(
            F.coalesce((F.col("n_varietal") != "") & F.contains("n_varietal", "q_varietal"), F.lit(False)), b["varietal"]
        ).otherwise(0.0),
        "type_bonus": F.when(F.coalesce(F.col("q_type") == F.col("wine_type"), F.lit(False)), b["type"]).otherwise(0.0),
    }


_BAG_LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789 "
#: How many of a letter a bag counts, and letters in a word of it.
_BAG_DEPTH, _BAG_WIDTH = 7, 9


def letter_bag(text: Column) -> Column:
    """How often each letter occurs, as bits: a letter that occurs n times has its first n of seven bits set.

    The common bits of two bags, and what the bags leave out, bound the letters that two texts can have in common.
    """
    letters, filled = F.array(*(F.lit(x) for x in _BAG_LETTERS)), F.array(*(F.lit((1 << n) - 1).cast("bigint") for n in range(_BAG_DEPTH + 1)))
    counts = F.transform(letters, lambda x: F.least(F.length(text) - F.length(F.replace(text, x, F.lit(""))), F.lit(_BAG_DEPTH)))
    zero = F.lit(0).cast("bigint")
    word = lambda at: F.aggregate(F.slice(counts, at + 1, _BAG_WIDTH), zero, lambda w, n: F.shiftleft(w, _BAG_DEPTH).bitwiseOR(F.element_at(filled, n + 1)))
    words = [word(at) for at in range(0, len(_BAG_LETTERS), _BAG_WIDTH)]
    kept = F.aggregate(counts, F.lit(0), lambda x, n: x + n)
    return F.struct(*(w.alias(f"w{i}") for i, w in enumerate(words)), (F.length(text) - kept).alias("rest"), F.length(text).alias("size"))


def common_letters(a: Column, b: Column) -> Column:
    """At least as many letters as two texts have in common, from their bags."""
    words = range(-(-len(_BAG_LETTERS) // _BAG_WIDTH))
    shared = reduce(lambda x, y: x + y, (F.bit_count(a[f"w{i}"].bitwiseAND(b[f"w{i}"])) for i in words))
    return F.least(shared + F.least(a["rest"], b["rest"]), a["size"], b["size"])


def score_bounds(a: Column, b: Column, wa: Column, wb: Column) -> Column:
    """Upper bounds of the four similarities of two texts, from their bags and word sets."""
    common, total = common_letters(a, b), F.greatest(a["size"] + b["size"], F.lit(1))
    empty = a["size"] + b["size"] == 0
    ratio = F.when(empty, 1.0).otherwise(F.least(F.lit(1.0), F.lit(2.0) * common / total))
    jaro = F.when(empty, 1.0).otherwise((common / F.greatest(a["size"], F.lit(1)) + common / F.greatest(b["size"], F.lit(1)) + 1) / 3)
    sets = F.least(F.lit(1.0), sim.token_set_bound(wa, wb, common))
    return F.struct(ratio.alias("ratio"), ratio.alias("sort"), sets.alias("set"), F.least(F.lit(1.0), jaro + 0.4 * (1 - jaro)).alias("jaro"))


MOST_BONUS = sum(fv.BONUSES[x] for x in ("vintage", "region", "varietal", "type"))


def shape(text: Column) -> Column:
    """What the bounds need of a text: its bag and its words."""
    return F.struct(letter_bag(text).alias("bag"), sim.word_set(text).alias("words"))


def most_text(q: Column, name: Column, producer: Column, aliases: Column) -> Column:
    """Upper bound of the text score from the shapes of the texts."""
    bounds = lambda texts: F.transform(texts, lambda t: score_bounds(q["bag"], t["bag"], q["words"], t["words"]))
    most = lambda texts, score: F.coalesce(F.array_max(F.transform(bounds(texts), score)), F.lit(0.0))
    return F.greatest(
        most(F.array(name), name_score),
        most(F.array(producer), producer_score) * fv.PRODUCER_WEIGHTS["share"],
        most(aliases, alias_score) * fv.ALIAS_WEIGHTS["share"],
    )


def shaped(texts: DataFrame) -> DataFrame:
    """Product texts with the shapes of their parts."""
    return texts.withColumns({"_sn": shape(F.col("n_name")), "_sp": shape(F.col("n_producer")), "_sa": F.transform("n_aliases", shape)})


def text_scores(pairs: DataFrame) -> DataFrame:
    """pairs with the scores of their texts: every pair of a query and a name, producer or alias is scored once."""
    texts = ["q", "n_name", "n_producer", "n_aliases"]
    keyed = pairs.withColumn("_tk", text_key(texts))
    part = lambda kind, t: F.struct(F.lit(kind).alias("kind"), t.alias("text"))
    parts = F.concat(F.array(part("n", F.col("n_name")), part("p", F.col("n_producer"))), F.transform("n_aliases", lambda x: part("a", x)))
    each = keyed.select("_tk", *texts).distinct().select("_tk", "q", F.inline(parts))
    # scoring is heavy for its bytes: a fixed number of partitions keeps adaptive coalescing from folding it into few tasks
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    scored = sim.pair_scores(each.select("q", "text").distinct().repartition(n, "q", "text"), "q", "text", "_s")
    s, kind = F.col("_s"), F.col("kind")
    best = lambda k, score: F.max(F.when(kind == k, score(s)))
    scores = each.join(scored, ["q", "text"]).groupBy("_tk").agg(
        best("n", name_score).alias("name_score"), best("p", producer_score).alias("producer_score"),
        F.coalesce(best("a", alias_score), F.lit(0.0)).alias("alias_score"),
    )
    return keyed.join(scores, "_tk").drop("_tk").withColumn("base_text", base_text_score())


def with_regions(pairs: DataFrame) -> DataFrame:
    """pairs with region_score, null without one of the regions; each pair of regions is compared once."""
    regions = pairs.where("q_region is not null and n_region <> ''").select("q_region", "n_region").distinct()
    a, b = F.col("q_region"), F.col("n_region")
    regions = regions.withColumn("region_score", F.when(a == b, F.when(a != "", 1.0).otherwise(0.0)).otherwise(sim.token_set_similarity(a, b)))
    return pairs.join(regions, ["q_region", "n_region"], "left")


def with_score(rows: DataFrame) -> DataFrame:
    bonus = F.col("vintage_bonus") + F.col("region_bonus") + F.col("varietal_bonus") + F.col("type_bonus")
    return rows.withColumn("score", F.round(F.least(F.lit(1.0), F.col("base_text") + bonus), 9))


def with_bonuses(pairs: DataFrame) -> DataFrame:
    """Scored candidate rows with their bonuses and score."""
    return with_score(with_regions(pairs).withColumns(structural_bonus(F.col("region_score"))))


def match_scores(queries: DataFrame, profiles: DataFrame, gate: str = "strict") -> DataFrame:
    """All candidate rows with their scores, bonuses and parts."""
    queries, profiles = staged(queries, "match-queries"), staged(profiles, "match-profiles")
    texts = staged(text_pairs(queries, profiles, gate), "match-pairs")
    return with_bonuses(candidate_pairs(text_scores(texts), queries, profiles))


def alias_scores(pairs: DataFrame) -> DataFrame:
    """Best alias score of each pair of texts (``text_pairs``): only the word scores of distinct (query, alias) pairs."""
    each = pairs.select("q", "n_aliases").distinct().select("q", "n_aliases", F.explode("n_aliases").alias("alias"))
    two = each.select("q", "alias").distinct()
    q, alias = F.col("q"), F.col("alias")
    s = {"sort": sim.token_sort_similarity(q, alias), "set": sim.token_set_similarity(q, alias)}
    two = two.withColumn("alias_score", alias_score(s))
    return each.join(two, ["q", "alias"]).groupBy("q", "n_aliases").agg(F.max("alias_score").alias("alias_score"))


def fuzzy_match(
    items: DataFrame, index: DataFrame, top_k: int = 5, gate: str = "strict", item_cols: list[str] | None = None
) -> DataFrame:
    """Best ``top_k`` products of each parsed item, one row per (item, rank)."""
    per_key = match_texts(query_profiles(items), index, top_k, gate)
    # join back by a digest of the text key: one short equi-key, null-safe
    keyed = items.withColumn("_mk", text_key(match_key(items)))
    cols = item_cols or [c for c in items.columns]
    return keyed.join(per_key.select("_mk", "matches"), "_mk").select(
        *cols, F.inline("matches")
    )


def match_items(
    items: DataFrame, index: DataFrame, top_k: int = 5, gate: str = "strict", shown: Callable[[Column], Column] | None = None
) -> DataFrame:
    """Unparsed items (``item_texts``) that have matches, with their best ``top_k`` products as the array ``matches``.

    All but one join runs on the distinct texts: what an item costs is the digest of its text and a row of that join.
    ``shown`` makes what is shown of each product; it too is made once for a text.
    """
    texts = item_texts(items)
    per_key = match_texts(query_profiles(texts), index, top_k, gate)
    if shown:
        per_key = per_key.withColumn("matches", F.transform("matches", shown))
    found = texts.select("_tk", text_key(match_key(texts)).alias("_mk")).join(per_key, "_mk").drop("_mk")
    return join_texts(items, found)


def match_texts(queries: DataFrame, index: DataFrame, top_k: int = 5, gate: str = "strict") -> DataFrame:
    """One row per distinct query text with its ranked products as an array."""
    profiles, members = catalog_profiles(index, top_k)
    queries, profiles = staged(queries, "match-queries"), staged(profiles, "match-profiles")
    pairs = staged(spread_out(text_pairs(queries, profiles, gate)), "match-pairs")
    texts = staged(text_scores(pairs), "match-texts")
    scored = leading_rows(leading_pairs(texts, profiles, top_k), queries, profiles, top_k).where(F.col("score") >= fv.MATCH_MINIMUM)
    # cut to the best texts first: each better text holds at least one better product
    best = Window.partitionBy("_mk").orderBy(F.desc("score"), "first_ordinal")
    ranked = scored.withColumn("_d", F.row_number().over(best)).where(F.col("_d") <= top_k)
    parts = ["_mk", "score", "base_text", "name_score", "producer_score", "alias_score",
             "vintage_bonus", "region_bonus", "varietal_bonus", "type_bonus", "profile_id"]
    w = Window.partitionBy("_mk").orderBy(F.desc("score"), "catalog_ordinal")
    top = (
        ranked.select(*parts)
        .join(members, "profile_id")
        .withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= top_k)
        .withColumn("confidence_level", confidence_level(F.col("score")))
    )
    row = F.struct("rank", "wine_id", "score", "confidence_level", "base_text", "name_score", "producer_score",
                   "alias_score", "vintage_bonus", "region_bonus", "varietal_bonus", "type_bonus")
    return top.groupBy("_mk").agg(F.sort_array(F.collect_list(row)).alias("matches"))


def leading_pairs(scored: DataFrame, profiles: DataFrame, top_k: int) -> DataFrame:
    """Scored text pairs that may hold one of a query's ``top_k`` products.

    A query's best texts that hold ``top_k`` products together give a floor, the lowest score of their texts: as
    many products score at least as much, and what lies further below it than all bonuses together can't be among them.
    """
    held = profiles.groupBy(text_key(P_TEXT).alias("_pt")).agg(F.sum("products").alias("_held"))
    w = Window.partitionBy(*Q_TEXT).orderBy(F.desc("base_text"))
    many = scored.select(*Q_TEXT, "base_text", text_key(P_TEXT).alias("_pt")).join(held, "_pt")
    many = many.withColumn("_n", F.sum("_held").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    floor = many.where(F.col("_n") >= top_k).groupBy(*Q_TEXT).agg(F.max("base_text").alias("_floor"))
    floor = floor.withColumn("_floor", F.greatest(F.lit(fv.MATCH_MINIMUM), "_floor") - MOST_BONUS - 1e-6)
    least = F.coalesce("_floor", F.lit(fv.MATCH_MINIMUM - MOST_BONUS - 1e-6))
    return scored.join(floor, Q_TEXT, "left").where(F.col("base_text") >= least).drop("_floor")


#: What of a query the bonuses depend on beside its year.
KIND = ["q_region", "q_varietal", "q_type"]
_BONUS = ["region_bonus", "varietal_bonus", "type_bonus"]


def leading_profiles(met: DataFrame, profiles: DataFrame, top_k: int) -> DataFrame:
    """Of the profiles of a product text (_pt), those that may be among the ``top_k`` of a query of a kind (_kind, ``KIND``).

    Profiles of one text differ in their bonuses only. One that ``top_k`` others precede in catalog order, each with
    the same bonuses or a larger sum of them, can't be among the first ``top_k``, whatever the text scores.
    """
    own = profiles.select(text_key(P_TEXT).alias("_pt"), "profile_id", "first_ordinal", "n_region", "n_varietal", "wine_type")
    rows = with_regions(met.join(own, "_pt"))
    rows = rows.withColumns({k: c for k, c in structural_bonus(F.col("region_score"), F.lit(False)).items() if k in _BONUS})
    same = Window.partitionBy("_pt", "_kind", *_BONUS).orderBy("first_ordinal", "profile_id")
    rows = rows.withColumn("_n", F.row_number().over(same)).where(F.col("_n") <= top_k)
    # at most top_k rows of each combination of bonuses are left
    total = F.round((F.col("region_bonus") + F.col("varietal_bonus") + F.col("type_bonus")) * 1e6).cast("bigint")
    before = Window.partitionBy("_pt", "_kind").orderBy("first_ordinal", "profile_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_sum", total).withColumn("_sums", F.collect_list("_sum").over(before))
    better = F.size(F.filter("_sums", lambda x: x > F.col("_sum")))
    return rows.where(better + F.col("_n") <= top_k).select("_pt", "_kind", "profile_id", "first_ordinal", *_BONUS)


def leading_rows(pairs: DataFrame, queries: DataFrame, profiles: DataFrame, top_k: int) -> DataFrame:
    """Scored rows of query keys (_mk) and ``leading_profiles`` for scored text pairs."""
    scores = ["name_score", "producer_score", "alias_score", "base_text"]
    left = pairs.select(text_key(Q_TEXT).alias("_qt"), text_key(P_TEXT).alias("_pt"), *scores)
    asked = queries.select(text_key(Q_TEXT).alias("_qt"), text_key(KEY).alias("_mk"), text_key(KIND).alias("_kind"), *KIND, "q_year")
    rows = staged(spread_out(left.join(asked, "_qt").drop("_qt")), "match-rows")
    best = leading_profiles(rows.select("_pt", "_kind", *KIND).distinct(), profiles, top_k)
    out = rows.drop(*KIND).join(best, ["_pt", "_kind"]).withColumn("vintage_bonus", vintage_bonus(F.col("q_year")))
    return with_score(out).drop("_pt", "_kind", "q_year")


def best_and_alternatives(matches: DataFrame, item: str) -> DataFrame:
    """First match per item with the others as an array (at most top_k - 1 entries of each row of the item).

    ``matches``: rows of an item with the array ``matches``, as ``match_items`` gives them. An item is one group
    of its few rows, not of all its products.
    """
    first, rest = F.col("matches")[0], F.slice("matches", 2, F.greatest(F.size("matches") - 1, F.lit(0)))
    alt = F.transform(rest, lambda m: F.struct(m["rank"].alias("rank"), m["wine_id"].alias("wine_id"), F.round(m["score"], 4).alias("confidence")))
    rows = matches.select(
        item, first["wine_id"].alias("wine_id"), F.round(first["score"], 4).alias("confidence"),
        first["confidence_level"].alias("confidence_level"), alt.alias("alternatives"),
    )
    return rows.groupBy(item).agg(
        F.max("wine_id").alias("wine_id"), F.max("confidence").alias("confidence"), F.max("confidence_level").alias("confidence_level"),
        F.transform(F.sort_array(F.flatten(F.collect_list("alternatives"))), lambda a: a["wine_id"]).alias("alternatives"),
    )


def strong_matches(matches: DataFrame) -> DataFrame:
    return matches.where(is_strong(F.col("confidence_level")))


# ------------------------------------------------------------------ search
def search_profiles(queries: DataFrame) -> DataFrame:
    """Search texts (column query) with their comparison columns."""
    return parse_items(queries, "query").select(
        "query", F.col("normalized_search").alias("q"), F.lit("").alias("q_gate"), F.col("parsed_region").alias("q_region"),
        F.col("parsed_varietal").alias("q_varietal"), F.col("parsed_type").alias("q_type"),
        F.coalesce(F.col("parsed_vintage").between(1950, 2030), F.lit(False)).alias("q_year"), F.lit(False).alias("q_gated"),
        significant_tokens(F.col("normalized_search")).alias("q_tokens"),
    )


def search(
    index: DataFrame, queries: DataFrame | list[str], limit: int = 10, wine_type: str | None = None, country: str | None = None
) -> DataFrame:
    """The ``limit`` best products of every search text (column query), however low they score.

    Filters run before scoring. Products that share a token with a text are scored first; the limit-th best of them
    is a floor. Of all others only those whose bounds reach the floor are scored at all.
    """
    if wine_type:
        index = index.where(F.col("wine_type") == wine_type)
    if country:
        index = index.where(normalize_text(F.col("country")) == normalize_text(F.lit(country)))
    if not isinstance(queries, DataFrame):
        queries = index.sparkSession.createDataFrame([(x,) for x in queries], "query string")
    asked = search_profiles(queries.select("query").distinct())
    profiles, members = catalog_profiles(index, limit)
    asked, profiles = staged(asked, "search-texts"), staged(profiles, "search-profiles")
    texts, of_q = profiles.select(*P_TEXT, "tokens").distinct(), asked.select(*Q_TEXT, "q_tokens").distinct()
    near = staged(text_scores(block_on_tokens(of_q, texts).select(*Q_TEXT, *P_TEXT)), "search-near")
    w = Window.partitionBy(*Q_TEXT).orderBy(F.desc("base_text"))
    floor = near.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == limit).select(*Q_TEXT, F.col("base_text").alias("_floor"))
    far = open_texts(of_q.join(floor, Q_TEXT, "left"), texts)
    scored = near.unionByName(text_scores(staged(far, "search-far")))
    rows = with_bonuses(candidate_pairs(scored, asked.drop("query").distinct(), profiles))
    found = rows.withColumn("_mk", text_key(KEY)).withColumn("_n", F.row_number().over(Window.partitionBy("_mk").orderBy(F.desc("score"), "first_ordinal"))).where(F.col("_n") <= limit)
    found = found.drop(*KEY, "q_tokens", "_n").join(members, "profile_id").withColumn("rank", F.row_number().over(Window.partitionBy("_mk").orderBy(F.desc("score"), "catalog_ordinal")))
    found = found.where(F.col("rank") <= limit).select("_mk", "wine_id", "score", "rank")
    found = asked.withColumn("_mk", text_key(KEY)).select("query", "_mk").join(found, "_mk").drop("_mk")
    return index.join(found, F.col("id") == F.col("wine_id")).drop("wine_id")


def open_texts(asked: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs without a shared token whose bounds reach the text's ``_floor`` (null: none) less all bonuses.

    Search texts are what callers ask for at a time, not a table that grows with the catalog: they meet all
    product texts in blocks of at most a thousand texts, and only numbers are compared.
    """
    asked, texts = asked.withColumn("_sq", shape(F.col("q"))), shaped(texts)
    n = asked.count()
    block, blocks = F.pmod(F.xxhash64("q"), F.lit(max(1, -(-n // 500)))), max(1, -(-n // 500))
    both = [texts.join(F.broadcast(asked.where(block == at)), ~F.arrays_overlap("q_tokens", "tokens")) for at in range(blocks)]
    both = reduce(DataFrame.unionByName, both)
    most = most_text(*(F.col(c) for c in ("_sq", "_sn", "_sp", "_sa")))
    return both.where(F.col("_floor").isNull() | (most + MOST_BONUS >= F.col("_floor") - 1e-6)).select(*Q_TEXT, *P_TEXT)


def autocomplete_boost(query: Column, name: Column, producer: Column, is_static: Column) -> Column:
    """Prefix hit, curated product and very short name adjustments."""
    q = F.lower(strip_accents(F.trim(query)))
    plain = lambda c: F.lower(strip_accents(c))
    hit = F.startswith(plain(name), q) | F.startswith(plain(producer), q)
    prefix = F.when(hit, F.least(F.lit(0.05) + F.length(q) * 0.02, F.lit(0.15))).otherwise(0.0)
    extra = F.when(is_static, 0.20).when(F.length(F.trim(name)) < 4, -0.30).otherwise(0.0)
    return prefix + extra


def search_rerank(pool: DataFrame, limit: int = 10) -> DataFrame:
    """Boost, drop repeats of (name, producer key), keep the best ``limit`` per query.

    ``pool`` holds the first 4 x limit rows per query of ``search``.
    """
    boost = autocomplete_boost(F.col("query"), F.col("name"), F.col("producer"), F.col("is_static"))
    boosted = pool.withColumn("_s0", F.round(F.col("score") + boost, 9)).withColumn("match_score", F.round("_s0", 4))
    order = [F.desc("_s0"), F.asc("rank")]
    same = Window.partitionBy("query", F.lower("name"), producer_key(F.col("producer"))).orderBy(*order)
    once = boosted.withColumn("_s", F.row_number().over(same)).where("_s = 1").drop("_s")
    w = Window.partitionBy("query").orderBy(*order)
    return once.withColumn("position", F.row_number().over(w)).where(F.col("position") <= limit).drop("_s0")


# ------------------------------------------------------------------ listings
def card_pick(products: DataFrame, cards: DataFrame) -> DataFrame:
    """Best result card of each product.

    ``products``: wine_id, key_words, reference_price; ``cards``: wine_id,
    card_no, card_name, price, rating.  A card must share a key word (when the
    product has any) and its price must be plausible; the best rated one wins,
    the earlier card on ties.
    """
    from pourscale.functions.text import plain_words
    from pourscale.operators.offers import ratio_within

    joined = cards.join(products, "wine_id")
    ok = (F.size("key_words") == 0) | F.arrays_overlap("key_words", plain_words(F.col("card_name")))
    good = joined.where(ok & (F.col("price") > 0)).where(
        ratio_within(F.col("price"), F.col("reference_price"), fv.CARD_RATIO_BOUNDS)
    )
    # without key words the first plausible card wins, else the best rated
    rating = F.when(F.size("key_words") == 0, 0.0).otherwise(F.coalesce("rating", F.lit(0.0)))
    w = Window.partitionBy("wine_id").orderBy(F.desc(rating), "card_no")
    return good.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def external_id_match(candidates: DataFrame) -> DataFrame:
    """External id per product from listings found by a cascade of phrases.

    ``candidates``: wine_id, producer, name, phrase_rank, external_id, listing,
    ordinal.  Score = half the producer's similarity to the head of the listing
    plus half the share of telling words found; the first phrase whose best
    listing reaches 0.35 gives the id.
    """
    from pourscale.functions.text import listing_text

    stop = F.array(*[F.lit(w) for w in fv.LISTING_STOP_WORDS])
    tokens = lambda c: F.array_except(F.array_distinct(F.filter(F.split(c, " +"), lambda t: t != "")), stop)
    out = (
        candidates.withColumn("_p", listing_text(F.col("producer")))
        .withColumn("_t", F.regexp_replace(listing_text(F.col("listing")), r"^\d{4}\s+", ""))
        .withColumn("_head", F.substring(F.col("_t"), F.lit(1), F.length("_p") + 25))
        .withColumn("_keys", F.array_union(tokens(F.col("_p")), tokens(listing_text(F.col("name")))))
    )
    pairs = out.select("_p", "_head").distinct()
    ratios = pairs.withColumn("_ratio", sim.indel_similarity(F.col("_p"), F.col("_head")))
    hits = F.size(F.filter("_keys", lambda t: (F.length(t) > 2) & F.contains(F.col("_t"), t)))
    score = F.col("_ratio") * 0.5 + hits / F.greatest(F.size("_keys"), F.lit(1)) * 0.5
    scored = out.join(ratios, ["_p", "_head"]).withColumn("score", F.round(score, 6)).where("score >= 0.35")
    w = Window.partitionBy("wine_id").orderBy("phrase_rank", F.desc("score"), "ordinal")
    return (
        scored.withColumn("_r", F.row_number().over(w))
        .where("_r = 1")
        .select("wine_id", "external_id", "phrase_rank", "listing", "score")
    )
