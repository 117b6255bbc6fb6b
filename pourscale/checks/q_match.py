"""Queries of similarity and matching."""

from pyspark.sql import functions as F

from pourscale import fixed_values as fv
from pourscale.checks import sql as s, views as v
from pourscale.checks.q_items import parsed
from pourscale.checks.registry import register
from pourscale.functions import similarity as sim, text as tx
from pourscale.functions.pricing import confidence_level
from pourscale.operators import match as mt
from pourscale.plans.analyze import pin_products
from pourscale.session import staged

V = s.VIEWS
QUERIES = ["Old Anvil", "Château Economy Blue Ring 2015", "promo estate hot", "standrd hous red widgt"]


def word_views(name: str, source: str) -> None:
    """View name_j: distinct (a, b) of source with their sorted words and the texts of their word sets."""
    srt = lambda c: f"array_to_string(list_sort(string_split({c}, ' ')), ' ')"
    V[f"{name}_w"] = ([source], f"""SELECT a, b, sa, sb, array_to_string(both_, ' ') AS common, array_to_string(list_filter(xa, lambda t: NOT list_contains(both_, t)), ' ') AS ra,
        array_to_string(list_filter(xb, lambda t: NOT list_contains(both_, t)), ' ') AS rb
      FROM (SELECT *, list_sort(list_intersect(xa, xb)) AS both_ FROM (SELECT a, b, {srt('a')} AS sa, {srt('b')} AS sb,
        list_sort(list_distinct(list_filter(string_split(a, ' '), lambda t: t <> ''))) AS xa, list_sort(list_distinct(list_filter(string_split(b, ' '), lambda t: t <> ''))) AS xb FROM {source}))""")
    V[f"{name}_j"] = ([f"{name}_w"], f"""SELECT *, trim(common || ' ' || ra) AS ja, trim(common || ' ' || rb) AS jb FROM {name}_w""")


_SET = """CASE WHEN ja = '' OR jb = '' THEN 0.0 WHEN common <> '' AND (ra = '' OR rb = '') THEN 1.0
        WHEN common <> '' THEN greatest(t3.sim, 2.0 * length(common) / (length(common) + length(ja)), 2.0 * length(common) / (length(common) + length(jb))) ELSE t3.sim END AS set_"""


def similarity_views(name: str, source: str) -> None:
    """Views name (with ratio, sort, set, jaro columns) over distinct (a, b) of source."""
    word_views(name, source)
    V[f"{name}_t"] = ([f"{name}_j"], f"""SELECT DISTINCT x, y, {s.indel('x', 'y')} AS sim FROM (SELECT a AS x, b AS y FROM {name}_j UNION SELECT sa, sb FROM {name}_j UNION SELECT ja, jb FROM {name}_j)""")
    V[name] = ([f"{name}_j", f"{name}_t"], f"""SELECT j.a, j.b, t1.sim AS ratio, t2.sim AS sort_, {_SET}, jaro_winkler_similarity(j.a, j.b) AS jaro
      FROM {name}_j j JOIN {name}_t t1 ON t1.x = j.a AND t1.y = j.b JOIN {name}_t t2 ON t2.x = sa AND t2.y = sb JOIN {name}_t t3 ON t3.x = ja AND t3.y = jb""")


similarity_views("psim", "pairs")
_AD = "greatest(ratio, sort_ * 0.95, set_ * 0.95)"


def six(c, name=None):
    """A number of zero or more in six decimals, as ``millionths`` in SQL."""
    whole = F.round((F.col(c) if isinstance(c, str) else c).cast("double") * 1_000_000_000).cast("bigint") + 500
    return ((whole - F.pmod(whole, F.lit(1000))) / 1000 / 1_000_000).alias(name or c)


def similarity_query(name, column, expr):
    register(name, s.q("psim", f"SELECT a, b, {s.millionths(expr)} AS sim FROM psim"))(
        lambda spark, sf: v.pairs(spark, sf).select("a", "b", six(column(F.col("a"), F.col("b")), "sim"))
    )


similarity_query("indel_similarity", sim.indel_similarity, "ratio")
similarity_query("token_sort_similarity", sim.token_sort_similarity, "sort_")
similarity_query("token_set_similarity", sim.token_set_similarity, "set_")
similarity_query("jaro_winkler", sim.jaro_winkler, "jaro")


@register("adaptive_similarity", s.q("psim", f"SELECT a, b, {s.millionths(_AD)} AS sim FROM psim"))
def _(spark, sf):
    return sim.pair_scores(v.pairs(spark, sf), "a", "b", "s").select("a", "b", six(sim.adaptive(F.col("s")), "sim"))

# ------------------------------------------------------------------ index views
V["idx"] = (["cat"], f"""SELECT *, {s.normalize('name')} AS n_name, {s.normalize('producer')} AS n_producer, {s.normalize('aliases[1]')} AS n_alias, {s.normalize_producer('producer')} AS gate_text,
    {s.normalize('region')} AS n_region, {s.normalize('varietal')} AS n_varietal FROM cat""")
V["prof"] = (["idx"], f"""SELECT *, {s.tokens("n_name || ' ' || n_alias")} AS tokens FROM (SELECT DISTINCT n_name, n_producer, n_alias, gate_text, n_region, n_varietal, wine_type FROM idx)""")
V["qs"] = (["parsed"], f"""SELECT *, {s.tokens('q')} AS q_tokens FROM (SELECT DISTINCT normalized_search AS q, {s.normalize_producer("coalesce(parsed_producer, '')")} AS q_gate, parsed_region AS q_region,
    parsed_varietal AS q_varietal, parsed_type AS q_type, coalesce(vintage BETWEEN 1950 AND 2030, false) AS q_year FROM parsed)""")
V["gpairs"] = (["qs", "prof"], "SELECT DISTINCT q_gate AS a, gate_text AS b FROM (SELECT DISTINCT q_gate FROM qs), (SELECT DISTINCT gate_text FROM prof)")
similarity_views("gsim", "gpairs")
V["passed"] = (["gsim"], "SELECT a AS q_gate, b AS gate_text FROM gsim WHERE set_ * 100 >= 93 AND a <> ''")
V["cands"] = (["qs", "prof", "passed"], "SELECT * FROM qs JOIN passed USING (q_gate) JOIN prof USING (gate_text) WHERE len(q_tokens) = 0 OR list_has_any(q_tokens, tokens)")


def _r(c):
    return f"{s.millionths(c)} AS {c}"


def scoring_views(prefix: str, cands: str) -> None:
    """prefix_scored: every candidate row with its scores and bonuses."""
    V[f"{prefix}_todo"] = ([cands], f"SELECT DISTINCT q AS a, n_name AS b FROM {cands} UNION SELECT q, n_producer FROM {cands} UNION SELECT q, n_alias FROM {cands}")
    similarity_views(f"{prefix}_sim", f"{prefix}_todo")
    V[f"{prefix}_regions"] = ([cands], f"SELECT DISTINCT q_region AS a, n_region AS b FROM {cands} WHERE q_region IS NOT NULL AND n_region <> ''")
    similarity_views(f"{prefix}_rsim", f"{prefix}_regions")
    V[f"{prefix}_base"] = ([cands, f"{prefix}_sim", f"{prefix}_rsim"], f"""
      SELECT c.*, n.sort_ * 0.35 + n.set_ * 0.30 + greatest(n.ratio, n.sort_ * 0.95, n.set_ * 0.95) * 0.25 + n.jaro * 0.10 AS name_score, p.sort_ * 0.6 + p.set_ * 0.4 AS producer_score, al.sort_ * 0.55 + al.set_ * 0.45 AS alias_score,
        CASE WHEN q_year THEN 0.04 ELSE 0 END AS vintage_bonus, CASE WHEN coalesce(r.set_, 0) >= 0.8 THEN 0.06 WHEN coalesce(r.set_, 0) >= 0.5 THEN 0.02 ELSE 0 END AS region_bonus,
        CASE WHEN n_varietal <> '' AND contains(n_varietal, q_varietal) THEN 0.03 ELSE 0 END AS varietal_bonus, CASE WHEN q_type = wine_type THEN 0.02 ELSE 0 END AS type_bonus
      FROM {cands} c JOIN {prefix}_sim n ON n.a = q AND n.b = n_name JOIN {prefix}_sim p ON p.a = q AND p.b = n_producer JOIN {prefix}_sim al ON al.a = q AND al.b = n_alias
        LEFT JOIN {prefix}_rsim r ON r.a = q_region AND r.b = n_region""")
    V[f"{prefix}_scored"] = ([f"{prefix}_base"], f"SELECT *, greatest(name_score, producer_score * 0.85, alias_score * 0.90) AS base_text, round(least(1.0, greatest(name_score, producer_score * 0.85, alias_score * 0.90) + CAST(vintage_bonus + region_bonus + varietal_bonus + type_bonus AS DOUBLE)), 9) AS score FROM {prefix}_base")


scoring_views("m", "cands")
_PARTS = "name_score, producer_score, alias_score, vintage_bonus, region_bonus, varietal_bonus, type_bonus"
_SHOWN = ["base_text", "score", *_PARTS.split(", ")]
_QKEY = "q, q_gate, q_region, q_varietal, q_type, q_year"
_PKEY = "n_name, n_producer, n_alias, gate_text, n_region, n_varietal, wine_type"
V["ranked"] = (["m_scored", "idx"], f"""
  SELECT {', '.join('s.' + c.strip() for c in _QKEY.split(','))}, idx.id AS wine_id, score, base_text, {_PARTS}, row_number() OVER (PARTITION BY {', '.join('s.' + c.strip() for c in _QKEY.split(','))} ORDER BY score DESC, catalog_ordinal) AS rank
  FROM m_scored s JOIN idx USING (n_name, n_producer, n_alias, gate_text, n_region, n_varietal, wine_type) WHERE score >= 0.55 QUALIFY rank <= 5""")
_SAME = " AND ".join(f"r.{c} IS NOT DISTINCT FROM p.{c}" for c in ("q_region", "q_varietal", "q_type"))
V["pk"] = (["parsed"], f"""SELECT *, normalized_search AS q, {s.normalize_producer("coalesce(parsed_producer, '')")} AS q_gate, coalesce(parsed_region, '-') AS kr, coalesce(parsed_varietal, '-') AS kv, coalesce(parsed_type, '-') AS kt,
    coalesce(vintage BETWEEN 1950 AND 2030, false) AS q_year FROM parsed""")
V["item_matches"] = (["pk", "ranked"], f"""SELECT item_id, p.menu_text, r.wine_id, r.score, r.rank, r.base_text, {', '.join('r.' + c.strip() for c in _PARTS.split(','))}, {s.level('r.score')} AS confidence_level FROM pk p JOIN (SELECT *, coalesce(q_region, '-') AS kr, coalesce(q_varietal, '-') AS kv, coalesce(q_type, '-') AS kt FROM ranked) r
    USING (q, q_gate, q_year, kr, kv, kt)""")


def index(spark, sf):
    return mt.catalog_index(v.cat(spark, sf))


def queries_(spark, sf):
    return mt.query_profiles(parsed(spark, sf))


def item_matches(spark, sf, shown=None):
    return mt.match_items(v.menu(spark, sf).select("item_id", "menu_text", "given_vintage"), index(spark, sf), shown=shown)


def matches(spark, sf, shown=None):
    return item_matches(spark, sf, shown).select("item_id", F.inline("matches"))


def scores(spark, sf):
    return mt.match_scores(queries_(spark, sf), mt.catalog_profiles(index(spark, sf), 5)[0])


def profiles(spark, sf):
    return mt.catalog_profiles(index(spark, sf), 5)[0].withColumn("n_alias", F.col("n_aliases")[0])


_PCOLS = ["n_name", "n_producer", "n_alias", "n_region", "n_varietal", "wine_type"]
_QCOLS = ["q", "q_gate", "q_year"]

# distinct names against distinct names: the blocking itself
V["qn"] = (["pairs"], f"SELECT a AS q, {s.tokens('a')} AS q_tokens FROM (SELECT DISTINCT a FROM pairs)")
V["pn"] = (["pairs"], f"SELECT b AS text, {s.tokens('b')} AS tokens FROM (SELECT DISTINCT b FROM pairs)")


@register("block_on_tokens", s.q("qn pn", "SELECT q, text FROM qn JOIN pn ON list_has_any(q_tokens, tokens)"))
def _(spark, sf):
    p = v.pairs(spark, sf)
    left = p.select(F.col("a").alias("q")).distinct().withColumn("q_tokens", tx.significant_tokens(F.col("q")))
    right = p.select(F.col("b").alias("text")).distinct().withColumn("tokens", tx.significant_tokens(F.col("text")))
    return mt.block_on_tokens(left, right).select("q", "text")


@register("producer_gate", s.q("passed", "SELECT q_gate, gate_text FROM passed"))
def _(spark, sf):
    return mt.producer_gate(queries_(spark, sf).where("q_gated"), profiles(spark, sf))


@register("match_score", s.q("m_scored", f"SELECT {', '.join(_QCOLS + _PCOLS)}, {', '.join(map(_r, ['name_score', 'producer_score', 'alias_score', 'base_text']))} FROM m_scored"))
def _(spark, sf):
    out = scores(spark, sf)
    sc = [six(c) for c in ("name_score", "producer_score", "alias_score", "base_text")]
    return out.withColumn("n_alias", F.col("n_aliases")[0]).select(*_QCOLS, *_PCOLS, *sc)


@register("structural_bonus", s.q("m_scored", f"SELECT {', '.join(_QCOLS + _PCOLS)}, CAST(vintage_bonus AS DOUBLE) AS vintage_bonus, CAST(region_bonus AS DOUBLE) AS region_bonus, CAST(varietal_bonus AS DOUBLE) AS varietal_bonus, CAST(type_bonus AS DOUBLE) AS type_bonus, {s.millionths('score')} AS score FROM m_scored"))
def _(spark, sf):
    out = scores(spark, sf)
    b = ["vintage_bonus", "region_bonus", "varietal_bonus", "type_bonus"]
    return out.withColumn("n_alias", F.col("n_aliases")[0]).select(*_QCOLS, *_PCOLS, *b, six("score"))


@register("score_breakdown", s.q("item_matches", f"SELECT item_id, rank, {', '.join(_r(c) for c in _SHOWN)} FROM item_matches"))
def _(spark, sf):
    shown = lambda m: F.struct(m["rank"].alias("rank"), *[six(m[c], c) for c in _SHOWN])
    return matches(spark, sf, shown).select("item_id", "rank", *_SHOWN)


@register("fuzzy_match_join", s.q("item_matches", f"SELECT item_id, wine_id, rank, {_r('score')} FROM item_matches"))
def _(spark, sf):
    return matches(spark, sf).select("item_id", "wine_id", "rank", six("score"))


@register("match_top_k", s.q("item_matches", f"SELECT item_id, max(CASE WHEN rank = 1 THEN wine_id END) AS wine_id, max(CASE WHEN rank = 1 THEN round(score, 4) END) AS confidence, {s.level('max(CASE WHEN rank = 1 THEN score END)')} AS confidence_level, coalesce(string_agg(CASE WHEN rank > 1 THEN wine_id END, '|' ORDER BY rank), '') AS alternatives FROM item_matches GROUP BY item_id"))
def _(spark, sf):
    out = mt.best_and_alternatives(item_matches(spark, sf), "item_id")
    return out.withColumn("alternatives", F.array_join("alternatives", "|"))


@register("array_nest_unnest", s.q("item_matches", "SELECT item_id, rank, wine_id FROM item_matches WHERE rank > 1"))
def _(spark, sf):
    per = mt.best_and_alternatives(item_matches(spark, sf), "item_id")
    return per.select("item_id", F.posexplode("alternatives").alias("p", "wine_id")).select("item_id", (F.col("p") + 2).alias("rank"), "wine_id")


@register("strong_match_filter", s.q("item_matches", "SELECT item_id, wine_id, rank FROM item_matches WHERE confidence_level IN ('very_high', 'high')"))
def _(spark, sf):
    return mt.strong_matches(matches(spark, sf)).select("item_id", "wine_id", "rank")


@register("confidence_level", s.q("item_matches", "SELECT confidence_level, count(*) AS n FROM item_matches GROUP BY 1"))
def _(spark, sf):
    m = matches(spark, sf)
    return m.groupBy(confidence_level(F.col("score")).alias("confidence_level")).agg(F.count(F.lit(1)).alias("n"))


V["al_pairs"] = (["cands"], "SELECT DISTINCT q AS a, n_alias AS b FROM cands")
word_views("al", "al_pairs")
V["al_t"] = (["al_j"], f"SELECT DISTINCT x, y, {s.indel('x', 'y')} AS sim FROM (SELECT sa AS x, sb AS y FROM al_j UNION SELECT ja, jb FROM al_j)")
V["al_sim"] = (["al_j", "al_t"], f"SELECT j.a, j.b, t2.sim AS sort_, {_SET} FROM al_j j JOIN al_t t2 ON t2.x = sa AND t2.y = sb JOIN al_t t3 ON t3.x = ja AND t3.y = jb")


@register("alias_best_join", s.q("al_sim", f"SELECT a AS q, b AS n_alias, {s.millionths('sort_ * 0.55 + set_ * 0.45')} AS alias_score FROM al_sim"))
def _(spark, sf):
    queries, profiles = staged(queries_(spark, sf), "alias-queries"), staged(mt.catalog_profiles(index(spark, sf), 5)[0], "alias-profiles")
    pairs = staged(mt.text_pairs(queries, profiles), "alias-pairs")
    return mt.alias_scores(pairs).select("q", F.col("n_aliases")[0].alias("n_alias"), six("alias_score"))


@register("pin_products", s.q("menu cat", "SELECT item_id, CASE WHEN id IS NOT NULL THEN id END AS wine_id FROM (SELECT item_id, CASE WHEN l_suppkey % 5 = 0 THEN 'p' || (l_partkey * 3) END AS pinned FROM menu) LEFT JOIN cat ON id = pinned"))
def _(spark, sf):
    pinned = F.when(F.col("l_suppkey") % 5 == 0, F.concat(F.lit("p"), (F.col("l_partkey") * 3).cast("string")))
    hit, rest = pin_products(v.menu(spark, sf).withColumn("pinned_id", pinned), v.cat(spark, sf))
    return hit.select("item_id", "wine_id").unionByName(rest.select("item_id", F.lit(None).cast("string").alias("wine_id")))


# ------------------------------------------------------------------ search
V["sq0"] = ([], "SELECT * FROM (VALUES " + ", ".join(f"({s.quote(x)})" for x in QUERIES) + ") t(menu_text)")
V["sq"] = (["sq0"], f"""SELECT menu_text AS query, q, {s.region('q')} AS q_region, {s.varietal('q')} AS q_varietal, {s.style('q')} AS q_type, regexp_matches(menu_text, '\\b(19[5-9]\\d|20[0-3]\\d)\\b') AS q_year
    FROM (SELECT menu_text, {s.normalize("regexp_replace(menu_text, '\\b(19[5-9]\\d|20[0-3]\\d)\\b', ' ')")} AS q FROM sq0)""")
V["scands"] = (["sq", "prof"], "SELECT * FROM sq, prof")
scoring_views("s", "scands")
V["found_"] = (["s_scored", "idx"], """SELECT query, idx.id, idx.name, idx.producer, idx.country, score, catalog_ordinal, wine_type FROM s_scored JOIN idx USING (n_name, n_producer, n_alias, gate_text, n_region, n_varietal, wine_type)""")


@register("search_cross_score", s.q("found_", f"SELECT query, id, {_r('score')}, row_number() OVER (PARTITION BY query ORDER BY found_.score DESC, catalog_ordinal) AS rank FROM found_ QUALIFY rank <= 10"))
def _(spark, sf):
    return mt.search(index(spark, sf), QUERIES, 10).select("query", "id", six("score"), "rank")


@register("filter_attr_equal", s.q("found_", f"SELECT query, id, {_r('score')}, row_number() OVER (PARTITION BY query ORDER BY found_.score DESC, catalog_ordinal) AS rank FROM found_ WHERE wine_type = 'red' AND country = 'NATION_3' QUALIFY rank <= 10"))
def _(spark, sf):
    return mt.search(index(spark, sf), QUERIES, 10, wine_type="red", country="nation 3").select("query", "id", six("score"), "rank")


_PLAIN = lambda c: f"lower(strip_accents({c}))"
_BOOST = (
    f"(CASE WHEN starts_with({_PLAIN('name')}, {_PLAIN('trim(query)')}) OR starts_with({_PLAIN('producer')}, {_PLAIN('trim(query)')}) THEN least(0.05 + length(query) * 0.02, 0.15) ELSE 0 END"
    " + CASE WHEN catalog_ordinal % 4 <> 0 THEN 0.2 WHEN length(trim(name)) < 4 THEN -0.3 ELSE 0 END)"
)
V["pool"] = (["found_"], "SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, catalog_ordinal) AS rank FROM found_ QUALIFY rank <= 40")
V["boosted"] = (["pool"], f"SELECT *, CAST({_BOOST} AS DOUBLE) AS boost, round(score + CAST({_BOOST} AS DOUBLE), 9) AS total FROM pool")


def pool(spark, sf):
    return mt.search(index(spark, sf), QUERIES, 40).withColumn("is_static", F.col("catalog_ordinal") % 4 != 0)


@register("autocomplete_boost", s.q("boosted", "SELECT query, id, round(boost, 6) AS boost FROM boosted"))
def _(spark, sf):
    b = mt.autocomplete_boost(F.col("query"), F.col("name"), F.col("producer"), F.col("is_static"))
    return pool(spark, sf).select("query", "id", F.round(b, 6).alias("boost"))


@register("search_rerank", s.q("boosted", f"""SELECT query, id, round(total, 4) AS match_score, row_number() OVER (PARTITION BY query ORDER BY total DESC, rank) AS position FROM (
    SELECT * FROM boosted QUALIFY row_number() OVER (PARTITION BY query, lower(name), {s.producer_key('producer')} ORDER BY total DESC, rank) = 1) QUALIFY position <= 10"""))
def _(spark, sf):
    return mt.search_rerank(pool(spark, sf), 10).select("query", "id", "match_score", "position")


# ------------------------------------------------------------------ listings
V["hits"] = (["cat", "offers"], """SELECT wine_id, l_orderkey * 100 + l_suppkey * 10 + l_linenumber AS card_no, CASE WHEN l_linenumber % 3 = 0 THEN 'Other Bottle' ELSE producer || ' ' || name END AS card_name, price, CASE WHEN l_linenumber % 4 > 0 THEN CAST(l_suppkey % 40 + 10 AS DOUBLE) / 10 END AS rating FROM offers JOIN cat ON id = wine_id""")


@register("card_pick_join", None)
def _(spark, sf):
    cat = v.cat(spark, sf)
    products = cat.select(F.col("id").alias("wine_id"), tx.key_words(F.col("name"), F.col("producer")).alias("key_words"), F.col("avg_retail_price").alias("reference_price"))
    n, k = F.col("l_linenumber"), F.col("l_suppkey")
    cards = v.offers(spark, sf).join(cat.select("id", "name", "producer"), F.col("id") == F.col("wine_id")).select(
        "wine_id", (F.col("l_orderkey") * 100 + k * 10 + n).alias("card_no"),
        F.when(n % 3 == 0, "Other Bottle").otherwise(F.concat_ws(" ", "producer", "name")).alias("card_name"),
        "price", F.when(n % 4 > 0, (k % 40 + 10).cast("double") / 10).alias("rating"),
    )
    return mt.card_pick(products, cards).select("wine_id", "card_no", "card_name", "price", "rating")


from pourscale.checks.q_text import key_words_sql  # noqa: E402

V["hits_ok"] = (["hits", "cat"], f"""SELECT h.* FROM hits h JOIN (SELECT id, avg_retail_price, {key_words_sql('name', 'producer')} AS kw FROM cat) c ON id = wine_id
    WHERE list_has_any(kw, regexp_extract_all(lower(strip_accents(card_name)), '[a-z]{{3,}}')) AND price > 0 AND CAST(price AS DOUBLE) / CAST(avg_retail_price AS DOUBLE) BETWEEN 0.04 AND 30.0""")
from pourscale.checks.registry import SQL  # noqa: E402

SQL["card_pick_join"] = s.q("hits_ok", "SELECT wine_id, card_no, card_name, price, rating FROM hits_ok QUALIFY row_number() OVER (PARTITION BY wine_id ORDER BY coalesce(rating, 0) DESC, card_no) = 1")

_LIST = lambda c: s.listing_text(c)
V["listing0"] = (["cat"], "SELECT a.id AS wine_id, a.producer, a.name, k AS phrase_rank, b.catalog_ordinal * 10 + 7 AS external_id, (2000 + b.catalog_ordinal % 20) || ' ' || b.producer || ' ' || b.name AS listing, b.catalog_ordinal AS ordinal FROM cat a, (VALUES (0), (1), (2)) v(k), cat b WHERE b.catalog_ordinal = a.catalog_ordinal + k * 7")
_TOK = lambda c: f"list_filter(list_distinct(list_filter(regexp_split_to_array({c}, ' +'), lambda t: t <> '')), lambda t: NOT list_contains({s.values(fv.LISTING_STOP_WORDS)}, t))"
V["listing1"] = (["listing0"], f"SELECT *, {_LIST('producer')} AS p, regexp_replace({_LIST('listing')}, '^\\d{{4}}\\s+', '') AS t, {_LIST('name')} AS nn FROM listing0")
V["listing2"] = (["listing1"], f"SELECT *, left(t, CAST(length(p) + 25 AS BIGINT)) AS head, list_distinct(list_concat({_TOK('p')}, {_TOK('nn')})) AS keys FROM listing1")
V["lpairs"] = (["listing2"], f"SELECT p, head, {s.indel('p', 'head')} AS sim FROM (SELECT DISTINCT p, head FROM listing2)")


@register("external_id_match", s.q("listing2 lpairs", """SELECT wine_id, external_id, phrase_rank, listing, score FROM (SELECT wine_id, external_id, phrase_rank, listing, ordinal,
    round(sim * 0.5 + CAST(len(list_filter(keys, lambda k: length(k) > 2 AND contains(t, k))) AS DOUBLE) / greatest(len(keys), 1) * 0.5, 6) AS score FROM listing2 JOIN lpairs USING (p, head)) WHERE score >= 0.35 QUALIFY row_number() OVER (PARTITION BY wine_id ORDER BY phrase_rank, score DESC, ordinal) = 1"""))
def _(spark, sf):
    cat = v.cat(spark, sf)
    a = cat.select(F.col("id").alias("wine_id"), "producer", "name", "catalog_ordinal").withColumn("phrase_rank", F.explode(F.array(*[F.lit(i) for i in range(3)])))
    a = a.withColumn("ordinal", F.col("catalog_ordinal") + F.col("phrase_rank") * 7).drop("catalog_ordinal")
    o = F.col("catalog_ordinal")
    b = cat.select(o.alias("ordinal"), (o * 10 + 7).alias("external_id"), F.concat_ws(" ", (2000 + o % 20).cast("string"), "producer", "name").alias("listing"))
    return mt.external_id_match(a.join(b, "ordinal"))
