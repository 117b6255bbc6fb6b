"""Queries of fallback estimates, price choice and the whole analysis."""

from pyspark.sql import functions as F

from pourscale.checks import sql as s, views as v
from pourscale.checks.q_items import parsed
from pourscale.checks.q_match import index
from pourscale.checks.q_offers import merged, products
from pourscale.checks.registry import register
from pourscale.functions import text as tx
from pourscale.operators import estimates as es
from pourscale.operators.offers import filter_price_band, merge_sources_by_year
from pourscale.plans import analyze as an
from pourscale.sources import lookups as lk

V = s.VIEWS


def lookups(spark):
    return {
        "reference": lk.sample_reference(spark), "varietals": lk.sample_varietals(spark),
        "premiums": lk.sample_premiums(spark), "hints": lk.sample_hints(spark),
    }


V["keyed_menu"] = (["menu"], f"SELECT item_id, {s.lookup_key('menu_text')} AS k FROM menu")


def keyed_menu(spark, sf):
    return v.menu(spark, sf).select("item_id", tx.lookup_key(F.col("menu_text")).alias("k"))


@register("longest_key_join", s.q("keyed_menu reference", "SELECT item_id, key, mid FROM keyed_menu LEFT JOIN reference ON contains(k, key) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY length(key) DESC, ordinal) = 1"))
def _(spark, sf):
    return es.longest_key_join(keyed_menu(spark, sf), "k", lk.sample_reference(spark)).select("item_id", "reference.key", "reference.mid")


@register("premium_join", s.q("keyed_menu premiums", "SELECT item_id, key, multiplier FROM keyed_menu LEFT JOIN (SELECT * FROM premiums WHERE multiplier > 1) ON contains(k, key) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY multiplier DESC, ordinal) = 1"))
def _(spark, sf):
    return es.premium_join(keyed_menu(spark, sf), "k", lk.sample_premiums(spark)).select("item_id", "premium.key", "premium.multiplier")


@register("hint_join", s.q("keyed_menu hints", "SELECT item_id, implied FROM keyed_menu LEFT JOIN hints ON contains(k, key) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY ordinal) = 1"))
def _(spark, sf):
    return es.hint_join(keyed_menu(spark, sf), "k", lk.sample_hints(spark)).select("item_id", "hint.implied")


@register("apply_premium", s.q("keyed_menu premiums offers", "SELECT wine_id, l_orderkey, l_linenumber, l_suppkey, round_even(CAST(price AS DOUBLE) * k, 0) AS avg_retail, round_even(CAST(price AS DOUBLE) * k * 0.6, 0) AS min_retail, round_even(CAST(price AS DOUBLE) * k * 1.5, 0) AS max_retail FROM (SELECT *, CAST(1 + l_suppkey % 5 AS DOUBLE) AS k FROM offers)"))
def _(spark, sf):
    from pourscale.functions.pricing import apply_premium

    p, k = F.col("price").cast("double"), (1 + F.col("l_suppkey") % 5).cast("double")
    return v.offers(spark, sf).select("wine_id", "l_orderkey", "l_linenumber", "l_suppkey", *[c.alias(n) for n, c in apply_premium(p, p, p, k).items()])


# ------------------------------------------------------------------ regional estimate
V["est0"] = (["parsed"], f"""SELECT item_id, parsed_type, coalesce(parsed_region, '') AS rg, coalesce(parsed_varietal, '') AS gr, {s.lookup_key(s.expand_terms('menu_text'))} AS raw, {s.lookup_key('menu_text')} AS plain FROM parsed""")
V["est1"] = (["est0", "hints"], "SELECT e.*, implied, trim(concat_ws(' ', nullif(trim(rg || ' ' || gr), ''), raw, implied)) AS txt FROM est0 e LEFT JOIN hints ON contains(raw, key) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY ordinal) = 1")
V["est2"] = (["est1", "reference"], "SELECT e.*, r.key AS ck, r.low AS cl, r.mid AS cm, r.high AS ch FROM est1 e LEFT JOIN reference r ON contains(txt, key) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY length(key) DESC, r.ordinal) = 1")
V["est3"] = (["est2", "reference", "varietals"], """SELECT e.*, CASE WHEN a.key IS NOT NULL THEN 'exact_0' WHEN b.key IS NOT NULL THEN 'exact_1' WHEN c.key IS NOT NULL THEN 'exact_2' WHEN d.key IS NOT NULL THEN 'exact_3' WHEN ck IS NOT NULL THEN 'contained' WHEN w.key IS NOT NULL THEN 'varietal' END AS stage,
    coalesce(a.mid, b.mid, c.mid, d.mid, cm, w.mid) AS mid, coalesce(a.low, b.low, c.low, d.low, cl, w.low) AS low, coalesce(a.high, b.high, c.high, d.high, ch, w.high) AS high
  FROM est2 e LEFT JOIN reference a ON a.key = rg LEFT JOIN reference b ON b.key = gr LEFT JOIN reference c ON c.key = rg || ' ' || gr AND rg <> '' AND gr <> '' LEFT JOIN reference d ON d.key = 'champagne' AND parsed_type = 'sparkling' LEFT JOIN varietals w ON w.key = gr""")
V["est4"] = (["est3", "premiums"], "SELECT e.*, multiplier AS k FROM est3 e LEFT JOIN (SELECT * FROM premiums WHERE multiplier > 1) p ON contains(plain, key) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY multiplier DESC, ordinal) = 1")
V["est"] = (["est4"], f"""SELECT item_id, stage, est_avg, est_min, est_max, CASE WHEN stage IS NOT NULL THEN CASE WHEN k IS NOT NULL THEN 'producer_adjusted_estimate' WHEN stage = 'varietal' THEN 'varietal_proxy' ELSE 'regional_proxy' END END AS est_source,
    {s.tier('est_avg')} AS est_tier, {s.wholesale('est_avg', '(' + s.tier('est_avg') + ')')} AS est_wholesale FROM (
    SELECT *, CASE WHEN stage IS NOT NULL THEN CASE WHEN k IS NULL THEN mid ELSE round_even(mid * k, 0) END END AS est_avg, CASE WHEN stage IS NOT NULL THEN CASE WHEN k IS NULL THEN low ELSE round_even(low * k * 0.6, 0) END END AS est_min,
      CASE WHEN stage IS NOT NULL THEN CASE WHEN k IS NULL THEN high ELSE round_even(high * k * 1.5, 0) END END AS est_max FROM est4)""")


@register("regional_estimate", s.q("est", "SELECT item_id, stage, est_avg, est_min, est_max, est_source, est_tier, est_wholesale FROM est"))
def _(spark, sf):
    out = es.regional_estimate(parsed(spark, sf), **lookups(spark))
    return out.select("item_id", "stage", "est_avg", "est_min", "est_max", "est_source", "est_tier", "est_wholesale")


# ------------------------------------------------------------------ price choice on prepared rows
V["choice"] = (["offers", "cat"], f"""SELECT wine_id, l_orderkey, l_linenumber, l_suppkey, l_linenumber % 4 > 0 AS strong, name, CASE WHEN l_suppkey % 3 > 0 THEN price END AS mk_avg, CASE WHEN l_suppkey % 5 > 0 THEN avg_retail_price END AS cat_price, price_tier AS cat_tier,
    CASE WHEN l_suppkey % 2 = 0 THEN price END AS live_avg FROM offers JOIN cat ON id = wine_id""")
_MK, _CA = "strong AND mk_avg IS NOT NULL", "strong AND cat_price > 0"
_LI, _ES = "NOT strong AND live_avg IS NOT NULL", "NOT strong"


def choice(spark, sf):
    k, n = F.col("l_suppkey"), F.col("l_linenumber")
    c = v.cat(spark, sf).select("id", F.col("name").alias("cat_name"), "avg_retail_price", F.col("price_tier").alias("cat_tier"))
    d = v.offers(spark, sf).join(c, F.col("id") == F.col("wine_id"))
    p = F.col("price")
    mk, li = F.when(k % 3 > 0, p), F.when(k % 2 == 0, p)
    return d.select(
        "wine_id", "l_orderkey", "l_linenumber", "l_suppkey", (n % 4 > 0).alias("strong"), "cat_name", F.lit(0.95).alias("confidence"),
        mk.alias("mk_avg"), mk.alias("mk_min"), mk.alias("mk_max"), mk.alias("mk_wholesale"), F.lit("high").alias("mk_confidence"),
        F.when(k % 5 > 0, F.col("avg_retail_price")).alias("cat_price"), "cat_tier",
        li.alias("live_avg"), li.alias("live_min"), li.alias("live_max"), li.alias("live_wholesale"), F.lit("mid").alias("live_tier"), F.lit(3).alias("live_listings"),
        F.lit(40.0).alias("est_avg"), F.lit(20.0).alias("est_min"), F.lit(80.0).alias("est_max"), F.lit(20.8).alias("est_wholesale"),
        F.lit("mid").alias("est_tier"), F.lit("regional_proxy").alias("est_source"), F.lit("note").alias("est_note"),
    )


_SRC = f"CASE WHEN {_MK} THEN 'market_live' WHEN {_CA} THEN 'catalog' WHEN {_LI} THEN 'market_live' WHEN {_ES} THEN 'regional_estimate' ELSE 'unavailable' END"
_AVG = f"CAST(CASE WHEN {_MK} THEN mk_avg WHEN {_CA} THEN cat_price WHEN {_LI} THEN live_avg WHEN {_ES} THEN 40 END AS DECIMAL(12,2))"
_KEYS = "wine_id, l_orderkey, l_linenumber, l_suppkey"


@register("effective_price", s.q("choice", f"SELECT {_KEYS}, {_AVG} AS avg_retail, {_SRC} AS price_source FROM choice"))
def _(spark, sf):
    out = es.effective_price(choice(spark, sf), include_estimates=True)
    return out.select(*_KEYS.split(", "), "avg_retail", "price_source")


@register("real_source_filter", s.q("choice", f"SELECT {_KEYS}, CASE WHEN {_SRC} IN ('market_live', 'catalog') THEN {_AVG} END AS avg_retail, CASE WHEN {_SRC} IN ('market_live', 'catalog') THEN {_SRC} END AS price_source FROM choice"))
def _(spark, sf):
    out = es.real_source_filter(es.effective_price(choice(spark, sf), include_estimates=True))
    return out.select(*_KEYS.split(", "), "avg_retail", "price_source")


@register("basis_note", s.q("choice", f"""SELECT {_KEYS}, CASE WHEN {_MK} THEN 'Matched ''' || name || ''' in curated catalog (confidence 95%). Price from: aggregated.' WHEN {_CA} THEN 'Catalog reference price for ''' || name || '''. Live market data not yet cached — refresh for a real-time quote.'
    WHEN {_LI} THEN 'Live market data (3 listings). Wine not in catalog – retrieved in real time.' WHEN {_ES} THEN 'Regional bucket estimate only – producer unknown. Range: $20–$80. Wide confidence interval; verify before acting.' END AS note FROM choice"""))
def _(spark, sf):
    return es.effective_price(choice(spark, sf), include_estimates=True).select(*_KEYS.split(", "), F.col("price_basis_note").alias("note"))


# ------------------------------------------------------------------ whole analysis
def analyzed(spark, sf, items=None):
    return an.analyze_items(v.menu(spark, sf) if items is None else items, index(spark, sf), merged(spark, sf))


V["best"] = (["parsed", "item_matches"], "SELECT p.*, wine_id, round(score, 4) AS confidence, coalesce(confidence_level, 'none') AS confidence_level, coalesce(confidence_level IN ('very_high', 'high'), false) AS strong FROM parsed p LEFT JOIN (SELECT item_id, wine_id, score, confidence_level FROM item_matches WHERE rank = 1) USING (item_id)")
V["an0"] = (["best", "merged", "cat"], f"""SELECT b.*, c.name AS cat_name, c.varietal AS cat_varietal, CASE WHEN strong AND avg_retail IS NOT NULL THEN 'market_live' WHEN strong AND avg_retail_price > 0 THEN 'catalog' ELSE 'unavailable' END AS price_source,
    CASE WHEN strong THEN coalesce(avg_retail, avg_retail_price) END AS retail, CASE WHEN strong THEN CASE WHEN avg_retail IS NOT NULL THEN estimated_wholesale ELSE {s.wholesale('avg_retail_price', 'c.price_tier')} END END AS ws, c.price_tier AS tier
  FROM best b LEFT JOIN cat c ON c.id = b.wine_id LEFT JOIN merged m ON m.wine_id = b.wine_id""")
V["an1"] = (["an0"], f"SELECT *, CASE WHEN price_source = 'market_live' AND menu_price <> 0 THEN {s.ratio('menu_price', 'ws')} END AS wm FROM an0")
V["an"] = (["an1"], f"SELECT *, {s.score('wm', 'tier')} AS score FROM an1")


def analysis_sql(view, more=""):
    return s.q(view, f"SELECT item_id, wine_id, confidence, confidence_level, retail AS avg_retail, price_source, wm AS wholesale_multiple, score AS fairness_score, {s.verdict('score')} AS verdict{more} FROM {view}")


ANALYSIS_SQL = analysis_sql("an")


def analysis_rows(found, *more):
    return found.select(
        "item_id", "wine_id", "confidence", F.coalesce("confidence_level", F.lit("none")).alias("confidence_level"), "avg_retail",
        "price_source", "wholesale_multiple", "fairness_score", "verdict", *more,
    )


@register("analyze_items", ANALYSIS_SQL)
def _(spark, sf):
    return analysis_rows(analyzed(spark, sf))


# prices by product and year
V["banded_y"] = (["banded"], "SELECT * REPLACE (wine_id || '@' || vintage AS wine_id) FROM banded WHERE vintage IS NOT NULL")
V["cat_y"] = (["cat", "banded_y"], "SELECT c.* REPLACE (y.wine_id AS id) FROM cat c JOIN (SELECT DISTINCT wine_id FROM banded_y) y ON c.id = split_part(y.wine_id, '@', 1)")
s.clone("merged0", "banded", "_y")
V["merged_y"] = (["merged0_y", "cat_y"], V["merged"][1].replace("FROM cat c LEFT JOIN merged0 m", "FROM cat_y c LEFT JOIN merged0_y m"))
V["market"] = (["merged", "merged_y", "best"], """SELECT b.item_id AS of, CASE WHEN y.avg_retail IS NOT NULL THEN 'vintage' WHEN m.avg_retail IS NOT NULL THEN 'generic' END AS price_match,
    coalesce(y.avg_retail, m.avg_retail) AS avg_retail, CASE WHEN y.avg_retail IS NOT NULL THEN y.estimated_wholesale ELSE m.estimated_wholesale END AS estimated_wholesale
  FROM best b LEFT JOIN merged_y y ON y.wine_id = b.wine_id || '@' || b.vintage LEFT JOIN merged m ON m.wine_id = b.wine_id""")
V["an0_by"] = (["best", "market", "cat"], V["an0"][1].replace("LEFT JOIN merged m ON m.wine_id = b.wine_id", "LEFT JOIN market m ON m.of = b.item_id").replace("SELECT b.*", "SELECT b.*, price_match"))
V["an1_by"] = (["an0_by"], V["an1"][1].replace("FROM an0", "FROM an0_by"))
V["an_by"] = (["an1_by"], V["an"][1].replace("FROM an1", "FROM an1_by"))


@register("analyze_items_by_year", analysis_sql("an_by", ", price_match"))
def _(spark, sf):
    market = merge_sources_by_year(filter_price_band(v.offers(spark, sf)), products(spark, sf), v.TRUSTED)
    found = an.analyze_items(v.menu(spark, sf), index(spark, sf), market)
    return analysis_rows(found, "price_match")


V["res"] = (["an"], f"SELECT menu_id, item_id, strong AS matched, CASE WHEN strong THEN cat_name END AS wine_name, coalesce(CASE WHEN strong THEN nullif(cat_varietal, '') END, parsed_varietal) AS varietal, retail AS retail_price, {s.deal('menu_price', 'retail')} AS deal_rating, CASE WHEN retail <> 0 THEN round(CAST(menu_price AS DOUBLE) / CAST(retail AS DOUBLE), 2) END AS markup FROM an")


def results(spark, sf):
    return an.project_result_row(analyzed(spark, sf), ["menu_id", "item_id"])


@register("project_result_row", s.q("res", "SELECT menu_id, item_id, matched, wine_name, varietal, retail_price, deal_rating, markup FROM res"))
def _(spark, sf):
    return results(spark, sf).select("menu_id", "item_id", "matched", "wine_name", "varietal", "retail_price", "deal_rating", "markup")


@register("unpriced_feedback", s.q("res", "SELECT menu_id, item_id FROM res WHERE retail_price IS NULL"))
def _(spark, sf):
    return an.unpriced(results(spark, sf)).select("menu_id", "item_id")


@register("menu_summary", s.q("res", """SELECT menu_id, CAST(count(*) AS INTEGER) AS total_parsed, count(*) FILTER (matched) AS matched, count(*) FILTER (NOT matched) AS unmatched, count(*) FILTER (retail_price <> 0) AS with_price,
    count(*) FILTER (deal_rating = 'steal') AS steals, count(*) FILTER (deal_rating = 'good') AS good_deals, count(*) FILTER (deal_rating = 'fair') AS fair_deals, count(*) FILTER (deal_rating = 'expensive') AS expensive FROM res GROUP BY menu_id"""))
def _(spark, sf):
    return an.menu_summary(results(spark, sf))


# ------------------------------------------------------------------ from menu lines to the summary of each menu
from pourscale.checks import q_menu  # noqa: E402, F401  # its views

V["menu_d"] = (["entries"], """SELECT menu_id || '-' || line_no || '-' || step || '-' || sub AS item_id, menu_id, "desc" AS menu_text, CAST(menu_price AS DECIMAL(12,2)) AS menu_price, TRY_CAST(vintage AS INTEGER) AS given_vintage FROM entries""")
s.clone("res", "menu", "_d")
_SUMMARY = "CAST(count(*) AS INTEGER) AS total_parsed, count(*) FILTER (matched) AS matched, count(*) FILTER (retail_price <> 0) AS with_price, count(*) FILTER (deal_rating = 'steal') AS steals, count(*) FILTER (deal_rating = 'expensive') AS expensive"


@register("menu_to_summary", s.q("res_d", f"SELECT menu_id, {_SUMMARY} FROM res_d GROUP BY menu_id"))
def _(spark, sf):
    found = an.analyze_menus(v.menu_lines(spark, sf), index(spark, sf), merged(spark, sf))
    return an.menu_summary(found).select("menu_id", "total_parsed", "matched", "with_price", "steals", "expensive")
