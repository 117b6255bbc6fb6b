"""Queries of tiers, markup scores and ratings."""

from pyspark.sql import functions as F

from pourscale.checks import sql as s, views as v
from pourscale.checks.registry import register
from pourscale.functions import pricing as px
from pourscale.operators.markup import analyze_markup

KEYS = ["wine_id", "l_orderkey", "l_linenumber", "l_suppkey"]
_K = ", ".join(KEYS)
V = s.VIEWS
V["priced"] = (["offers", "cat"], f"""SELECT {_K}, price AS menu_price, avg_retail_price AS avg_retail, price_tier, {s.wholesale('avg_retail_price', 'price_tier')} AS wholesale
  FROM offers JOIN cat ON id = wine_id""")
V["scored0"] = (["priced"], f"SELECT *, {s.ratio('menu_price', 'avg_retail')} AS rm, {s.ratio('menu_price', 'wholesale')} AS wm FROM priced")
V["scored"] = (["scored0"], f"SELECT *, {s.score('wm', 'price_tier')} AS score FROM scored0")


def priced(spark, sf):
    c = v.cat(spark, sf).select("id", F.col("avg_retail_price").alias("avg_retail"), "price_tier")
    out = v.offers(spark, sf).join(c, F.col("id") == F.col("wine_id"))
    return out.select(
        *KEYS, F.col("price").alias("menu_price"), "avg_retail", "price_tier",
        px.estimate_wholesale(F.col("avg_retail"), F.col("price_tier")).alias("wholesale"),
    )


def scored(spark, sf):
    out = priced(spark, sf).withColumns(
        {"rm": px.ratio(F.col("menu_price"), F.col("avg_retail")), "wm": px.ratio(F.col("menu_price"), F.col("wholesale"))}
    )
    return out.withColumn("score", px.fairness_score(F.col("wm"), F.col("price_tier")))


@register("price_tier", s.q("offers ev", f"SELECT kind, tier, count(*) AS n FROM (SELECT 'event' AS kind, {s.tier('price')} AS tier FROM ev UNION ALL SELECT 'offer', {s.tier('price')} FROM offers) GROUP BY ALL"))
def _(spark, sf):
    t = px.price_tier(F.col("price")).alias("tier")
    rows = v.events(spark, sf).select(F.lit("event").alias("kind"), t).union(v.offers(spark, sf).select(F.lit("offer"), t))
    return rows.groupBy("kind", "tier").agg(F.count(F.lit(1)).alias("n"))


@register("estimate_wholesale", s.q("priced", f"SELECT {_K}, price_tier, avg_retail, wholesale FROM priced"))
def _(spark, sf):
    return priced(spark, sf).select(*KEYS, "price_tier", "avg_retail", "wholesale")


@register("price_multiples", s.q("scored0", f"SELECT {_K}, rm, wm FROM scored0"))
def _(spark, sf):
    return scored(spark, sf).select(*KEYS, "rm", "wm")


@register("fairness_score", s.q("scored", f"SELECT {_K}, wm, score FROM scored"))
def _(spark, sf):
    return scored(spark, sf).select(*KEYS, "wm", "score")


@register("verdict", s.q("scored", f"SELECT verdict, verdict_label, count(*) AS n, sum(menu_price) AS spend FROM (SELECT *, {s.verdict('score')} AS verdict, {s.verdict('score', 2)} AS verdict_label FROM scored) GROUP BY ALL"))
def _(spark, sf):
    sc = F.col("score")
    return scored(spark, sf).groupBy(px.verdict(sc).alias("verdict"), px.verdict_label(sc).alias("verdict_label")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("menu_price").alias("spend")
    )


@register("markup_flags", s.q("scored", f"SELECT {_K}, {s.flags('menu_price', 'wholesale', 'wm', 'rm', 'price_tier')} AS flags FROM scored"))
def _(spark, sf):
    f = px.markup_flags(F.col("menu_price"), F.col("wholesale"), F.col("wm"), F.col("rm"), F.col("price_tier"))
    return scored(spark, sf).select(*KEYS, F.array_join(f, "|").alias("flags"))


@register("insight_text", s.q("scored", f"SELECT {_K}, {s.insight('menu_price', 'avg_retail', 'wholesale', 'wm', 'price_tier')} AS insight FROM scored"))
def _(spark, sf):
    t = px.insight_text(F.col("menu_price"), F.col("avg_retail"), F.col("wholesale"), F.col("wm"), F.col("price_tier"))
    return scored(spark, sf).select(*KEYS, t.alias("insight"))


@register("analyze_markup", s.q("scored", f"""SELECT {_K}, rm AS retail_multiple, wm AS wholesale_multiple, score AS fairness_score, {s.verdict('score')} AS verdict, {s.verdict('score', 2)} AS verdict_label,
    {s.flags('menu_price', 'wholesale', 'wm', 'rm', 'price_tier')} AS flags, {s.insight('menu_price', 'avg_retail', 'wholesale', 'wm', 'price_tier')} AS insight,
    {s.tier_value('price_tier', 'fair_low')} AS range_low, {s.tier_value('price_tier', 'fair_high')} AS range_high FROM scored"""))
def _(spark, sf):
    out = analyze_markup(priced(spark, sf), wholesale="wholesale")
    return out.select(
        *KEYS, "retail_multiple", "wholesale_multiple", "fairness_score", "verdict", "verdict_label",
        F.array_join("flags", "|").alias("flags"), "insight", "range_low", "range_high",
    )


@register("deal_rating", s.q("priced", f"SELECT {_K}, {s.deal('menu_price', 'avg_retail')} AS deal_rating FROM priced"))
def _(spark, sf):
    return priced(spark, sf).select(*KEYS, px.deal_rating(F.col("menu_price"), F.col("avg_retail")).alias("deal_rating"))


@register("band_from_point", s.q("offers", f"SELECT {_K}, price, CAST(round(price * CAST(0.85 AS DECIMAL(3,2)), 2) AS DECIMAL(12,2)) AS low, CAST(round(price * CAST(1.15 AS DECIMAL(3,2)), 2) AS DECIMAL(12,2)) AS high FROM offers"))
def _(spark, sf):
    low, high = px.price_range(F.col("price"))
    return v.offers(spark, sf).select(*KEYS, "price", low.alias("low"), high.alias("high"))


@register("verdict_summary", s.q("source_prices merged", f"""SELECT price_tier, verdict, deal_rating, count(*) AS n FROM (
    SELECT price_tier, {s.verdict('(' + s.score('wm', 'price_tier') + ')')} AS verdict, {s.deal('avg_price', 'avg_retail')} AS deal_rating
    FROM (SELECT p.avg_price, m.avg_retail, m.price_tier, {s.ratio('p.avg_price', 'm.estimated_wholesale')} AS wm FROM source_prices p JOIN merged m USING (wine_id))) GROUP BY ALL"""))
def _(spark, sf):
    """Offers to statistics to merged price to score, counted by verdict."""
    from pourscale.checks.q_offers import merged, source_prices

    m = merged(spark, sf).select("wine_id", "avg_retail", "estimated_wholesale", "price_tier")
    rows = source_prices(spark, sf).join(m, "wine_id")
    wm = px.ratio(F.col("avg_price"), F.col("estimated_wholesale"))
    out = rows.withColumn("wm", wm).select(
        "price_tier", px.verdict(px.fairness_score(F.col("wm"), F.col("price_tier"))).alias("verdict"),
        px.deal_rating(F.col("avg_price"), F.col("avg_retail")).alias("deal_rating"),
    )
    return out.groupBy("price_tier", "verdict", "deal_rating").agg(F.count(F.lit(1)).alias("n"))
