"""Queries of offer filters, statistics and merging."""

from pyspark.sql import functions as F

from pourscale import fixed_values as fv
from pourscale.checks import sql as s, views as v
from pourscale.checks.registry import register
from pourscale.functions import pricing as px
from pourscale.operators import offers as o
from pourscale.session import work_folder
from pourscale.sources.keyed_table import read_table
from pourscale.sources.readers import write_price_table

KEYS = ["wine_id", "l_orderkey", "l_linenumber", "l_suppkey"]
_K = ", ".join(KEYS)


def products(spark, sf):
    return v.cat(spark, sf).select(F.col("id").alias("wine_id"), F.col("avg_retail_price").alias("base_price"), "price_tier")


def source_prices(spark, sf):
    return o.source_offer_stats(o.filter_price_band(v.offers(spark, sf)))


def merged(spark, sf):
    return o.merge_sources(source_prices(spark, sf), products(spark, sf), v.TRUSTED)


_bands = {"menu": fv.MENU_PRICE_BAND, "listing": fv.LISTING_PRICE_BAND, "retail": fv.RETAIL_PRICE_BAND, "glass": fv.GLASS_PRICE_BAND}


@register("filter_price_band", s.q("offers", f"SELECT {_K}, price, " + ", ".join(f"price BETWEEN {a} AND {b} AS in_{n}" for n, (a, b) in _bands.items()) + " FROM offers WHERE price BETWEEN 3 AND 50000"))
def _(spark, sf):
    rows = o.filter_price_band(v.offers(spark, sf), fv.GLASS_PRICE_BAND)
    return rows.select(*KEYS, "price", *[F.col("price").between(*b).alias(f"in_{n}") for n, b in _bands.items()])


@register("filter_bottle_unit", s.q("offers", f"SELECT {_K}, price FROM offers WHERE contains(unit, '750ml') AND price BETWEEN 5 AND 50000"))
def _(spark, sf):
    return o.filter_bottle_unit(v.offers(spark, sf)).select(*KEYS, "price")


@register("filter_vintage_listing", s.q("offers", f"SELECT {_K}, vintage FROM offers WHERE vintage IS NULL OR vintage = 1998"))
def _(spark, sf):
    return o.filter_vintage_listing(v.offers(spark, sf), 1998).select(*KEYS, "vintage")


_GUARD = "FROM offers JOIN cat ON id = wine_id"
_BULK = "CAST(price AS DOUBLE) / CAST(avg_retail_price AS DOUBLE) BETWEEN 0.1 AND 10.0"


@register("price_ratio_guard", s.q("offers cat", f"SELECT {_K}, price, avg_retail_price AS reference_price, {_BULK} AS plausible {_GUARD}"))
def _(spark, sf):
    good, bad = o.price_ratio_guard(v.offers(spark, sf), v.cat(spark, sf))
    cols = [*KEYS, "price", "reference_price"]
    return good.select(*cols, F.lit(True).alias("plausible")).unionByName(bad.select(*cols, F.lit(False).alias("plausible")))


_STATS = "wine_id, source, avg_price, min_price, max_price, median_price, num_listings"


@register("source_offer_stats", s.q("source_prices", f"SELECT {_STATS} FROM source_prices"))
def _(spark, sf):
    return source_prices(spark, sf)


@register("trim_offer_outliers", s.q("banded", f"""SELECT wine_id, source, {s.mean('sum(price)', 'count(price)')} AS avg_price, min(price) AS min_price, max(price) AS max_price,
    {s.upper_median('price')} AS median_price, CAST(count(price) AS INTEGER) AS num_listings
  FROM (SELECT b.*, n, mid FROM banded b JOIN (SELECT wine_id, source, count(*) AS n, {s.upper_median('price')} AS mid FROM banded GROUP BY ALL) USING (wine_id, source)) WHERE n < 3 OR price <= mid * 5 GROUP BY wine_id, source"""))
def _(spark, sf):
    return o.trim_offer_outliers(o.filter_price_band(v.offers(spark, sf)))


@register("live_offer_stats", s.q("offers", f"""SELECT lookup_id, avg_retail, min_retail, max_retail, num_listings, {s.tier('avg_retail')} AS price_tier,
    {s.wholesale('avg_retail', '(' + s.tier('avg_retail') + ')')} AS estimated_wholesale, CASE WHEN num_listings >= 5 THEN 'high' ELSE 'medium' END AS data_confidence
  FROM (SELECT p_partkey AS lookup_id, coalesce({s.mean('tot', 'n')}, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_retailprice AS DECIMAL(12,2)) END) AS avg_retail,
      coalesce(lo, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_retailprice AS DECIMAL(12,2)) END) AS min_retail, coalesce(hi, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_retailprice AS DECIMAL(12,2)) END) AS max_retail, CAST(coalesce(n, 1) AS INTEGER) AS num_listings
    FROM part LEFT JOIN (SELECT l_partkey, sum(price) AS tot, min(price) AS lo, max(price) AS hi, count(price) AS n FROM (SELECT * REPLACE (CASE WHEN l_partkey % 20 <> 0 THEN l_partkey ELSE -l_partkey END AS l_partkey) FROM offers) WHERE price <> 0 GROUP BY 1) ON l_partkey = p_partkey) WHERE avg_retail IS NOT NULL"""))
def _(spark, sf):
    p = v.table(spark, sf, "part")
    hits = p.select(F.col("p_partkey").alias("lookup_id"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_retailprice").cast("decimal(12,2)")).alias("quoted"))
    off = v.offers(spark, sf).select(F.when(F.col("l_partkey") % 20 != 0, F.col("l_partkey")).otherwise(-F.col("l_partkey")).alias("lookup_id"), "price")
    return o.live_offer_stats(hits, off)


_MERGED = "wine_id, base_price, price_tier, avg_retail, min_retail, max_retail, median_retail, estimated_wholesale, source, data_confidence, n_sources, total_listings"


@register("merge_sources", s.q("merged", f"SELECT {_MERGED} FROM merged"))
def _(spark, sf):
    return merged(spark, sf)


@register("reject_outlier_sources", s.q("marked", "SELECT wine_id, source, avg_price, counted FROM marked"))
def _(spark, sf):
    return o.reject_outlier_sources(source_prices(spark, sf), v.TRUSTED).select("wine_id", "source", "avg_price", "counted")


@register("price_confidence", s.q("merged", "SELECT wine_id, n_sources, total_listings, data_confidence FROM merged"))
def _(spark, sf):
    return merged(spark, sf).select("wine_id", "n_sources", "total_listings", "data_confidence")


@register("collect_sources", s.q("source_prices", "SELECT wine_id, string_agg(source || ':' || avg_price || ':' || num_listings, '|' ORDER BY source) AS sources FROM source_prices GROUP BY wine_id"))
def _(spark, sf):
    one = lambda x: F.concat_ws(":", x["source"], x["avg_price"].cast("string"), x["num_listings"].cast("string"))
    return o.collect_sources(source_prices(spark, sf)).select("wine_id", F.array_join(F.transform("sources", one), "|").alias("sources"))


@register("union_sources", s.q("offers", "SELECT source, count(*) AS n, sum(price) AS total FROM (SELECT CASE WHEN l_suppkey % 7 < 3 THEN 'east' ELSE 'west' END AS source, price FROM offers) GROUP BY source"))
def _(spark, sf):
    off = v.offers(spark, sf).drop("source")
    none = off.where("false")
    stacked = o.union_sources({"east": off.where("l_suppkey % 7 < 3"), "west": off.where("l_suppkey % 7 >= 3"), "silent": none})
    return stacked.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("total"))


@register("latest_price", s.q("source_prices cat", "SELECT id, source, CASE WHEN avg_price > 0 THEN avg_price WHEN avg_retail_price > 0 THEN avg_retail_price END AS price FROM cat LEFT JOIN source_prices ON wine_id = id"))
def _(spark, sf):
    seen = source_prices(spark, sf).select("wine_id", "source", "avg_price")
    out = v.cat(spark, sf).join(seen, F.col("id") == F.col("wine_id"), "left")
    return out.select("id", "source", o.latest_price(F.col("avg_price"), F.col("avg_retail_price")).alias("price"))


V = s.VIEWS
V["year_prices"] = (["offers"], f"SELECT {s.other_key('l_partkey % 20 <> 0')} AS wine_id, vintage, max(price) AS price, max(fetched_at) AS fetched_at FROM offers GROUP BY ALL")


def year_prices(spark, sf):
    return v.offers(spark, sf).groupBy(v.other_key("l_partkey % 20 <> 0"), "vintage").agg(
        F.max("price").alias("price"), F.max("fetched_at").alias("fetched_at")
    )


@register("sink_price_table", s.q("offers", "SELECT wine_id, arg_max(price, (fetched_at, price)) AS price, max(fetched_at) AS fetched_at FROM offers GROUP BY wine_id"))
def _(spark, sf):
    off, folder = v.offers(spark, sf), work_folder(spark, "prices")
    for batch, part in enumerate((0, 1, 2, 2)):  # three batches, the last one written twice
        rows = off.where(F.col("l_linenumber") % 3 == part).select("wine_id", "price", "fetched_at")
        write_price_table(rows, folder, min(batch, 2))
    return read_table(spark, folder).select("wine_id", "price", "fetched_at")


V["wanted"] = (["offers"], "SELECT DISTINCT wine_id, vintage FROM offers")
_BOTH = """FROM wanted w LEFT JOIN year_prices e ON w.wine_id = e.wine_id AND w.vintage = e.vintage LEFT JOIN year_prices g ON w.wine_id = g.wine_id AND g.vintage IS NULL"""


@register("vintage_fallback_join", s.q("wanted year_prices", f"SELECT w.wine_id, w.vintage, coalesce(e.price, g.price) AS price, CASE WHEN e.price IS NOT NULL THEN 'vintage' WHEN g.price IS NOT NULL THEN 'generic' END AS price_match {_BOTH}"))
def _(spark, sf):
    wanted = v.offers(spark, sf).select("wine_id", "vintage").distinct()
    return o.vintage_fallback_join(wanted, year_prices(spark, sf).drop("fetched_at"))


@register("priority_pick", s.q("year_prices", "SELECT item_id, vintage, price FROM (SELECT wine_id AS item_id, vintage, price FROM year_prices) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY vintage ASC NULLS LAST) = 1"))
def _(spark, sf):
    rows = year_prices(spark, sf)
    return o.priority_pick(rows.select(F.col("wine_id").alias("item_id"), "vintage", "price"))


@register("tier_lookup_join", s.q("offers", f"SELECT {_K}, t AS tier, {s.tier_value('t', 'wholesale_ratio')} AS wholesale_ratio, {s.tier_value('t', 'fair_low')} AS fair_low, {s.tier_value('t', 'ttl_days')} AS ttl_days FROM (SELECT *, CASE WHEN l_linenumber = 7 THEN 'unknown' ELSE {s.tier('price')} END AS t FROM offers)"))
def _(spark, sf):
    rows = v.offers(spark, sf).withColumn("tier", F.when(F.col("l_linenumber") == 7, "unknown").otherwise(px.price_tier(F.col("price"))))
    tiers = px.tier_table(spark)
    default = px.tier_value(F.lit("mid"), "fair_low")
    out = rows.join(F.broadcast(tiers), "tier", "left")  # five rows
    return out.select(
        *KEYS, "tier", F.coalesce("wholesale_ratio", F.lit(fv.DEFAULT_WHOLESALE_RATIO)).alias("wholesale_ratio"),
        F.coalesce("fair_low", default).alias("fair_low"), F.coalesce("ttl_days", px.tier_value(F.lit("mid"), "ttl_days")).alias("ttl_days"),
    )


@register("rows_to_json", s.q("source_prices", "SELECT wine_id, source, '{\"avg_price\":' || avg_price || ',\"num_listings\":' || num_listings || '}' AS record FROM source_prices"))
def _(spark, sf):
    return source_prices(spark, sf).select("wine_id", "source", F.to_json(F.struct("avg_price", "num_listings")).alias("record"))
