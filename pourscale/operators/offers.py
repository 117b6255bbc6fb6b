"""Offers: price filters, statistics per source, and the merge of sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from pourscale import fixed_values as fv
from pourscale.functions import pricing as px
from pourscale.operators.skew import salted_join

MONEY = "decimal(12,2)"
WIDE = "decimal(20,2)"


# ------------------------------------------------------------------ filters
def filter_price_band(offers: DataFrame, band=fv.LISTING_PRICE_BAND, price: str = "price") -> DataFrame:
    return offers.where(F.col(price).between(*band))


def filter_bottle_unit(offers: DataFrame) -> DataFrame:
    """Listings sold as 750 ml with a per-bottle price in the listing band."""
    return filter_price_band(
        offers.where(F.contains("unit", F.lit("750ml")) & F.col("price").isNotNull())
    ).withColumn("price", F.round("price", 2).cast(MONEY))


def filter_vintage_listing(offers: DataFrame, vintage: int | None) -> DataFrame:
    if not vintage:
        return offers
    return offers.where(F.col("vintage").isNull() | (F.col("vintage") == vintage))


def ratio_within(price: Column, reference: Column, bounds: tuple[float, float]) -> Column:
    """Price / reference inside the bounds; no usable reference passes."""
    usable = F.coalesce(reference > 0, F.lit(False))
    r = price.cast("double") / F.when(usable, reference.cast("double"))
    return ~usable | r.between(*bounds)


def price_ratio_guard(observed: DataFrame, catalog: DataFrame, bounds=fv.MAP_RATIO_BOUNDS) -> tuple[DataFrame, DataFrame]:
    """Observed prices (wine_id, price) split into plausible and rejected rows."""
    ref = catalog.select(F.col("id").alias("wine_id"), F.col("avg_retail_price").alias("reference_price"))
    joined = observed.join(ref, "wine_id")
    ok = ratio_within(F.col("price"), F.col("reference_price"), bounds)
    return joined.where(ok), joined.where(~ok)


def union_sources(sources: dict[str, DataFrame]) -> DataFrame:
    """Stack offer tables, each under its source name; an empty source adds nothing."""
    parts = [df.withColumn("source", F.lit(name)) for name, df in sources.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


# ------------------------------------------------------------------ statistics
def upper_median(price: str) -> Column:
    """Element ``n div 2`` of the sorted prices.

    ``percentile_disc`` over descending prices is that element, and its partial
    state holds one counter per distinct price, so a hot product is combined on
    the map side and never collected.
    """
    return F.expr(f"percentile_disc(0.5) within group (order by {price} desc)").cast(MONEY)


def source_offer_stats(offers: DataFrame, keys=("wine_id", "source")) -> DataFrame:
    """Mean, min, max, upper median and number of the prices of each key."""
    return offers.groupBy(*keys).agg(
        F.round(F.sum(F.col("price").cast(WIDE)) / F.count("price"), 2).cast(MONEY).alias("avg_price"),
        F.min("price").cast(MONEY).alias("min_price"),
        F.max("price").cast(MONEY).alias("max_price"),
        upper_median("price").alias("median_price"),
        F.count("price").cast("int").alias("num_listings"),
    )


def trim_offer_outliers(offers: DataFrame, keys=("wine_id", "source"), factor: int = 5) -> DataFrame:
    """Statistics without prices above ``factor`` x upper median, from three offers on.

    Medians are map-side combined aggregates; offers meet their median in shares where one product has many of
    them, so neither step brings all offers of a product together.
    """
    rows = offers.select(*keys, "price")
    middle = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total"), upper_median("price").alias("_mid"))
    kept = salted_join(rows, middle, list(keys), "price").where((F.col("_total") < 3) | (F.col("price") <= F.col("_mid") * factor))
    return source_offer_stats(kept, keys)


def live_offer_stats(hits: DataFrame, offers: DataFrame) -> DataFrame:
    """Price of a live lookup: the offers of the hit, else its one quoted average.

    ``hits``: lookup_id, quoted; ``offers``: lookup_id, price.
    """
    stats = offers.where("price is not null and price <> 0").groupBy("lookup_id").agg(
        (F.sum(F.col("price").cast(WIDE)) / F.count("price")).alias("_avg"),
        F.min("price").alias("_min"), F.max("price").alias("_max"), F.count("price").cast("int").alias("_n"),
    )
    quoted = F.when(F.col("quoted") != 0, F.col("quoted"))
    out = hits.join(stats, "lookup_id", "left").select(
        "lookup_id",
        F.round(F.coalesce("_avg", quoted), 2).cast(MONEY).alias("avg_retail"),
        F.coalesce("_min", quoted).cast(MONEY).alias("min_retail"),
        F.coalesce("_max", quoted).cast(MONEY).alias("max_retail"),
        F.coalesce("_n", F.lit(1)).alias("num_listings"),
    ).where("avg_retail is not null")
    out = out.withColumn("price_tier", px.price_tier(F.col("avg_retail")))
    return out.withColumn("estimated_wholesale", px.estimate_wholesale(F.col("avg_retail"), F.col("price_tier"))).withColumn(
        "data_confidence", F.when(F.col("num_listings") >= 5, "high").otherwise("medium")
    )


# ------------------------------------------------------------------ merge
def reject_outlier_sources(source_prices: DataFrame, trusted: str, keys=("wine_id",), factor: float = 4.0) -> DataFrame:
    """Mark the sources that count: when the trusted mean is ``factor`` x the others' mean or more, only it does.

    One row per (key, source) comes in, so a key has as many rows as there are
    sources; the means are one small aggregate joined back by the window.
    """
    w = Window.partitionBy(*keys)
    is_trusted = F.col("source") == trusted
    mean = lambda cond: F.avg(F.when(cond, F.col("avg_price"))).over(w).cast("double")
    alone = F.coalesce(
        (mean(is_trusted) > 0) & (mean(~is_trusted) > 0) & (mean(is_trusted) / mean(~is_trusted) >= factor), F.lit(False)
    )
    return source_prices.withColumn("counted", F.col("avg_price").isNotNull() & (~alone | is_trusted))


def merge_sources(source_prices: DataFrame, products: DataFrame, trusted: str) -> DataFrame:
    """One price row per product from one row per (product, source).

    Means are weighted by listings (missing or zero listings weigh one).
    Listings and confidence count every source, also those set aside.
    ``products`` (wine_id, base_price, price_tier) keep a ``no_data`` row when
    no source knows them.
    """
    marked = reject_outlier_sources(source_prices, trusted)
    weight = F.when(F.coalesce("num_listings", F.lit(0)) == 0, 1).otherwise(F.col("num_listings")).cast("bigint")
    on = lambda c: F.when(F.col("counted"), c)
    merged = marked.groupBy("wine_id").agg(
        F.round(
            F.sum(on(F.col("avg_price").cast(WIDE) * weight)) / F.sum(on(weight)), 2
        ).cast(MONEY).alias("avg_retail"),
        F.min(on(F.col("min_price"))).cast(MONEY).alias("min_retail"),
        F.max(on(F.col("max_price"))).cast(MONEY).alias("max_retail"),
        F.round(
            F.sum(on(F.col("median_price").cast(WIDE))) / F.count(on(F.col("median_price"))), 2
        ).cast(MONEY).alias("_median"),
        F.count(F.lit(1)).cast("int").alias("n_sources"),
        F.sum(F.coalesce("num_listings", F.lit(0))).cast("bigint").alias("total_listings"),
    )
    out = products.join(merged, "wine_id", "left")
    known = F.coalesce(F.col("n_sources"), F.lit(0)) > 0
    avg = F.when(F.col("avg_retail") != 0, F.col("avg_retail"))
    return out.select(
        *products.columns,
        avg.alias("avg_retail"),
        "min_retail",
        "max_retail",
        F.coalesce("_median", avg).alias("median_retail"),
        F.when(known, px.estimate_wholesale(F.coalesce(avg, F.col("base_price")), F.col("price_tier"))).alias(
            "estimated_wholesale"
        ),
        F.when(known, "aggregated").otherwise("no_data").alias("source"),
        px.price_confidence(F.col("n_sources"), F.col("total_listings")).alias("data_confidence"),
        F.coalesce("n_sources", F.lit(0)).alias("n_sources"),
        F.coalesce("total_listings", F.lit(0)).alias("total_listings"),
    )


def merge_sources_by_year(offers: DataFrame, products: DataFrame, trusted: str) -> DataFrame:
    """Merged prices of every product (vintage null) and of every (product, year) that offers name, one row each."""
    generic = merge_sources(source_offer_stats(offers), products, trusted).withColumn("vintage", F.lit(None).cast("int"))
    key = F.concat_ws("@", "wine_id", F.col("vintage").cast("string"))
    dated = offers.where("vintage is not null").withColumn("wine_id", key)
    years = offers.where("vintage is not null").select("wine_id", "vintage").distinct()
    of = years.join(products, "wine_id").withColumn("wine_id", key).drop("vintage")
    yearly = merge_sources(source_offer_stats(dated), of, trusted)
    at = F.length("wine_id") - F.length(F.substring_index("wine_id", "@", -1))
    yearly = yearly.withColumn("vintage", F.substring_index("wine_id", "@", -1).cast("int")).withColumn("wine_id", F.substring(F.col("wine_id"), F.lit(1), at - 1))
    return generic.unionByName(yearly)


def collect_sources(source_prices: DataFrame) -> DataFrame:
    """All source rows of a product as one array, ordered by source name.

    The input holds one row per (product, source), so an array is as long as the
    list of sources.
    """
    row = F.struct("source", "avg_price", "min_price", "max_price", "num_listings")
    return source_prices.groupBy("wine_id").agg(F.sort_array(F.collect_list(row)).alias("sources"))


def latest_price(observed: Column, base: Column) -> Column:
    """Positive observed price, else positive catalog price."""
    return F.coalesce(F.when(observed > 0, observed), F.when(base > 0, base))


def priority_pick(prices: DataFrame) -> DataFrame:
    """One price per (item, product): that of the year before the one without year."""
    w = Window.partitionBy("item_id").orderBy(F.col("vintage").asc_nulls_last())
    return prices.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def vintage_fallback_join(items: DataFrame, prices: DataFrame) -> DataFrame:
    """Price of (wine_id, vintage), else of (wine_id, no year).

    A null vintage in ``prices`` is the generic price; of several prices of one
    (wine_id, vintage) the lowest counts.  The years of a product become one map
    so that a single join by product answers both lookups.
    """
    single = prices.groupBy("wine_id", "vintage").agg(F.min("price").alias("price"))
    dated = F.when(F.col("vintage").isNotNull(), F.struct("vintage", "price"))
    by_product = single.groupBy("wine_id").agg(
        F.map_from_entries(F.collect_list(dated)).alias("_by_year"),
        F.max(F.when(F.col("vintage").isNull(), F.col("price"))).alias("_generic"),
    )
    out = items.join(by_product, "wine_id", "left")
    exact = F.when(F.col("vintage").isNotNull(), F.try_element_at("_by_year", F.coalesce("vintage", F.lit(0))))
    plain = F.col("_generic")
    return out.withColumn("price", F.coalesce(exact, plain)).withColumn(
        "price_match", F.when(exact.isNotNull() & F.col("vintage").isNotNull(), "vintage").when(plain.isNotNull(), "generic")
    ).drop("_by_year", "_generic")
