"""Catalog upkeep: union, insert, drift merge, worklists, expiry, id maps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from pourscale import fixed_values as fv
from pourscale.functions import pricing as px
from pourscale.functions.text import producer_guess, slug
from pourscale.operators.offers import price_ratio_guard


def derive_tier(catalog: DataFrame) -> DataFrame:
    """Tier always follows the price; a stored tier is ignored."""
    return catalog.withColumn("price_tier", px.price_tier(F.coalesce("avg_retail_price", F.lit(0))))


def catalog_union_all(parts: list[DataFrame]) -> DataFrame:
    """Stack regional catalogs; order is (part, ordinal inside the part)."""
    numbered = [p.withColumn("part_no", F.lit(i)) for i, p in enumerate(parts)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)


def union_catalog(static: DataFrame, discovered: DataFrame) -> DataFrame:
    """Both catalogs, the first row of an id wins and static rows come first."""
    both = static.withColumn("source_rank", F.lit(0)).unionByName(
        discovered.withColumn("source_rank", F.lit(1)), allowMissingColumns=True
    )
    w = Window.partitionBy("id").orderBy("source_rank", "catalog_ordinal")
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def id_lookup(ids: DataFrame, static: DataFrame, discovered: DataFrame) -> DataFrame:
    """Product of each wanted id from the united catalog; null when unknown."""
    return ids.join(union_catalog(static, discovered), "id", "left")


def discovered_to_catalog(cards: DataFrame) -> DataFrame:
    """Result cards (external_id, title, price, region, country) to catalog rows with defaults."""
    price = F.coalesce("price", F.lit(0)).cast("decimal(12,2)")
    return cards.select(
        slug(F.concat_ws(" ", "title", "external_id"), None).alias("id"),
        F.col("title").alias("name"),
        producer_guess(F.col("title")).alias("producer"),
        "region", "country",
        F.col("region").alias("appellation"),
        F.lit("").alias("varietal"),
        F.lit("red").alias("wine_type"),
        price.alias("avg_retail_price"),
        px.price_tier(price).alias("price_tier"),
        "external_id",
    )


def insert_if_absent(catalog: DataFrame, found: DataFrame) -> DataFrame:
    """New rows whose id the catalog does not hold, once per id."""
    first = Window.partitionBy("id").orderBy("catalog_ordinal")
    once = found.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
    fresh = derive_tier(once.join(catalog.select("id"), "id", "left_anti"))
    fresh = fresh.withColumn("wine_type", F.coalesce("wine_type", F.lit("red")))
    return catalog.unionByName(fresh, allowMissingColumns=True)


def merge_with_drift(current: DataFrame, seed: DataFrame, price: str = "avg_price", key: str = "wine_id") -> DataFrame:
    """Seed into current prices: new keys are added; a price that moved more than
    1 % of max(current, 1) is replaced when both are non-zero.  ``change`` says which."""
    c, s = current.alias("c"), seed.alias("s")
    cp, sp = F.col(f"c.{price}").cast("double"), F.col(f"s.{price}").cast("double")
    moved = F.coalesce(
        (sp != 0) & (cp != 0) & (F.abs(sp - cp) / F.greatest(cp, F.lit(1.0)) > 0.01), F.lit(False)
    )
    change = F.when(F.col(f"c.{key}").isNull(), "added").when(moved, "updated").otherwise("kept")
    rest = [x for x in current.columns if x != key]
    take_seed = change.isin("added", "updated")
    return c.join(s, key, "full").select(
        key, change.alias("change"), *[F.when(take_seed, F.col(f"s.{x}")).otherwise(F.col(f"c.{x}")).alias(x) for x in rest]
    )


def worklist_cross(products: DataFrame, years: list[int | None]) -> DataFrame:
    """One row per product and wanted year (null: the price without year)."""
    wanted = F.array(*[F.lit(y).cast("int") for y in years])
    return products.withColumn("vintage", F.explode(wanted))


def freshness_worklist(
    products: DataFrame, years: list[int | None], prices: DataFrame, as_of: Column | None = None,
    max_age_days: int | Column | None = None,
) -> DataFrame:
    """Product-year pairs without a price that is recent enough.

    Without an age limit any existing price counts as fresh; with one, a price
    without time is stale.
    """
    fresh = prices
    if max_age_days is not None:
        days = F.lit(max_age_days) if isinstance(max_age_days, int) else max_age_days
        fresh = prices.where(F.col("fetched_at") >= age_cutoff(as_of, days))
    keys = fresh.select("wine_id", F.coalesce("vintage", F.lit(0)).alias("_y")).distinct()
    work = worklist_cross(products, years).withColumn("_y", F.coalesce("vintage", F.lit(0)))
    return work.join(keys, ["wine_id", "_y"], "left_anti").drop("_y")


def age_cutoff(as_of: Column, days: Column) -> Column:
    return as_of - F.make_dt_interval(days=days)


def tiered_refresh_set(products: DataFrame, years: list[int | None], prices: DataFrame, as_of: Column) -> DataFrame:
    """Refresh worklist: ultra and luxury after 14 days, every other tier after 30."""
    dear = F.col("price_tier").isin("ultra", "luxury")
    parts = []
    for rows, days in ((products.where(dear), 14), (products.where(~dear), 30)):
        parts.append(freshness_worklist(rows, years, prices, as_of, days).withColumn("max_age_days", F.lit(days)))
    return parts[0].unionByName(parts[1])


def ttl_expiry(prices: DataFrame, as_of: Column) -> DataFrame:
    """Expiry time by tier and whether the price is still valid."""
    out = prices.withColumn("expires_at", px.expires_at(F.col("fetched_at"), px.ttl_seconds(F.col("price_tier"))))
    return out.withColumn("valid", F.col("expires_at") > as_of)


def drop_bad_mappings(id_map: DataFrame, observed: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Id map without the products whose observed price is implausible, and those products."""
    _, bad = price_ratio_guard(observed, catalog, fv.MAP_RATIO_BOUNDS)
    rejected = bad.select("wine_id").distinct()
    return id_map.join(rejected, "wine_id", "left_anti"), id_map.join(rejected, "wine_id", "left_semi")


def id_map_join(products: DataFrame, id_map: DataFrame) -> DataFrame:
    return products.join(id_map, "wine_id", "left").withColumn("mapped", F.col("external_id").isNotNull())


def not_known_anti(found: DataFrame, known: DataFrame, key: str = "id") -> DataFrame:
    return found.join(known.select(key).distinct(), key, "left_anti")


def dedupe_discovered(found: DataFrame, known: DataFrame) -> DataFrame:
    """First row per external id, without ids already in the catalog."""
    w = Window.partitionBy("external_id").orderBy("ordinal")
    once = not_known_anti(found, known).withColumn("_r", F.row_number().over(w))
    return once.where("_r = 1").drop("_r")


def cap_per_group(df: DataFrame, group: str, order: list, limit: int) -> DataFrame:
    """First ``limit`` rows per group: the reference's fill target per region or menu."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit).drop("_r")


def region_fill(catalog: DataFrame, wanted: DataFrame, limit: int) -> DataFrame:
    """Wanted regions that still have fewer than ``limit`` products, with their count."""
    counts = catalog.groupBy("region").agg(F.count(F.lit(1)).alias("n"))
    out = wanted.join(counts, "region", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.where(F.col("n") < limit)


def id_set_ops(priced: DataFrame, catalog: DataFrame) -> DataFrame:
    """Ids priced directly or by year that are in the catalog, each once."""
    every = priced.where("vintage is null").select("wine_id").union(priced.where("vintage is not null").select("wine_id"))
    return every.distinct().intersect(catalog.select(F.col("id").alias("wine_id")))
