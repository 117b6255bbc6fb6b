"""Counts, coverage and run reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def count_by(catalog: DataFrame) -> DataFrame:
    """Counts by country, tier and style from one scan."""
    grouped = catalog.groupingSets(
        [[F.col("country")], [F.col("price_tier")], [F.col("wine_type")]], "country", "price_tier", "wine_type"
    ).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_g"))
    kind = F.when(F.col("_g") == 3, "country").when(F.col("_g") == 5, "price_tier").otherwise("wine_type")
    value = F.when(F.col("_g") == 3, F.col("country")).when(F.col("_g") == 5, F.col("price_tier")).otherwise(F.col("wine_type"))
    return grouped.select(kind.alias("kind"), value.alias("value"), "n")


def top_regions(catalog: DataFrame, limit: int = 25) -> DataFrame:
    head = F.trim(F.substring_index("region", ",", 1))
    out = catalog.groupBy(head.alias("region_head")).agg(
        F.count(F.lit(1)).alias("n"), F.min("catalog_ordinal").alias("first_seen")
    )
    return out.orderBy(F.desc("n"), "first_seen").limit(limit).drop("first_seen")


def fold_variants(catalog: DataFrame) -> DataFrame:
    """Counts by style with both spellings of rosé as one."""
    style = F.when(F.col("wine_type").isin("rose", "rosé"), "rosé").otherwise(F.col("wine_type"))
    return catalog.groupBy(style.alias("wine_type")).agg(F.count(F.lit(1)).alias("n"))


def coverage_flags(catalog: DataFrame, prices: DataFrame) -> DataFrame:
    """One row per product: has a price without year, number of years priced."""
    per_id = prices.groupBy("wine_id").agg(
        F.max(F.col("vintage").isNull()).alias("generic"), F.count_distinct("vintage").alias("years")
    )
    return catalog.join(per_id, F.col("id") == F.col("wine_id"), "left").select(
        "id", "country", F.coalesce("generic", F.lit(False)).alias("generic"), F.coalesce("years", F.lit(0)).alias("years")
    )


def coverage_stats(catalog: DataFrame, prices: DataFrame) -> DataFrame:
    covered = F.col("generic") | (F.col("years") > 0)
    out = coverage_flags(catalog, prices).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("generic").alias("generic_priced"),
        F.sum("years").alias("vintage_entries"),
        F.count_if(covered).alias("covered"),
    )
    return out.withColumn("covered_pct", F.bround(F.lit(100.0) * F.col("covered") / F.col("total")).cast("int")).withColumn(
        "unpriced", F.col("total") - F.col("covered")
    )


def country_coverage(catalog: DataFrame, prices: DataFrame) -> DataFrame:
    """Products and generically priced products per country."""
    out = coverage_flags(catalog, prices).groupBy("country").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("generic").alias("priced")
    )
    return out.withColumn("pct", F.bround(F.lit(100.0) * F.col("priced") / F.col("total")).cast("int"))


def coverage_semi(catalog: DataFrame, prices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Products with any price, and those without."""
    ids = prices.select(F.col("wine_id").alias("id"))
    return catalog.join(ids, "id", "left_semi"), catalog.join(ids, "id", "left_anti")


def avg_price_by_country(catalog: DataFrame) -> DataFrame:
    mean = F.sum(F.col("avg_retail_price").cast("decimal(20,2)")) / F.count("avg_retail_price")
    return catalog.groupBy("country").agg(F.bround(mean, 0).cast("double").alias("avg_price"))


def run_summary(outcomes: DataFrame, run: str = "run_id") -> DataFrame:
    """Per run: totals, share found, elapsed seconds (outcome columns: ok, seen_at)."""
    out = outcomes.groupBy(run).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("ok").alias("success"), F.count_if(~F.col("ok")).alias("failed"),
        F.min("seen_at").alias("_from"), F.max("seen_at").alias("_to"),
    )
    return out.select(
        run, "total", "success", "failed",
        F.bround(F.lit(100.0) * F.col("success") / F.greatest(F.col("total"), F.lit(1))).cast("int").alias("found_pct"),
        elapsed_seconds(F.col("_from"), F.col("_to")).alias("elapsed_s"),
    )


def elapsed_seconds(start, end):
    return F.round((F.unix_micros(end) - F.unix_micros(start)) / 1_000_000, 1)


def job_progress(items: DataFrame, done: DataFrame) -> DataFrame:
    """Items and distinct finished items per job (items: job_id, item; done: job_id, item)."""
    totals = items.groupBy("job_id").agg(F.count(F.lit(1)).alias("total"))
    ready = done.groupBy("job_id").agg(F.count_distinct("item").alias("done"))
    out = totals.join(ready, "job_id", "left").withColumn("done", F.coalesce("done", F.lit(0)))
    return out.withColumn("finished", F.col("done") >= F.col("total"))
