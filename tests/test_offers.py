"""Offer statistics on a hot product, and the price fallbacks."""

import statistics

from pyspark.sql import functions as F

from pourscale.operators import offers as o
from pourscale.operators.estimates import longest_key_join


def test_statistics_of_a_hot_product(spark):
    df = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("p"), (F.col("id") % 500).cast("string"))).alias("wine_id"),
        F.lit("s").alias("source"), ((F.col("id") * 7919) % 9000 / 100 + 5).cast("decimal(12,2)").alias("price"),
    )
    got = {r["wine_id"]: r for r in o.source_offer_stats(df).collect()}
    trimmed = {r["wine_id"]: r for r in o.trim_offer_outliers(df).collect()}
    groups = {}
    for r in df.collect():
        groups.setdefault(r["wine_id"], []).append(r["price"])
    for key, prices in groups.items():
        prices.sort()
        assert got[key]["median_price"] == prices[len(prices) // 2]
        kept = [p for p in prices if p <= prices[len(prices) // 2] * 5] if len(prices) >= 3 else prices
        assert trimmed[key]["median_price"] == kept[len(kept) // 2]
        assert trimmed[key]["num_listings"] == len(kept)
        assert abs(float(trimmed[key]["avg_price"]) - statistics.mean(map(float, kept))) < 0.006


def test_longest_contained_key(spark):
    texts = ["old napa valley red", "napa", "none", "xchablisx ab", "", None]
    keys = [("napa", 0), ("napa valley", 1), ("chablis", 2), ("ab", 3), ("e", 4)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r["t"]: r["k"]["key"] if r["k"] else None for r in longest_key_join(df, "t", spark.createDataFrame(keys, "key string, ordinal int"), "k").collect()}
    assert got == {t: min((k for k in keys if k[0] in (t or "")), key=lambda k: (-len(k[0]), k[1]), default=(None,))[0] for t in texts}
