"""Score bounds per tier."""

import pytest
from pyspark.sql import functions as F

from pourscale.functions import pricing as px

BOUNDS = [
    ("budget", 2.0, 90, 100), ("budget", 7.0, 0, 20), ("mid", 3.0, 60, 100), ("mid", 6.0, 0, 20), ("premium", 2.0, 85, 100),
    ("premium", 5.0, 0, 30), ("luxury", 1.5, 90, 100), ("ultra", 2.0, 70, 100),
]


def test_bounds(spark):
    df = spark.createDataFrame(BOUNDS, "tier string, m double, lo int, hi int")
    rows = df.withColumn("s", px.fairness_score(F.col("m"), F.col("tier"))).collect()
    assert [r for r in rows if not r["lo"] <= r["s"] <= r["hi"]] == []


def test_ratio_is_half_to_even_on_cents(spark):
    df = spark.createDataFrame([(130.92, 16.0), (8.1835, 1.0), (1.0, 0.0), (1.0, 3.0), (2.0, 3.0)], "a double, b double")
    rows = [r[0] for r in df.select(px.ratio(F.col("a"), F.col("b"))).collect()]
    assert rows == [8.182, 8.18, None, 0.333, 0.667]
