"""Lookup tables the estimates need: schemas, readers, and a small sample.

Real content (hundreds of appellations and houses) comes from the caller's
files in the same schemas.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

REFERENCE_SCHEMA = "key string, low double, mid double, high double, ordinal int"
PREMIUM_SCHEMA = "key string, multiplier double, note string, ordinal int"
HINT_SCHEMA = "key string, implied string, ordinal int"

# samples of our own, with invented prices: enough to run every estimate, no price guide
SAMPLE_REFERENCE = [
    ("bubbly coast", 31.0, 64.0, 171.0, 0),
    ("chalk hill", 19.0, 37.0, 83.0, 1),
    ("chalk hill upper slope", 71.0, 133.0, 322.0, 2),
    ("napa", 27.0, 57.0, 143.0, 3),
    ("napa valley", 33.0, 67.0, 173.0, 4),
    ("bordeaux", 17.0, 43.0, 151.0, 5),
    ("barolo", 37.0, 79.0, 241.0, 6),
    ("old anvil", 20.0, 30.0, 55.0, 7),
    ("piedmont nebbiolo", 29.0, 53.0, 117.0, 8),
]
SAMPLE_VARIETAL = [
    ("pinot noir", 21.0, 47.0, 131.0, 0),
    ("cabernet sauvignon", 23.0, 59.0, 187.0, 1),
    ("chardonnay", 17.0, 41.0, 113.0, 2),
    ("riesling", 16.0, 34.0, 89.0, 3),
]
# region and the words that name it; the longest word wins. Callers give their own list.
SAMPLE_REGIONS = {
    "bordeaux": ["bordeaux", "pauillac", "margaux"],
    "burgundy": ["burgundy", "bourgogne", "chablis"],
    "champagne": ["champagne"],
    "alsace": ["alsace"],
    "rhone": ["rhone"],
    "loire": ["loire"],
    "napa": ["napa", "napa valley"],
    "sonoma": ["sonoma"],
    "tuscany": ["tuscany", "toscana"],
    "piedmont": ["piedmont", "barolo"],
    "rioja": ["rioja"],
    "mosel": ["mosel"],
    "douro": ["douro"],
}
SAMPLE_PREMIUMS = [
    ("economy", 0.8, "Plain house", 0),
    ("promo estate", 2.5, "Promo Estate premium", 1),
    ("promo", 1.5, "Promo premium", 2),
    ("large house", 4.0, "Large House premium", 3),
]
SAMPLE_HINTS = [("blue ring", "old anvil", 0), ("blue", "napa valley", 1), ("standard", "barolo", 2)]


def region_rows(regions: dict[str, list[str]] | None = None) -> list[tuple[str, str, int]]:
    """(word, region, ordinal) rows of a list of regions, of the sample by default."""
    pairs = [(word, region) for region, words in (regions or SAMPLE_REGIONS).items() for word in words]
    return [(word, region, i) for i, (word, region) in enumerate(pairs)]


def sample_reference(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SAMPLE_REFERENCE, REFERENCE_SCHEMA)


def sample_varietals(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SAMPLE_VARIETAL, REFERENCE_SCHEMA)


def sample_premiums(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SAMPLE_PREMIUMS, PREMIUM_SCHEMA)


def sample_hints(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SAMPLE_HINTS, HINT_SCHEMA)


def read_lookup(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header in one of the schemas above."""
    return spark.read.csv(path, header=True, schema=schema, mode="FAILFAST")
