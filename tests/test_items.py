"""Item texts with known results."""

import pytest
from pyspark.sql import functions as F

from pourscale.functions.items import parse_items
from pourscale.functions.text import clean_line, decode_entities, normalize_text

CASES = [
    # text, vintage, nv, varietal, region, style, ml
    ("2019 Opus One", 2019, False, None, None, None, None),
    ("Opus One 2018", 2018, False, None, None, None, None),
    ("Dom Perignon NV Champagne", None, True, None, "champagne", "sparkling", None),
    ("House Red N.V. $45", None, True, None, None, None, None),
    ("Old bottle 1849", None, False, None, None, None, None),
    ("Cab Sauv Napa Valley 1.5L", None, False, "cabernet sauvignon", "napa", None, 1500),
    ("Pinot Gris, Alsace 375ml", None, False, "pinot grigio", "alsace", None, 375),
    ("Ries Mosel 75cl", None, False, "riesling", "mosel", None, 750),
    ("Chablis Grand Cru Château X", None, False, None, "burgundy", None, None),
    ("Domaine Tempier Bandol Rosé", None, False, None, None, "rose", None),
    ("Gewürztraminer Magnum", None, False, "gewurztraminer", None, None, 1500),
]


@pytest.fixture(scope="module")
def parsed(spark):
    df = spark.createDataFrame([(c[0],) for c in CASES], "menu_text string")
    return {r["menu_text"]: r for r in parse_items(df).collect()}


@pytest.mark.parametrize("case", CASES, ids=lambda c: c[0])
def test_parse(parsed, case):
    text, vintage, nv, varietal, region, style, ml = case
    r = parsed[text]
    got = (r["parsed_vintage"], r["non_vintage"], r["parsed_varietal"], r["parsed_region"], r["parsed_type"], r["format_ml"])
    assert got == (vintage, nv, varietal, region, style, ml)


def test_comma_without_blank_splits_producer(spark):
    df = spark.createDataFrame([("Chateau A,Wine B",), ("Chateau A, Wine B",)], "menu_text string")
    rows = [(r["parsed_producer"], r["parsed_name"]) for r in parse_items(df).collect()]
    assert rows == [("Chateau A", "Wine B"), ("Chateau A Wine B", None)]
    kept = parse_items(df, split_before_clean=True).collect()
    assert [(r["parsed_producer"], r["parsed_name"]) for r in kept] == [("Chateau A", "Wine B")] * 2


def test_text_functions(spark):
    df = spark.createDataFrame([("Ch. Margaux  St. Émilion", "• Wine | 1,250 ..... RP 95 AQ", "A&amp;B &#8211; &eacute;&nope;")], "a string, b string, c string")
    row = df.select(normalize_text(F.col("a")), clean_line(F.col("b")), decode_entities(F.col("c"))).first()
    assert tuple(row) == ("chateau margaux saint emilion", "Wine 1250", "A&B – é&nope;")
