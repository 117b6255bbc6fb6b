"""Readers on files: whole documents, malformed ones set aside, tiers derived on load."""

from pyspark.sql import functions as F

from pourscale.sources import readers as rd


def test_keyed_json_files_and_what_is_set_aside(spark, tmp_path):
    files = {"a": '{"x": {"name": "one", "avg_retail_price": 30}, "y": {"id": "z", "aliases": ["b"]}}', "b": "{broken", "c": " ", "d": "[1, 2]", "e": "{}", "f": '{\n"w": {"name": "two\\nlines"}\n}'}
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    fields = ", ".join(f"{p.split(' ')[0]}: {p.split(' ', 1)[1]}" for p in rd.ENTRY_SCHEMA.split(", "))
    rows, bad = rd.read_keyed_json(spark, str(tmp_path), f"struct<{fields}>")
    got = {r["id"]: (r["name"], r["price_tier"], r["aliases"]) for r in rd.extended_catalog(rows).collect()}
    assert got == {"x": ("one", "mid", []), "z": ("", "budget", ["b"]), "w": ("two\nlines", "budget", [])}
    assert {(r["path"][-1], r["reason"]) for r in bad.collect()} == {("b", "malformed"), ("c", "empty"), ("d", "not an object")}


def test_catalog_files_have_their_tier_derived(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"id": "p1", "avg_retail_price": 300.5, "price_tier": "budget", "aliases": ["q"], "catalog_ordinal": 1}\n')
    row = rd.read_catalog(spark, str(tmp_path), "json").first()
    assert (row["id"], row["price_tier"], row["aliases"], row["name"]) == ("p1", "luxury", ["q"], None)


def test_year_of_a_jsonld_product_is_the_last_of_its_name(spark):
    page = lambda name: f'<script type="application/ld+json">{{"name":"{name}","url":"/wines/7","offers":{{"price":"20"}}}}</script>'
    names = ["House 1950 2010", "House 2005", "1900 House", "House", "House 19501 12010"]
    rows = spark.createDataFrame([(i, page(n)) for i, n in enumerate(names)], "id int, html string")
    got = {r["id"]: r["vintage"] for r in rd.extract_offers_jsonld(rows, F.col("html"), ["id"]).collect()}
    assert got == {0: 2010, 1: 2005, 2: 1900, 3: None, 4: None}
