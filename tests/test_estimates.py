"""Estimates: starts of keys stay where they are made, each text is estimated once, menus are read from a table."""

from pyspark.sql import functions as F

from pourscale.operators import estimates as es
from pourscale.plans import analyze as an
from pourscale.sources import lookups as lk


def lookups(spark):
    return {
        "reference": lk.sample_reference(spark), "varietals": lk.sample_varietals(spark),
        "premiums": lk.sample_premiums(spark), "hints": lk.sample_hints(spark),
    }


ITEMS = [
    (1, "Large House Napa Valley", "napa", "cabernet sauvignon", "red"), (2, "Large House Napa Valley", "napa", "cabernet sauvignon", "red"),
    (3, "Some Riesling", None, "riesling", None), (4, "Blue thing", None, None, None), (5, "Nothing", None, None, "sparkling"),
    (6, None, None, None, None), (7, "Nothing", None, None, None), (8, None, "napa", None, None),
]


def test_each_distinct_text_is_estimated_once(spark):
    items = spark.createDataFrame(ITEMS, "item_id int, menu_text string, parsed_region string, parsed_varietal string, parsed_type string")
    out = es.regional_estimate(items, **lookups(spark))
    got = {r["item_id"]: (r["stage"], r["est_avg"]) for r in out.collect()}
    assert got == {1: ("exact_0", 228.0), 2: ("exact_0", 228.0), 3: ("varietal", 34.0), 4: ("contained", 67.0), 5: (None, None), 6: (None, None), 7: (None, None), 8: ("exact_0", 57.0)}
    # the lookups are joined to distinct texts: one join holds the item ids
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Join" in line and "_as" in line for line in plan.splitlines()) == 1


def test_starts_without_a_key_are_not_shuffled(spark):
    texts = spark.createDataFrame([(i, f"wine {i} of napa valley {'x' * 40}") for i in range(200)], "id int, k string")
    out = es.longest_key_join(texts, "k", lk.sample_reference(spark))
    assert out.where("reference.key = 'napa valley'").count() == 200
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert any("Join LeftSemi" in line and "rightHint=(strategy=broadcast)" in line for line in plan.splitlines())


def test_entries_of_menus_are_read_from_a_table(spark, monkeypatch):
    made = {}
    monkeypatch.setattr(an, "analyze_items", lambda items, *a, **k: made.setdefault("items", items))
    monkeypatch.setattr(an, "project_result_row", lambda rows, keep: rows)
    lines = spark.createDataFrame([(1, 0, "Alpha Estate Merlot 2019 145"), (1, 1, "Beta House Blanc 16/28")], "menu_id int, line_no int, line string")
    an.analyze_menus(lines, None, None)
    plan = made["items"]._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and made["items"].count() == 2


def test_items_are_joined_once_with_what_their_texts_give(spark):
    from pourscale.operators import match as mt

    cat = spark.createDataFrame(
        [("w1", 1, "Castle House Red Anvil", "Castle House", "napa", "merlot", "red", 20.0, "value", ["anvil red"])],
        "id string, catalog_ordinal int, name string, producer string, region string, varietal string, wine_type string, avg_retail_price double, price_tier string, aliases array<string>",
    )
    market = spark.createDataFrame([("w1", 2015, 25.0, 20.0, 30.0, 15.0, "high")], "wine_id string, vintage int, avg_retail double, min_retail double, max_retail double, estimated_wholesale double, data_confidence string")
    items = spark.createDataFrame([(i, "Castle House, Red Anvil", 60.0 + i, 2015 if i % 2 else None) for i in range(6)], "item_id int, menu_text string, menu_price double, given_vintage int")
    out = an.analyze_items(items, mt.catalog_index(cat), market)
    got = {r["item_id"]: (r["wine_id"], float(r["avg_retail"]), r["price_source"], r["vintage"]) for r in out.collect()}
    assert got == {i: ("w1", 25.0, "market_live", 2015) if i % 2 else ("w1", 20.0, "catalog", None) for i in range(6)}
    # prices and products are joined to the texts, which are parsed before: the items meet one join
    plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    at = next(n for n, line in enumerate(plan) if "menu_price" in line and "LogicalRDD" in line or "LocalRelation" in line and "menu_price" in line)
    above = [line for n, line in enumerate(plan[:at]) if "Join" in line and depth(line) < min(depth(x) for x in plan[n + 1 : at + 1])]
    assert len(above) == 1 and "_tk" in above[0]
