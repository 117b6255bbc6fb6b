"""Menus whose lines lie together in one task: the entries of menus that are dealt out, without moving lines again."""

import random

import pytest
from pyspark.sql import functions as F

from pourscale import fixed_values as fv
from pourscale.checks import views as v
from pourscale.functions import text as tx
from pourscale.operators import menu as m
from pourscale.operators.skew import frequent


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(3)
    at = str(tmp_path_factory.mktemp("tables"))
    kinds, words = ["LARGE", "small", "Gran Cru", "x"], ["anvil", "ring", "hot", "bolt", "Gin", "blue", "napa"]
    parts = [(k, " ".join(r.sample(words, 2)), r.choice(kinds), r.randint(1, 50)) for k in range(40)]
    items = [(0 if r.random() < 0.4 else r.randint(1, 60), r.randint(0, 39), r.randint(0, 40), r.randint(1, 7), r.random() * 9000) for _ in range(900)]
    items += r.sample(items, 60) + [(None, 3, 1, 2, 50.0), (4, None, 1, 2, 50.0), (5, 7, None, 3, 50.0), (5, 7, 1, None, 50.0), (5, 7, 1, 3, None)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_type string, p_size int").write.parquet(f"{at}/part.parquet")
    spark.createDataFrame(items, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double").write.parquet(f"{at}/lineitem.parquet")
    return at


def rows(df):
    return sorted(map(str, df.select(sorted(c for c in df.columns if c not in (m.WHOLE, m.APART))).collect()))


def test_whole_and_dealt_menus_have_the_same_entries(spark, tables, monkeypatch):
    firsts = lambda lines: m.add_entry(m.candidates(m.with_sections(lines), m.first_candidates()))
    whole = v.menu_lines(spark, tables)
    assert m.WHOLE in whole.columns
    plain = whole.drop(m.WHOLE).localCheckpoint()
    made = rows(whole), rows(m.section_state(whole)), rows(m.dedupe_entries(firsts(whole))), rows(m.parse_menu(whole))
    assert made == (rows(plain), rows(m.section_state(plain)), rows(m.dedupe_entries(firsts(plain))), rows(m.parse_menu(plain)))
    assert len(made[3]) > 200
    monkeypatch.setattr(v, "TOGETHER", 100)
    monkeypatch.setattr(m, "BLOCK", 50)
    mixed = v.menu_lines(spark, tables)
    assert m.APART in mixed.columns and [r[0] for r in mixed.where(m.APART).select("menu_id").distinct().collect()] == [0]
    assert rows(mixed) == made[0] and rows(m.section_state(mixed)) == made[1] and rows(m.parse_menu(mixed)) == made[3]
    assert rows(m.dedupe_entries(firsts(mixed))) == made[2]


def test_lines_of_whole_menus_move_once(spark, tables):
    entries = m.parse_menu(v.menu_lines(spark, tables))
    plan = entries._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(menu_id") == 1 and plan.count("hashpartitioning(") == 1


def test_frequent_keys(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 300, 1).when(F.col("id") < 500, 2).when(F.col("id") < 600, None).otherwise(F.col("id")).alias("k"))
    assert [r[0] for r in frequent(df, "k", 100).collect()] == [1, 2]
    assert [r[0] for r in frequent(df, "k", 200).collect()] == [1]


def test_guarded_name_rules_equal_their_patterns(spark):
    r = random.Random(7)
    bits = ["Château", "gin", "GIN", "Virginia", "ale", "ſake", "by the glass", "B Y  T H E G L A S S", "b y the glass", "Half Bottle", "375ml", "٣ oz", "5 oz", "MAGNUMS",
            "1.5L", "bottle list", "irpinia, italy", "Napa, CA", "RED", "WHITE", "Wine  List", "Page 3", "12", "1) ", "12. ", "NV", "N.V.", "2019", "2019 2019", " - ", "–", ",", " ", "\t", "\n",
            "BİN", "ABC", "é", "'", "x"]
    texts = [("".join(r.choice(bits) + r.choice(["", " "]) for _ in range(r.randint(0, 4))),) for _ in range(6000)] + [(None,)]
    d = spark.createDataFrame(texts, "t string").repartition(4).cache()
    t, has = F.col("t"), lambda p: F.regexp_like(F.col("t"), F.lit(p))
    letters = F.regexp_replace(t, r"[^a-zA-Z]", "")
    name = F.trim(F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace(t, fv.BIN_NUMBER, ""), fv.TAIL_MARKS, "")), fv.LINE_YEAR_TAIL, ""))
    pairs = [
        (tx.is_header_line(t), has(fv.HEADER_LINE)), (tx.is_region_line(t), has(fv.REGION_LINE)),
        (tx.names_other_beverage(t), has(r"(?iU)\b(" + "|".join(fv.OTHER_BEVERAGES) + r")\b")),
        (tx.is_section_text(t), has(tx.any_of([fv.GLASS_HEADER, fv.HALF_HEADER, fv.MAGNUM_HEADER, fv.BOTTLE_HEADER]))),
        (tx.is_caps_dash(t), (letters != "") & (letters == F.upper(letters)) & has(r"[-–—]")),
        (m.entry_name(t), F.trim(F.regexp_replace(name, fv.LINE_YEAR_TWICE, "$1"))),
        (m.strip_vintage_inline(t), F.trim(F.regexp_replace(t, fv.LINE_YEAR_INLINE, ""))),
    ]
    for i, (quick, plain) in enumerate(pairs):
        bad = d.select("t", quick.alias("a"), plain.alias("b")).where("not (a <=> b)").collect()
        assert not bad, (i, bad[:5])
