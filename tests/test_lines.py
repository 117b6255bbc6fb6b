"""Line rules behind a cheap test, and prose rows: the same results as all rules on every line."""

import random

from pyspark.sql import functions as F

from pourscale import fixed_values as fv
from pourscale.functions import text as tx
from pourscale.operators import menu as m


def plain_clean(raw):
    """``clean_line`` without the test before it."""
    parts = F.filter(F.transform(F.split(raw, r"\|"), lambda p: F.trim(p)), lambda p: p != "")
    line = F.when(F.contains(raw, F.lit("|")), F.array_join(parts, " ")).otherwise(raw)
    line = tx.rewrite(line, [(fv.US_THOUSANDS, "$1$2"), (fv.EURO_THOUSANDS, "$1$2"), (fv.FILL, " "), (r"(?U)\s{2,}", " ")])
    for pattern in (r"(?U)^\s+|\s+$", fv.LEAD_MARKS, fv.ASK_TAIL):
        line = F.regexp_replace(line, pattern, "")
    line = F.regexp_replace(F.trim(line), fv.MARKET_TAIL, "")
    line = F.regexp_replace(F.trim(line), fv.CRITIC_SCORE, "")
    return F.regexp_replace(F.regexp_replace(F.trim(line), r"(?U)\s{2,}", " "), r"(?U)^\s+|\s+$", "")


def plain_marker(line):
    has = lambda p: F.regexp_like(line, F.lit(p))
    caps = (line == F.upper(line)) & F.length(line).between(3, 45) & ~has(fv.LINE_PRICE) & ~has(fv.DUAL_PRICE)
    named = F.when(has(fv.GLASS_HEADER), "glass").when(has(fv.HALF_HEADER), "half").when(has(fv.MAGNUM_HEADER), "magnum")
    return named.when(has(fv.BOTTLE_HEADER) | caps, "bottle")


def plain_mark(text):
    marks = F.regexp_extract_all(text, F.lit(fv.LINE_YEAR), 1)
    return F.replace(F.upper(F.try_element_at(marks, F.lit(-1))), F.lit("."), F.lit(""))


def plain_name(name):
    size = F.length(name)
    letters = F.length(F.regexp_replace(name, r"[^\p{L}\s]", ""))
    alpha = F.filter(F.split(name, r"\s+"), lambda w: F.regexp_like(w, F.lit(r"^\p{L}+$")))
    total = F.aggregate(alpha, F.lit(0), lambda acc, w: acc + F.length(w))
    ok = (
        (size >= 4) & ~F.regexp_like(name, F.lit(fv.BAD_MARKS)) & (letters / size >= 0.65) & (F.size(alpha) > 0)
        & (total >= 2.8 * F.size(alpha)) & F.exists(alpha, lambda w: F.length(w) >= 3)
    )
    return F.coalesce(ok, F.lit(False))


def test_guarded_rules_equal_all_rules(spark):
    r = random.Random(5)
    bits = ["Château", "Rouge", " ", "  ", " ", "\t", "|", "1,200", "1.250", "...", "._-", "•", "– ", "AQ", "mp", "ſea", "MarKet", "Price",
            "Market Price", "Upon Request", "TBD", "RP 95", "92pts", "92 Points", "90 / 100", "ST88", "2019", "NV", "n.v.", "12/18", "14/22/75",
            "$45", "5 oz", "by the glass", "B Y THE GLASS", "375 ml", "1.5L", "Magnums", "full bottle", "REDS", "'", ",", "é", "½", "٣٤ pts", "\n", "~"]
    rows = [(i, "".join(r.choice(bits) + r.choice(["", " "]) for _ in range(r.randint(0, 5)))) for i in range(6000)] + [(-1, None)]
    d = spark.createDataFrame(rows, "id int, t string").repartition(4).cache()
    for quick, plain in ((tx.clean_line, plain_clean), (m.section_marker, plain_marker), (m.line_vintage, plain_mark), (tx.looks_like_name, plain_name)):
        bad = d.select("t", quick(F.col("t")).alias("a"), plain(F.col("t")).alias("b")).where("not (a <=> b)").collect()
        assert not bad, (quick.__name__, bad[:5])


def test_prose_rows_repeat_no_expression(spark):
    """The expression that makes the name stands once in the plan, not once for every filter that reads it."""
    lines = spark.createDataFrame([(1, 0, "• Alpha House — Napa 2019 — $20/38"), (1, 1, "- Beta Court - Irpinia - $45"), (1, 2, "by the glass"), (1, 3, "Gamma Hall 2018 $16")], "menu_id int, line_no int, line string")
    out = m.parse_free_rows(lines)
    assert {(r["desc"], r["vintage"], float(r["menu_price"])) for r in out.collect()} == {
        ("Alpha House (by glass)", 2019, 100.0), ("Beta Court", None, 45.0), ("Gamma Hall (by glass)", 2018, 80.0)
    }
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?isU)^(.*?)") <= 2
