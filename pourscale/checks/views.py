"""Input views of the engine derived from the given tables, for Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pourscale.functions.pricing import price_tier
from pourscale.operators.menu import APART, WHOLE, number_lines, number_whole
from pourscale.operators.skew import frequent
from pourscale.session import dealt, spread

AS_OF = "2024-02-01 00:00:00"
STYLES = ["red", "white", "sparkling", "rose", "dessert"]
GRAPES = ["pinot noir", "cabernet sauvignon", "chardonnay", "riesling", "", "syrah", "chenin blanc"]
PLACES = [" Napa Valley", " Bordeaux", " Chablis Grand Cru", " Barolo"]
EXTRAS = [" Pinot N.", " Cab Sauv", " Chard", " Sparkling Brut"]
TRUSTED = "src0"


#: Items of a menu whose lines stay together in one task; the lines of larger menus are dealt out by blocks.
TOGETHER = 65536

#: Tables whose rows take much work each.
LARGE = ("lineitem", "documents", "pages", "events")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/{name}.parquet")
    return spread(rows) if name in LARGE else rows


def pick(options: list[str], i):
    return F.element_at(F.array(*[F.lit(o) for o in options]), (i + 1).cast("int"))


def cat(spark, sf) -> DataFrame:
    """Products from part, nation and region."""
    p, n, r = (table(spark, sf, t) for t in ("part", "nation", "region"))
    places = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey)  # 25 rows by definition
    kind = F.initcap("p_type")
    producer = (
        F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("Château "), kind))
        .when(F.col("p_size") % 4 == 1, F.concat(kind, F.lit(" Estate")))
        .otherwise(F.concat(kind, F.lit(" House")))
    )
    words = F.split("p_name", " ")
    base = cents(F.col("p_retailprice") / (1 + F.col("p_partkey") % 40))
    return (
        p.join(F.broadcast(places), F.col("p_partkey") % 25 == F.col("n_nationkey"))
        .select(
            F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"),
            F.col("p_partkey").alias("catalog_ordinal"),
            F.initcap("p_name").alias("name"),
            producer.alias("producer"),
            F.concat(F.col("n_name"), F.lit(", "), F.col("r_name")).alias("region"),
            F.col("n_name").alias("country"),
            F.col("r_name").alias("appellation"),
            pick(GRAPES, F.col("p_size") % 7).alias("varietal"),
            pick(STYLES, F.col("p_size") % 5).alias("wine_type"),
            base.alias("avg_retail_price"),
            F.array(F.concat_ws(" ", words[1], words[0])).alias("aliases"),
        )
        .withColumn("price_tier", price_tier(F.col("avg_retail_price")))
    )


def cents(x):
    """Whole cents of a number, rounded down: no ties that engines settle differently."""
    return (F.floor(x * 100).cast("decimal(16,2)") / 100).cast("decimal(12,2)")


def _unit_price():
    return cents(F.col("l_extendedprice") / F.col("l_quantity") / (1 + F.col("l_partkey") % 40))


def other_key(condition: str, other: str = "z"):
    """wine_id, or where the condition fails a key of its own that no product has: absent keys without dropped rows."""
    return F.when(F.expr(condition), F.col("wine_id")).otherwise(F.concat(F.lit(other), F.col("wine_id"))).alias("wine_id")


def offers(spark, sf) -> DataFrame:
    """Listings from lineitem."""
    li = table(spark, sf, "lineitem")
    return li.select(
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("wine_id"),
        F.concat(F.lit("src"), (F.col("l_suppkey") % 7).cast("string")).alias("source"),
        F.when(F.col("l_linenumber") % 3 != 0, F.year("l_shipdate")).alias("vintage"),
        _unit_price().alias("price"),
        F.when(F.col("l_linenumber") % 4 == 0, "1500ml").otherwise("750ml").alias("unit"),
        F.col("l_shipdate").cast("timestamp").alias("fetched_at"),
        "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey",
    )


def _with_parts(spark, sf, li: DataFrame) -> DataFrame:
    p = table(spark, sf, "part")
    kind = F.initcap("p_type")
    producer = (
        F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("Château "), kind))
        .when(F.col("p_size") % 4 == 1, F.concat(kind, F.lit(" Estate")))
        .otherwise(F.concat(kind, F.lit(" House")))
    )
    # texts are made once for each part, not for each of its lines
    parts = p.select("p_partkey", producer.alias("producer"), F.initcap("p_name").alias("name"))
    return li.join(parts, F.col("l_partkey") == F.col("p_partkey"))


def _item_parts(spark, sf, li: DataFrame | None = None) -> DataFrame:
    return (
        _with_parts(spark, sf, table(spark, sf, "lineitem") if li is None else li)
        .withColumn("price", _unit_price())
        .withColumn(
            "item_id", F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
        )
    )


def menu(spark, sf, li: DataFrame | None = None) -> DataFrame:
    """One priced item text per lineitem, or per row of ``li``, a part of it."""
    d = _item_parts(spark, sf, li)
    n, s = F.col("l_linenumber"), F.col("l_suppkey")
    year = F.when(n % 3 != 1, F.concat(F.year("l_shipdate").cast("string"), F.lit(" "))).otherwise("")
    lead = F.when(n == 6, "Ch. ").otherwise("")
    sep = F.when(s % 3 == 0, ",").otherwise(", ")
    place = F.when(s % 4 == 0, pick(PLACES, F.floor(s / 4) % 4)).otherwise("")
    tail = (
        F.when(n == 2, " NV").when(n == 3, " Magnum").when(n == 4, " 375ml")
        .when(n == 5, F.concat(F.lit(" $"), F.floor("price").cast("string")))
        .when(n == 7, pick(EXTRAS, s % 4)).otherwise("")
    )
    return d.select(
        "item_id", F.col("l_orderkey").alias("menu_id"), "l_linenumber", "l_suppkey", "l_partkey",
        F.concat(year, lead, F.col("producer"), sep, F.col("name"), place, tail).alias("menu_text"),
        F.col("price").alias("menu_price"),
        F.when(n == 1, F.year("l_shipdate")).alias("given_vintage"),
    )


def _line_items(li: DataFrame) -> DataFrame:
    """What the lines of an item are made of, without what else a lineitem holds."""
    amount = 1 + F.floor("l_extendedprice").cast("bigint") % 400
    return li.select(F.col("l_orderkey").alias("menu_id"), "l_partkey", "l_suppkey", "l_linenumber", amount.cast("int").alias("amount"))


def _item_lines(d: DataFrame) -> DataFrame:
    """The uncleaned menu text lines of items."""
    n, s, amount = F.col("l_linenumber"), F.col("l_suppkey"), F.col("amount")
    name = F.concat_ws(" ", "producer", "name")
    a = amount.cast("string")
    year = (1990 + F.col("l_partkey") % 30).cast("string")
    c = lambda *x: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in x])
    head = pick(["BY THE GLASS", "HALF BOTTLES", "MAGNUM", "REDS"], s % 4)
    single = (
        F.when(s % 5 == 1, c("• ", name, " ..... $", a))
        .when(s % 5 == 2, c(name, " | ", year, " | ", a))
        .when(s % 5 == 3, c(name, " ", (10 + amount % 40).cast("string"), " ", (40 + amount % 90).cast("string")))
        .when(s % 5 == 4, c(name, " ", year, " 92 pts 1,", (100 + amount % 400).cast("string")))
        .otherwise(c(name, " ", year, " ", a))
    )
    dual = c(name, " ", (5 + amount % 60).cast("string"), "/", (9 + amount % 95).cast("string"))
    triple = c(name, " ", (5 + amount % 20).cast("string"), "/", (15 + amount % 20).cast("string"), "/", (30 + amount % 70).cast("string"))
    body = (
        F.when(n % 5 == 0, F.array(single))
        .when(n % 5 == 1, F.array(dual))
        .when(n % 5 == 2, F.array(triple))
        .when(n % 5 == 3, F.array(name, c(year, " ", a)))
        .otherwise(F.array(c(name, ","), F.when(s % 2 == 0, "Napa Valley, California").otherwise("irpinia, italy"), a))
    )
    lines = F.when(n % 7 == 0, F.concat(F.array(head), body)).otherwise(body)
    return d.select("menu_id", "l_partkey", "l_suppkey", "l_linenumber", F.posexplode(lines).alias("sub_no", "raw"))


def raw_lines(spark, sf) -> DataFrame:
    """Menu text lines of every order, in menu order, uncleaned."""
    return _item_lines(_with_parts(spark, sf, _line_items(table(spark, sf, "lineitem"))))


def lines(spark, sf) -> DataFrame:
    """Numbered, cleaned menu lines."""
    return menu_lines(spark, sf).drop(WHOLE, APART)


def menu_lines(spark, sf) -> DataFrame:
    """Numbered, cleaned menu lines, and whether those of their menu are dealt out."""
    from pourscale.functions.text import clean_line, finished

    def clean(d: DataFrame) -> DataFrame:
        return finished(_item_lines(d), line=clean_line(F.col("raw"))).where("line != ''").drop("raw")

    order = ["l_partkey", "l_suppkey", "l_linenumber", "sub_no"]
    given = spark.read.parquet(f"{sf}/lineitem.parquet")
    large = [r[0] for r in frequent(given.select(F.col("l_orderkey").alias("menu_id")), "menu_id", TOGETHER).collect()]  # MOST at most
    items = _line_items(table(spark, sf, "lineitem")).where("menu_id is not null")
    apart = F.col("menu_id").isin(large)
    # items travel to their menu, lines are made there: they hold the names of their items more than once
    whole = dealt(_with_parts(spark, sf, items.where(~apart) if large else items), given, "menu_id")
    whole = number_whole(clean(whole), "menu_id", order).select("menu_id", "line_no", "line", WHOLE)
    if not large:
        return whole
    parted = number_lines(clean(_with_parts(spark, sf, items.where(apart))), "menu_id", F.floor(F.col("l_partkey") / 64), order)
    parted = parted.select("menu_id", "line_no", "line").withColumn(APART, F.lit(True))
    return whole.drop(WHOLE).withColumn(APART, F.lit(False)).unionByName(parted)


def pipe_lines(spark, sf) -> DataFrame:
    """``NAME | VINTAGE | PRICE | GLASS`` rows, one per lineitem."""
    d = _item_parts(spark, sf)
    n, s = F.col("l_linenumber"), F.col("l_suppkey")
    amount = 1 + F.floor("l_extendedprice").cast("bigint") % 400
    mark = F.when(n % 4 == 0, "NV").when(n % 4 == 1, "none").otherwise(F.year("l_shipdate").cast("string"))
    money = (
        F.when(s % 5 == 0, F.concat(F.lit("$"), amount.cast("string")))
        .when(s % 5 == 1, F.concat_ws("/", amount.cast("string"), (amount + 15).cast("string")))
        .when(s % 5 == 2, F.concat_ws("/", *[(amount + k).cast("string") for k in (0, 10, 40)]))
        .when(s % 5 == 3, F.concat(F.lit("1,"), (100 + amount).cast("string")))
        .otherwise("MP")
    )
    tail = F.when(n % 3 == 0, " | glass").otherwise("")
    return d.select(
        F.col("l_orderkey").alias("menu_id"),
        (F.col("l_partkey") * 1_000_000 + F.col("l_suppkey") * 10 + n).alias("line_no"),
        F.concat(F.lit("- "), F.col("producer"), F.lit(" "), F.col("name"), F.lit(" | "), mark, F.lit(" | "), money, tail).alias("line"),
    )


def free_lines(spark, sf) -> DataFrame:
    """Bulleted prose rows of every order."""
    d = _item_parts(spark, sf)
    n, s = F.col("l_linenumber"), F.col("l_suppkey")
    amount = 1 + F.floor("l_extendedprice").cast("bigint") % 400
    year = (1990 + F.col("l_partkey") % 30).cast("string")
    c = lambda *x: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in x])
    body = (
        F.when(s % 4 == 0, c("• ", F.col("producer"), " ", F.col("name"), " — Napa, California ", year, " — $", amount.cast("string"), "/", (amount + 20).cast("string")))
        .when(s % 4 == 1, c("- ", F.col("producer"), " ", F.col("name"), " - Irpinia - $", amount.cast("string")))
        .when(s % 4 == 2, c(F.col("producer"), " ", F.col("name"), " ", year, " $", (10 + amount).cast("string")))
        .otherwise(c("* ", F.col("name"), " (5 oz) — $", (6 + amount % 30).cast("string"), "/", (20 + amount % 30).cast("string"), "/", (60 + amount % 30).cast("string")))
    )
    arr = F.when(n == 7, F.array(pick(["Red (5oz/9oz)", "Wines by the bottle"], s % 2), body)).otherwise(F.array(body))
    raw = d.select(
        F.col("l_orderkey").alias("menu_id"), "l_partkey", "l_suppkey", "l_linenumber", F.posexplode(arr).alias("sub_no", "line")
    )
    numbered = number_lines(
        raw, "menu_id", F.floor(F.col("l_partkey") / 64), ["l_partkey", "l_suppkey", "l_linenumber", "sub_no"]
    )
    return numbered.select("menu_id", "line_no", "line")


def docs(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("menu_id"), F.col("text").alias("content"))


def html(spark, sf) -> DataFrame:
    """Pages with an appended product block."""
    p = table(spark, sf, "pages")
    i = F.col("page_id")
    t = lambda x: x.cast("string")
    c = lambda *x: F.concat(*[q if not isinstance(q, str) else F.lit(q) for q in x])
    block = c(
        '<script type="application/ld+json">{"@type":"Product","name":"House ', t(i), " ", t(1990 + i % 30),
        '","url":"https://shop.example/wines/', t(i), '","offers":', F.when(i % 3 == 0, "[").otherwise(""),
        '{"price":"', F.when(i % 5 == 0, "1,").otherwise(""), t(100 + i % 700), '.50"}', F.when(i % 3 == 0, "]").otherwise(""),
        ',"aggregateRating":{"ratingValue":"4.', t(i % 10), '","reviewCount":"', t(i % 90), '"}}</script>',
        F.when(i % 2 == 0, c('<a href="/products/', t(i), '"><h2 class="x">Linked ', t(1990 + i % 30), "</h2></a>")).otherwise(
            c("<h3>Headed bottle ", t(1990 + i % 30), "</h3>")
        ),
        "<p>$", F.when(i % 7 == 0, "2,").otherwise(""), t(100 + i % 800), ".25</p>",
        '<span data-price="', t(3 + i % 60), '.5"></span>',
    )
    return p.select("page_id", "url", "html", F.concat("html", block).alias("shop_html"))


def events(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    return event_columns(e)


def event_columns(e: DataFrame) -> DataFrame:
    return e.select(
        "event_id",
        F.col("user_id").alias("job_id"),
        F.get_json_object("props", "$.k").alias("wine_id"),
        cents(F.col("value")).alias("price"),
        F.col("event_type").alias("kind"),
        F.col("ts").cast("timestamp").alias("seen_at"),
        "props",
    )


def pairs(spark, sf) -> DataFrame:
    """Distinct (a, b): mutated product names against the name of another product."""
    li, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    a = p.select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("a0"), F.col("p_type").alias("t0"))
    b = p.select(F.col("p_partkey").alias("l_suppkey"), F.col("p_name").alias("b"))
    w = F.split("a0", " ")
    n = F.col("l_linenumber") % 4
    mutated = (
        F.when(n == 1, F.concat(F.substring("a0", 1, 1), F.substring("a0", 3, 100)))
        .when(n == 2, F.concat_ws(" ", w[1], w[0]))
        .when(n == 3, F.concat_ws(" ", "a0", F.lower("t0"), F.lit("house")))
        .otherwise(F.col("a0"))
    )
    return (
        li.select("l_partkey", "l_suppkey", "l_linenumber").join(a, "l_partkey").join(b, "l_suppkey")
        .select(mutated.alias("a"), "b").distinct()
    )
