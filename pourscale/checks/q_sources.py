"""Queries of readers and extractors."""

from pyspark.sql import functions as F

from pourscale.checks import sql as s, views as v
from pourscale.checks.registry import register
from pourscale.functions import text as tx
from pourscale.operators import catalog as c
from pourscale.plans.analyze import validate_requests
from pourscale.session import work_folder
from pourscale.sources import readers as rd

V = s.VIEWS
V["keyed"] = (["ev"], """SELECT event_id, kind, price, wine_id, CASE WHEN event_id % 11 = 0 THEN '{broken' ELSE
    '{"' || wine_id || '":{"id":"w' || wine_id || '","name":"' || kind || '","avg_retail_price":' || price || '},"k' || event_id || '":{"name":"only"}}' END AS doc FROM ev""")


def keyed(spark, sf):
    e = v.events(spark, sf)
    doc = F.concat(
        F.lit('{"'), "wine_id", F.lit('":{"id":"w'), "wine_id", F.lit('","name":"'), "kind", F.lit('","avg_retail_price":'),
        F.col("price").cast("string"), F.lit(',"event_id":'), F.col("event_id").cast("string"), F.lit('},"k'), F.col("event_id").cast("string"),
        F.lit('":{"name":"only","event_id":'), F.col("event_id").cast("string"), F.lit("}}"),
    )
    return e.withColumn("doc", F.when(F.col("event_id") % 11 == 0, "{broken").otherwise(doc))


@register("scan_keyed_json", s.q("keyed", f"""SELECT event_id, 'w' || wine_id AS id, kind AS name, 'red' AS wine_type, price AS avg_retail_price, {s.tier('price')} AS price_tier FROM keyed WHERE event_id % 11 <> 0
    UNION ALL SELECT event_id, 'k' || event_id, 'only', 'red', CAST(0 AS DECIMAL(12,2)), 'budget' FROM keyed WHERE event_id % 11 <> 0"""))
def _(spark, sf):
    rows, _ = keyed_files(spark, sf)
    return rd.extended_catalog(rows, ["record.event_id"]).select("event_id", "id", "name", "wine_type", "avg_retail_price", "price_tier")


@register("keyed_json_rejects", s.q("keyed", "SELECT 'malformed' AS reason, doc AS text, count(*) AS n FROM keyed WHERE event_id % 11 = 0 GROUP BY doc"))
def _(spark, sf):
    return keyed_files(spark, sf)[1].groupBy("reason", "text").agg(F.count(F.lit(1)).alias("n"))


def keyed_files(spark, sf):
    """The documents written as text files and read back: rows and rejected documents."""
    folder = work_folder(spark, "keyed")
    keyed(spark, sf).select("doc").write.text(folder)
    return rd.read_keyed_json(spark, folder, f"struct<{_struct(rd.ENTRY_SCHEMA)}, event_id: bigint>", lines=True)


def _struct(ddl):
    return ", ".join(f"{p.split(' ')[0]}: {p.split(' ', 1)[1]}" for p in ddl.split(", "))


@register("json_to_rows", s.q("ev", "SELECT event_id, 'k' AS key, CAST(json_extract_string(props, '$.k') AS BIGINT) AS val FROM ev"))
def _(spark, sf):
    return v.events(spark, sf).select("event_id", F.explode(F.from_json("props", "map<string,bigint>")).alias("key", "val"))


_ENT = "CASE WHEN page_id % 2 = 0 THEN '<p>Ch&acirc;teau &#8211; A&#x26;B &unknown; x</p>' ELSE '' END"


def _decoded(t):
    for name, ch in (("&acirc;", "â"), ("&copy;", "©"), ("&middot;", "·"), ("&#8211;", "–"), ("&#x26;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        t = f"replace({t}, '{name}', '{ch}')"
    return t


def html_sql(h):
    out = s.sub(h, r"(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>", "")
    out = s.sub(out, r"(?i)<(?:br|p|div|tr|li|h[1-6]|section|article)[^/>]*/?>", "\n")
    out = s.sub(out, r"(?i)</(?:p|div|tr|li|h[1-6]|section|article)>", "\n")
    out = _decoded(s.sub(out, r"<[^>]+>", " "))
    out = s.sub(s.sub(out, r"[ \t]+", " "), r"\n[ \t]*\n+", "\n")
    return s.sub(out, r"^\s+|\s+$", "")


@register("scan_html_text", s.q("html", f"SELECT page_id, {html_sql('html || ' + _ENT)} AS content FROM html"))
def _(spark, sf):
    extra = F.when(F.col("page_id") % 2 == 0, "<p>Ch&acirc;teau &#8211; A&#x26;B &unknown; x</p>").otherwise("")
    return v.html(spark, sf).select("page_id", tx.html_to_text(F.concat("html", extra)).alias("content"))


_MIME = "CASE page_id % 6 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/png' ELSE '' END"
_URL = "url || CASE page_id % 6 WHEN 2 THEN '/list.PDF' WHEN 3 THEN '/menu.jpeg?x=1' ELSE '' END"


@register("sniff_content_type", s.q("html", f"""SELECT page_id, CASE WHEN contains(m, 'pdf') OR u LIKE '%.pdf' THEN 'pdf' WHEN m LIKE 'image/%' OR regexp_matches(u, '\\.(jpg|jpeg|png|webp)$') THEN 'image'
    WHEN contains(lower(left(t, 2000)), '<html') OR contains(lower(left(t, 2000)), '<body') THEN 'html' ELSE 'text' END AS kind
  FROM (SELECT page_id, {_MIME} AS m, lower(split_part({_URL}, '?', 1)) AS u, CASE WHEN page_id % 4 = 0 THEN 'plain text' ELSE html END AS t FROM html)"""))
def _(spark, sf):
    i = F.col("page_id")
    mime = F.when(i % 6 == 0, "application/pdf").when(i % 6 == 1, "image/png").otherwise("")
    url = F.concat("url", F.when(i % 6 == 2, "/list.PDF").when(i % 6 == 3, "/menu.jpeg?x=1").otherwise(""))
    text = F.when(i % 4 == 0, "plain text").otherwise(F.col("html"))
    return v.html(spark, sf).select("page_id", rd.sniff_content_type(mime, url, text).alias("kind"))


@register("extract_offers_json", s.q("ev", f"""SELECT event_id, CAST(0 AS INTEGER) AS offer_no, CAST(round(price, 2) AS DECIMAL(12,2)) AS price, CASE WHEN event_id % 3 = 1 THEN 2001 END AS vintage, CASE WHEN event_id % 3 = 2 THEN '750ml' END AS unit FROM ev WHERE price BETWEEN 5 AND 50000
    UNION ALL SELECT event_id, 1, CAST(1250.5 AS DECIMAL(12,2)), NULL, NULL FROM ev WHERE event_id % 3 = 0"""))
def _(spark, sf):
    e, p = F.col("event_id"), F.col("price").cast("string")
    c = lambda *x: F.concat(*[q if not isinstance(q, str) else F.lit(q) for q in x])
    payload = (
        F.when(e % 3 == 0, c('{"products":[{"price":null,"listPrice":"$', p, '"},{"salePrice":"1,250.50"},{"price":"ask"}]}'))
        .when(e % 3 == 1, c('{"products":[],"results":[{"price":"', p, '","vintage":"2001"}]}'))
        .otherwise(c('{"marketplaceArray":[{"price-ebp":"', p, '","ebp-unit":"750ml"}]}'))
    )
    rows = rd.extract_offers_json(v.events(spark, sf).withColumn("payload", payload), F.col("payload"), ["event_id"])
    return rows.select("event_id", "offer_no", "price", "vintage", "unit")


@register("extract_offers_jsonld", s.q("html", f"""SELECT page_id, 'House ' || page_id || ' ' || (1990 + page_id % 30) AS name, CAST(page_id AS VARCHAR) AS external_id, pr AS price, CAST('4.' || (page_id % 10) AS DOUBLE) AS rating,
    CAST(page_id % 90 AS INTEGER) AS ratings_count, CAST(1990 + page_id % 30 AS INTEGER) AS vintage, {s.tier('pr')} AS price_tier
  FROM (SELECT page_id, CAST((CASE WHEN page_id % 5 = 0 THEN 1000 ELSE 0 END) + 100 + page_id % 700 + 0.5 AS DECIMAL(12,2)) AS pr FROM html)"""))
def _(spark, sf):
    return rd.extract_offers_jsonld(v.html(spark, sf), F.col("shop_html"), ["page_id"])


@register("extract_offers_html", s.q("html", """SELECT page_id, 0 AS offer_no, CASE WHEN page_id % 2 = 0 THEN 'Linked ' ELSE 'Headed bottle ' END || (1990 + page_id % 30) AS name,
    CAST((CASE WHEN page_id % 7 = 0 THEN 2000 ELSE 0 END) + 100 + page_id % 800 + 0.25 AS DECIMAL(12,2)) AS price FROM html WHERE page_id % 4 <> 1"""))
def _(spark, sf):
    wanted = F.when(F.col("page_id") % 4 == 1, 1900).when(F.col("page_id") % 4 == 2, 1990 + F.col("page_id") % 30)
    return rd.extract_offers_html(v.html(spark, sf), F.col("shop_html"), wanted, ["page_id"])


@register("extract_prices_html", s.q("html", """SELECT page_id, CAST(CASE WHEN page_id % 3 = 0 THEN (CASE WHEN page_id % 5 = 0 THEN 1000 ELSE 0 END) + 100 + page_id % 700 + 0.5 ELSE 3 + page_id % 60 + 0.5 END AS DECIMAL(12,2)) AS price FROM html WHERE page_id % 3 = 0 OR 3 + page_id % 60 + 0.5 >= 5"""))
def _(spark, sf):
    bare = F.regexp_replace("shop_html", r'(?s)<script type="application/ld\+json">.*?</script>', "")
    page = F.when(F.col("page_id") % 3 == 0, F.col("shop_html")).otherwise(bare)
    rows = rd.extract_prices_html(v.html(spark, sf).withColumn("page", page), F.col("page"), ["page_id"])
    return rows.select("page_id", "price")


@register("parse_cards", s.q("cat", """SELECT id, producer || ' ' || name AS name, CASE WHEN catalog_ordinal % 4 = 3 THEN NULL ELSE CAST(avg_retail_price AS DOUBLE) END AS price, CASE WHEN catalog_ordinal % 3 > 0 THEN CAST((catalog_ordinal % 4 + 1) || '.' || (catalog_ordinal % 10) AS DOUBLE) END AS rating,
    CASE WHEN catalog_ordinal % 2 = 0 THEN 7 ELSE 1 END AS num_merchants, CAST(catalog_ordinal + 10 AS VARCHAR) AS external_id FROM cat"""))
def _(spark, sf):
    o = F.col("catalog_ordinal")
    p = F.col("avg_retail_price").cast("string")
    price = F.when(o % 4 == 0, F.concat(F.lit("$"), p)).when(o % 4 == 1, F.concat(p, F.lit(" €"))).when(o % 4 == 2, F.concat(F.lit("from $"), p)).otherwise("")
    rating = F.when(o % 3 > 0, F.concat((o % 4 + 1).cast("string"), F.lit("."), (o % 10).cast("string"))).otherwise("n/a")
    shop = F.when(o % 2 == 0, "7 merchants").otherwise("")
    text = F.concat_ws("\n", F.concat_ws(" ", "producer", "name"), "region", rating, F.lit("(88 ratings)"), price, shop)
    url = F.concat(F.lit("https://x.example"), F.when(o % 2 == 0, "/wines/").otherwise("/w/"), (o + 10).cast("string"))
    return rd.parse_cards(v.cat(spark, sf), text, url, ["id"])


@register("validate_request_rows", s.q("menu", """SELECT item_id, CASE WHEN length(t) < 2 THEN 'text_too_short' WHEN length(t) > 500 THEN 'text_too_long' WHEN p <= 0 THEN 'price_not_positive'
    WHEN NOT y BETWEEN 1900 AND 2030 THEN 'vintage_out_of_range' ELSE 'ok' END AS reason
  FROM (SELECT item_id, CASE l_linenumber WHEN 1 THEN 'x' WHEN 2 THEN repeat(menu_text, 30) ELSE menu_text END AS t, CASE WHEN l_linenumber = 3 THEN -menu_price ELSE menu_price END AS p, CASE WHEN l_linenumber = 4 THEN 2031 ELSE given_vintage END AS y FROM menu)"""))
def _(spark, sf):
    n = F.col("l_linenumber")
    rows = v.menu(spark, sf).select(
        "item_id", F.when(n == 1, "x").when(n == 2, F.repeat("menu_text", 30)).otherwise(F.col("menu_text")).alias("menu_text"),
        F.when(n == 3, -F.col("menu_price")).otherwise(F.col("menu_price")).alias("menu_price"),
        F.when(n == 4, 2031).otherwise(F.col("given_vintage")).alias("given_vintage"),
    )
    good, bad = validate_requests(rows)
    return good.select("item_id", F.lit("ok").alias("reason")).unionByName(bad.select("item_id", "reason"))
