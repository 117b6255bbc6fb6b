"""Readers and writers: catalogs, keyed JSON, menus, offers in JSON and HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pourscale import fixed_values as fv
from pourscale.functions import pricing as px
from pourscale.functions import text as tx
from pourscale.operators.catalog import derive_tier
from pourscale.sources.keyed_table import largest, update_table

CATALOG_SCHEMA = (
    "id string, name string, producer string, region string, country string, appellation string, varietal string, "
    "wine_type string, avg_retail_price decimal(10,2), price_tier string, aliases array<string>, description string, "
    "catalog_ordinal bigint"
)
ENTRY_SCHEMA = (
    "id string, name string, producer string, region string, country string, appellation string, varietal string, "
    "wine_type string, avg_retail_price double, aliases array<string>"
)


# ------------------------------------------------------------------ files
def read_catalog(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return derive_tier(spark.read.schema(CATALOG_SCHEMA).format(fmt).load(path))


def read_keyed_json(spark: SparkSession, path: str, value_schema: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """``{key: record}`` documents to rows (path, key, record), and the documents that are none (path, reason, text).

    A document is a file, or a line of one where ``lines`` is set. Documents that are empty, malformed or no object go
    to the second table; the others are read whole.
    """
    texts = spark.read.text(path, wholetext=not lines).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    variant = F.try_parse_json("text")
    reason = (
        F.when(F.trim("text") == "", "empty")
        .when(variant.isNull(), "malformed")
        .when(~F.startswith(F.schema_of_variant(variant), F.lit("OBJECT")), "not an object")
    )
    marked = texts.withColumn("reason", reason)
    good = marked.where("reason is null").drop("reason")
    return keyed_json_rows(good, F.col("text"), value_schema, ["path"]), marked.where("reason is not null").select("path", "reason", "text")


def keyed_json_rows(df: DataFrame, text: Column, value_schema: str, keep: list[str] | None = None) -> DataFrame:
    parsed = F.from_json(text, f"map<string, {value_schema}>", {"mode": "PERMISSIVE"})
    return df.select(*(keep or []), F.explode(parsed).alias("key", "record"))


def extended_catalog(rows: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Keyed catalog records with the defaults of missing fields, and the columns ``keep``."""
    r = lambda c, default="": F.coalesce(F.col(f"record.{c}"), F.lit(default)).alias(c)
    return derive_tier(
        rows.select(
            *(keep or []), F.coalesce("record.id", "key").alias("id"), r("name"), r("producer"), r("region"), r("country"),
            r("appellation"), r("varietal"), r("wine_type", "red"),
            F.coalesce("record.avg_retail_price", F.lit(0.0)).cast("decimal(10,2)").alias("avg_retail_price"),
            F.coalesce("record.aliases", F.array().cast("array<string>")).alias("aliases"),
        )
    )


def read_menus(spark: SparkSession, path: str) -> DataFrame:
    """One document per file: menu_id is the file path."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("menu_id"), F.col("value").alias("content")
    )


# ------------------------------------------------------------------ content types
def sniff_content_type(content_type: Column, url: Column, text: Column, head: int = 2000) -> Column:
    """pdf, image, html or text from the MIME type, the file ending, the first ``head`` characters."""
    mime = F.lower(F.coalesce(content_type, F.lit("")))
    path = F.lower(F.substring_index(url, "?", 1))
    ends = lambda *xs: F.regexp_like(path, F.lit(r"(?:" + "|".join(rf"\.{x}" for x in xs) + r")$"))
    start = F.lower(F.substring(text, 1, head))
    return (
        F.when(F.contains(mime, F.lit("pdf")) | ends("pdf"), "pdf")
        .when(F.startswith(mime, F.lit("image/")) | ends("jpg", "jpeg", "png", "webp"), "image")
        .when(F.contains(start, F.lit("<html")) | F.contains(start, F.lit("<body")), "html")
        .otherwise("text")
    )


def document_text(df: DataFrame, content_type: Column, url: Column, text: Column) -> DataFrame:
    kind = sniff_content_type(content_type, url, text)
    return df.withColumn("kind", kind).withColumn("content", F.when(F.col("kind") == "html", tx.html_to_text(text)).otherwise(text))


# ------------------------------------------------------------------ offers
_OFFER_KEYS = ["price", "listPrice", "salePrice", "priceValue", "Price", "AvgPrice", "avgprice", "ValuationPrice"]
# a map keeps keys that differ only in case apart
_OFFER = "map<string, string>"
_LISTS = ["products", "items", "results", "wines", "marketplaceArray", "offers", "prices", "search"]


def extract_offers_json(df: DataFrame, payload: Column, keep: list[str], band=fv.LISTING_PRICE_BAND) -> DataFrame:
    """Provider payloads to offer rows: first non-empty list, first price key that is a number."""
    parsed = F.from_json(payload, "struct<" + ", ".join(f"{k}: array<{_OFFER}>" for k in _LISTS) + ">")
    rows = F.coalesce(*[F.when(F.size(parsed[k]) > 0, parsed[k]) for k in _LISTS])
    out = df.select(*keep, F.posexplode(rows).alias("offer_no", "o"))
    at = lambda k: F.try_element_at("o", F.lit(k))
    price = F.coalesce(*[tx.money(at(k)) for k in _OFFER_KEYS + ["price-ebp"]])
    return out.select(
        *keep, "offer_no", F.round(price, 2).cast("decimal(12,2)").alias("price"),
        F.coalesce(at("vintage"), at("Vintage")).try_cast("int").alias("vintage"), at("ebp-unit").alias("unit"),
        at("merchant-name").alias("merchant"),
    ).where(F.col("price").between(*band))


_LD_OFFER = "map<string, string>"
_LD_ITEM = (
    "struct<`@type`: string, name: string, url: string, `@id`: string, offers: string, "
    "aggregateRating: struct<ratingValue: string, reviewCount: string, ratingCount: string>, itemListElement: string>"
)


def extract_offers_jsonld(df: DataFrame, html: Column, keep: list[str]) -> DataFrame:
    """JSON-LD products in a page: name, external id, price, rating, year.

    A block may be one product, a list, or an ItemList; offers may be one object
    or a list.  Blocks that are not JSON give nothing.  The year is the last one
    of the name: an earlier number of that form belongs to the name itself.
    """
    blocks = df.select(*keep, F.explode(F.regexp_extract_all(html, F.lit(fv.LD_BLOCK), 1)).alias("_b"))
    array_of = lambda c, t: F.when(F.startswith(F.ltrim(c), F.lit("[")), c).otherwise(F.concat(F.lit("["), c, F.lit("]")))
    tops = blocks.select(*keep, F.explode(F.from_json(array_of(F.col("_b"), None), f"array<{_LD_ITEM}>")).alias("t"))
    listed = F.when(
        F.col("t.`@type`") == "ItemList", F.from_json(F.col("t.itemListElement"), f"array<{_LD_ITEM}>")
    ).otherwise(F.array("t"))
    items = tops.select(*keep, F.explode(listed).alias("i"))
    offers = F.from_json(array_of(F.col("i.offers"), None), f"array<{_LD_OFFER}>")
    first = F.get(offers, F.lit(0))
    price = tx.money(F.coalesce(F.try_element_at(first, F.lit("price")), F.try_element_at(first, F.lit("lowPrice"))))
    name = F.trim("i.name")
    url = F.coalesce("i.url", "i.`@id`")
    ext = F.regexp_extract(url, r"/wines/(\d+)", 1)
    return items.select(
        *keep, name.alias("name"), ext.alias("external_id"), F.round(price, 2).cast("decimal(12,2)").alias("price"),
        F.col("i.aggregateRating.ratingValue").try_cast("double").alias("rating"),
        F.coalesce("i.aggregateRating.reviewCount", "i.aggregateRating.ratingCount").try_cast("int").alias("ratings_count"),
        F.try_element_at(F.regexp_extract_all(name, F.lit(r"\b((?:19|20)\d{2})\b"), 1), F.lit(-1)).cast("int").alias("vintage"),
        px.price_tier(F.coalesce(price, F.lit(0.0))).alias("price_tier"),
    ).where("name <> '' and external_id <> ''")


def extract_offers_html(df: DataFrame, html: Column, vintage: Column, keep: list[str]) -> DataFrame:
    """Name and price pairs of a product page; headings without link only when no linked one counts."""

    def pairs(pattern, name_group, price_group):
        names = F.regexp_extract_all(html, F.lit(pattern), name_group)
        prices = F.regexp_extract_all(html, F.lit(pattern), price_group)
        zipped = F.zip_with(
            names, prices, lambda n, p: F.struct(n.alias("name"), F.round(tx.money(p), 2).cast("decimal(12,2)").alias("price"))
        )
        named = lambda s: vintage.isNull() | F.contains(s["name"], vintage.cast("string"))
        return F.filter(zipped, lambda s: s["price"].between(*fv.RETAIL_PRICE_BAND) & named(s))

    linked = pairs(fv.LINKED_PRICE, 2, 3)
    out = df.withColumn("_linked", linked)
    chosen = F.when(F.size("_linked") > 0, F.col("_linked")).otherwise(pairs(fv.HEADED_PRICE, 1, 2))
    return out.select(*keep, F.posexplode(chosen).alias("offer_no", "_o")).select(*keep, "offer_no", "_o.*")


def extract_prices_html(df: DataFrame, html: Column, keep: list[str]) -> DataFrame:
    """Bare prices of a page: JSON-LD offers, else price attributes and price elements."""
    ld = extract_offers_jsonld_prices(html)
    groups = [F.regexp_extract_all(html, F.lit(fv.ATTRIBUTE_PRICE), i) for i in (1, 2, 3)]
    first = F.transform(
        F.arrays_zip(*[g.alias(f"g{i}") for i, g in enumerate(groups)]),
        lambda z: F.concat_ws("", z["g0"], z["g1"], z["g2"]),
    )
    attr = F.transform(first, lambda x: tx.money(x))
    out = df.withColumn("_ld", ld)
    chosen = F.when(F.size("_ld") > 0, F.col("_ld")).otherwise(attr)
    return out.select(*keep, F.posexplode(chosen).alias("offer_no", "_p")).select(
        *keep, "offer_no", F.round("_p", 2).cast("decimal(12,2)").alias("price")
    ).where(F.col("price").between(*fv.LISTING_PRICE_BAND))


def extract_offers_jsonld_prices(html: Column) -> Column:
    as_list = lambda c: F.when(F.startswith(F.ltrim(c), F.lit("[")), c).otherwise(F.concat(F.lit("["), c, F.lit("]")))
    blocks = F.regexp_extract_all(html, F.lit(fv.LD_BLOCK), 1)
    tops = F.flatten(F.transform(blocks, lambda b: F.coalesce(
        F.from_json(as_list(b), "array<struct<offers: string>>"), F.array().cast("array<struct<offers: string>>"))))
    offers = F.flatten(F.transform(tops, lambda t: F.coalesce(
        F.from_json(as_list(t["offers"]), f"array<{_LD_OFFER}>"), F.array().cast(f"array<{_LD_OFFER}>"))))
    prices = F.transform(offers, lambda o: tx.money(F.coalesce(F.try_element_at(o, F.lit("price")), F.try_element_at(o, F.lit("Price")))))
    return F.filter(prices, lambda p: p.isNotNull())


def parse_cards(df: DataFrame, text: Column, url: Column, keep: list[str]) -> DataFrame:
    """Result-card text blocks: name, price line, rating line, merchants, external id."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda l: F.trim(l)), lambda l: l != "")
    priced = F.filter("_l", lambda l: F.regexp_like(l, F.lit(fv.CARD_PRICE)))
    rated = F.filter("_l", lambda l: F.regexp_like(l, F.lit(r"^[1-4]\.[0-9]$")))
    anywhere = F.regexp_extract(text, r"[$€£¥]([\d,]+(?:\.\d{1,2})?)", 1)
    ext = F.coalesce(
        F.nullif(F.regexp_extract(url, r"/wines/(\d+)", 1), F.lit("")), F.nullif(F.regexp_extract(url, r"/w/(\d+)", 1), F.lit(""))
    )
    out = df.withColumn("_l", lines).where((F.length(F.trim(text)) >= 3) & (F.size("_l") > 0))
    return out.select(
        *keep,
        F.get("_l", F.lit(0)).alias("name"),
        F.coalesce(tx.money(F.regexp_replace(F.get(priced, F.lit(0)), "[€£¥]", "")), tx.money(anywhere)).alias("price"),
        F.get(rated, F.lit(0)).cast("double").alias("rating"),
        F.coalesce(F.nullif(F.regexp_extract(text, r"(?i)(\d+)\s+merchant", 1), F.lit("")).cast("int"), F.lit(1)).alias(
            "num_merchants"
        ),
        ext.alias("external_id"),
    )


# ------------------------------------------------------------------ sinks
def append_log(rows: DataFrame, path: str, batch: int) -> None:
    """Append the analysis rows of one batch, a directory per batch and day; a repeated batch replaces itself."""
    rows.withColumn("day", F.to_date("analyzed_at")).write.mode("overwrite").partitionBy("day").parquet(f"{path}/batch={batch}")


def write_price_table(prices: DataFrame, folder: str, batch: int) -> None:
    """Upserts prices (wine_id, price, fetched_at) into the price table: the latest of a product counts, of equal times the higher price.

    Readers of ``keyed_table.read_table`` see the table before the batch or after it; a repeated batch counts once.
    """
    update_table(prices, folder, batch, ["wine_id"], largest(["wine_id"], ["fetched_at", "price"]))
