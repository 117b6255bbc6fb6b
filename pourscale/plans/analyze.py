"""The whole analysis of a table of items, built as one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pourscale.functions import pricing as px
from pourscale.operators.estimates import effective_price, real_source_filter, regional_estimate
from pourscale.operators.markup import analyze_markup
from pourscale.operators.menu import parse_menu
from pourscale.operators.match import item_texts, join_texts, match_key, match_texts, query_profiles, text_key
from pourscale.session import staged

_LIVE = {"avg_retail": "live_avg", "min_retail": "live_min", "max_retail": "live_max",
         "estimated_wholesale": "live_wholesale", "price_tier": "live_tier", "num_listings": "live_listings"}
_EST = ["est_avg", "est_min", "est_max", "est_wholesale", "est_tier", "est_source", "est_note"]


def identify_items(parsed: DataFrame, index: DataFrame, top_k: int = 5, gate: str = "strict") -> DataFrame:
    """Best product of every parsed item (null when none) with the alternatives as an array."""
    per_text = match_texts(query_profiles(parsed), index, top_k, gate).select(
        "_mk",
        F.col("matches")[0]["wine_id"].alias("wine_id"),
        F.round(F.col("matches")[0]["score"], 4).alias("confidence"),
        F.col("matches")[0]["confidence_level"].alias("confidence_level"),
        F.transform(F.slice("matches", 2, top_k), lambda m: m["wine_id"]).alias("alternatives"),
    )
    keyed = parsed.withColumn("_mk", text_key(match_key(parsed)))
    return keyed.join(per_text, "_mk", "left").drop("_mk")


def pin_products(parsed: DataFrame, catalog: DataFrame, pinned: str = "pinned_id") -> tuple[DataFrame, DataFrame]:
    """Items whose given product id exists (they skip matching), and the rest."""
    known = catalog.select(F.col("id").alias(pinned))
    given = parsed.where(F.col(pinned).isNotNull())
    hit = given.join(known, pinned, "left_semi").withColumns(
        {
            "wine_id": F.col(pinned), "confidence": F.lit(1.0), "confidence_level": F.lit("very_high"),
            "alternatives": F.array().cast("array<string>"),
        }
    )
    rest = parsed.where(F.col(pinned).isNull()).unionByName(given.join(known, pinned, "left_anti"))
    return hit, rest


_MARKET = {"avg_retail": "mk_avg", "min_retail": "mk_min", "max_retail": "mk_max", "estimated_wholesale": "mk_wholesale", "data_confidence": "mk_confidence"}


def product_prices(market: DataFrame) -> DataFrame:
    """A row for each product: its price without a year, and those by year as a map of as many entries as it has years."""
    if "vintage" not in market.columns:
        market = market.withColumn("vintage", F.lit(None).cast("int"))
    price, year = F.struct(*(F.col(a).alias(b) for a, b in _MARKET.items())), F.col("vintage").cast("int")
    known = market.where("avg_retail is not null").select("wine_id", year.alias("vintage"), price.alias("price"))
    known = known.groupBy("wine_id", "vintage").agg(F.min("price").alias("price"))
    dated = F.when(F.col("vintage").isNotNull(), F.struct("vintage", "price"))
    return known.groupBy("wine_id").agg(
        F.map_from_entries(F.collect_list(dated)).alias("_by_year"), F.max(F.when(F.col("vintage").isNull(), F.col("price"))).alias("_generic")
    )


def price_of_year(items: DataFrame) -> DataFrame:
    """Items (vintage, and the columns of ``product_prices``) with the price of their year, else the one without a year."""
    exact = F.when(F.col("vintage").isNotNull(), F.try_element_at("_by_year", F.coalesce("vintage", F.lit(0))))
    out = items.withColumn("_price", F.coalesce(exact, "_generic"))
    match = F.when(exact.isNotNull(), "vintage").when(F.col("_generic").isNotNull(), "generic")
    return out.select(*items.drop("_by_year", "_generic").columns, match.alias("price_match"), "_price.*")


def analyze_items(
    items: DataFrame,
    index: DataFrame,
    market: DataFrame,
    live: DataFrame | None = None,
    lookups: dict[str, DataFrame] | None = None,
    include_estimates: bool = False,
    gate: str = "strict",
    top_k: int = 5,
) -> DataFrame:
    """Parse, match, price and score items (menu_text, menu_price, given_vintage [, pinned_id]).

    ``index``: ``catalog_index`` output.  ``market``: merged price per wine_id
    (``merge_sources``) or per wine_id and vintage (``merge_sources_by_year``): the
    item's year counts, else the row without a year.  ``live``: price per lower-case trimmed menu text.
    ``lookups``: reference, varietals, premiums, hints for the estimates.

    All but the markup depends on an item's text, year and product only: it is found once for each of these, and
    joined to the items in one step.
    """
    parsed = item_texts(items)
    if "pinned_id" in items.columns:
        hit, rest = pin_products(parsed, index)
        found = hit.unionByName(identify_items(rest, index, top_k, gate))
    else:
        found = identify_items(parsed, index, top_k, gate)
    found = found.withColumn("strong", F.coalesce(px.is_strong(F.col("confidence_level")), F.lit(False)))
    catalog = index.select(
        F.col("id").alias("wine_id"), F.col("name").alias("cat_name"), F.col("producer").alias("cat_producer"),
        F.col("region").alias("cat_region"), F.col("varietal").alias("cat_varietal"),
        F.col("avg_retail_price").alias("cat_price"), F.col("price_tier").alias("cat_tier"),
    )
    # one product table per id, joined once to the texts
    out = price_of_year(found.join(catalog.join(product_prices(market), "wine_id", "left"), "wine_id", "left"))
    if live is not None:
        side = live.select("lookup_id", *[F.col(a).alias(b) for a, b in _LIVE.items()])
        out = out.withColumn("lookup_id", F.lower(F.trim("menu_text"))).join(side, "lookup_id", "left").drop("lookup_id")
    else:
        out = out.withColumns({c: F.lit(None).cast("double") for c in _LIVE.values()})
        out = out.withColumn("live_tier", F.lit(None).cast("string"))
    if include_estimates:
        out = regional_estimate(out, **lookups)
    else:
        out = out.withColumns(
            {c: F.lit(None).cast("string" if c in ("est_tier", "est_source", "est_note") else "double") for c in _EST}
        )
    out = join_texts(items, effective_price(out, include_estimates))
    # the catalog's own price is shown but not scored: only observed prices make a markup
    scored = F.col("price_source") != "catalog"
    out = out.withColumns(
        {
            "_retail": F.when(scored, F.col("avg_retail")),
            "_wholesale": F.when(scored, F.col("estimated_wholesale")),
        }
    )
    return analyze_markup(out, retail="_retail", wholesale="_wholesale").drop("_retail", "_wholesale")


def project_result_row(analyzed: DataFrame, keep: list[str]) -> DataFrame:
    """Flat result row: product columns only for strong matches, prices only from real sources."""
    real = real_source_filter(analyzed)
    strong = F.col("strong")
    markup = F.when(F.col("avg_retail") != 0, F.col("menu_price").cast("double") / F.col("avg_retail").cast("double"))
    return real.select(
        *keep,
        F.col("menu_text").alias("raw_text"),
        "vintage",
        "menu_price",
        strong.alias("matched"),
        F.when(strong, F.col("cat_name")).alias("wine_name"),
        F.when(strong, F.col("cat_producer")).alias("producer"),
        F.when(strong, F.col("cat_region")).alias("region"),
        F.coalesce(F.when(strong, F.nullif(F.col("cat_varietal"), F.lit(""))), F.col("parsed_varietal")).alias("varietal"),
        F.col("avg_retail").alias("retail_price"),
        F.col("estimated_wholesale").alias("wholesale_est"),
        "min_retail",
        "max_retail",
        F.round(markup, 2).alias("markup"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("confidence_level", F.lit("none")).alias("confidence_level"),
        px.deal_rating(F.col("menu_price"), F.col("avg_retail")).alias("deal_rating"),
        "data_confidence",
        "price_source",
    )


def analyze_menus(lines: DataFrame, index: DataFrame, market: DataFrame, menu: str = "menu_id", **options) -> DataFrame:
    """From numbered menu lines (``scan_menu_text``) to result rows, one for every entry found.

    The entries are written once: the analysis reads them several times, and without that its plan would hold
    all passes over the lines as often, more than a driver can keep.
    """
    entries = staged(parse_menu(lines, menu).select(menu, "line_no", "step", "sub", "desc", "vintage", "menu_price"), "menu-entries")
    items = entries.select(
        menu, "line_no", "step", "sub", F.concat_ws("-", menu, "line_no", "step", "sub").alias("item_id"), F.col("desc").alias("menu_text"),
        F.col("menu_price").cast("decimal(12,2)").alias("menu_price"), F.col("vintage").try_cast("int").alias("given_vintage"),
    )
    return project_result_row(analyze_items(items, index, market, **options), [menu, "item_id"])


def unpriced(results: DataFrame) -> DataFrame:
    """Entries left without a price: the follow-up set."""
    return results.where("retail_price is null or retail_price = 0")


def menu_summary(results: DataFrame, menu: str = "menu_id") -> DataFrame:
    n = lambda cond: F.count_if(cond).cast("int")
    d = F.col("deal_rating")
    return results.groupBy(menu).agg(
        F.count(F.lit(1)).cast("int").alias("total_parsed"),
        n(F.col("matched")).alias("matched"),
        n(~F.col("matched")).alias("unmatched"),
        n(F.coalesce(F.col("retail_price") != 0, F.lit(False))).alias("with_price"),
        n(d == "steal").alias("steals"),
        n(d == "good").alias("good_deals"),
        n(d == "fair").alias("fair_deals"),
        n(d == "expensive").alias("expensive"),
    )


def validate_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests that meet the length and range rules, and the rest with a reason."""
    from pourscale import fixed_values as fv

    size = F.length("menu_text")
    reason = (
        F.when(F.col("menu_text").isNull() | (size < fv.TEXT_LENGTH[0]), "text_too_short")
        .when(size > fv.TEXT_LENGTH[1], "text_too_long")
        .when(F.col("menu_price") <= 0, "price_not_positive")
        .when(~F.col("given_vintage").between(*fv.VINTAGE_RANGE), "vintage_out_of_range")
    )
    marked = requests.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")
