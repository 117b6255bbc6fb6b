"""Fallback prices from reference tables, and the choice between price sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pourscale.functions import pricing as px
from pourscale.functions.text import expand_terms, lookup_key

# every key is found through its first characters
_HEAD = 3


# ------------------------------------------------------------------ contained keys
def first_contained(df: DataFrame, text: str, keys: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Add struct ``out``: the first row of ``keys`` (in ``order``) whose key is part of ``text``.

    The distinct texts meet the keys through the first characters of a key, an
    equi-join that finds every contained key, and are joined back.  Starts that no
    key has are dropped where they are made, before any of them is shuffled: the
    starts of the keys, three characters at most, are broadcast for that.
    """
    texts = df.select(text).distinct()
    # a key shorter than the head meets every start of its own length
    starts = lambda n: F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: F.substring(F.col(text), i, F.lit(n))
    )
    heads = F.array_distinct(F.flatten(F.array(*[starts(n) for n in range(1, _HEAD + 1)])))
    right = keys.withColumn("_h", F.substring("key", 1, _HEAD))
    left = texts.withColumn("_h", F.explode(heads)).join(F.broadcast(right.select("_h").distinct()), "_h", "left_semi")
    hits = left.join(right, "_h").where(F.contains(F.col(text), F.col("key")))
    w = Window.partitionBy(text).orderBy(*order)
    best = hits.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    return df.join(best.select(text, F.struct(*keys.columns).alias(out)), text, "left")


def longest_key_join(df: DataFrame, text: str, keys: DataFrame, out: str = "reference") -> DataFrame:
    return first_contained(df, text, keys, [F.desc(F.length("key")), F.asc("ordinal")], out)


def premium_join(df: DataFrame, text: str, premiums: DataFrame, out: str = "premium") -> DataFrame:
    """Highest multiplier above one among the houses named in the text."""
    return first_contained(df, text, premiums.where("multiplier > 1"), [F.desc("multiplier"), F.asc("ordinal")], out)


def hint_join(df: DataFrame, text: str, hints: DataFrame, out: str = "hint") -> DataFrame:
    return first_contained(df, text, hints, [F.asc("ordinal")], out)


# ------------------------------------------------------------------ regional estimate
def regional_estimate(
    parsed: DataFrame, reference: DataFrame, varietals: DataFrame, premiums: DataFrame, hints: DataFrame,
    text: str = "menu_text",
) -> DataFrame:
    """Estimate per parsed item; columns are null when nothing fits.

    Cascade: exact key (region, grape, both, champagne for sparkling), longest
    key inside the parsed and raw text plus a hinted phrase, grape alone; then
    the house multiplier.  Each distinct text with its parsed columns is estimated
    once, and the estimates are joined to the items in one step.
    """
    given = [text, "parsed_region", "parsed_varietal", "parsed_type"]
    made = _estimates(parsed.select(*given).distinct(), reference, varietals, premiums, hints, text)
    made = made.select(F.struct(*given).alias("_of"), *[c for c in made.columns if c not in given])
    return parsed.withColumn("_as", F.struct(*given)).join(made, F.col("_as") == F.col("_of"), "left").drop("_as", "_of")


def _estimates(
    parsed: DataFrame, reference: DataFrame, varietals: DataFrame, premiums: DataFrame, hints: DataFrame, text: str
) -> DataFrame:
    """``regional_estimate`` of rows of a text and its parsed columns."""
    blank = lambda c: F.coalesce(F.lower(F.trim(F.col(c))), F.lit(""))
    region, grape = blank("parsed_region"), blank("parsed_varietal")
    raw = lookup_key(expand_terms(F.col(text)))
    df = parsed.withColumns(
        {
            "_k0": F.when(region != "", region),
            "_k1": F.when(grape != "", grape),
            "_k2": F.when((region != "") & (grape != ""), F.concat_ws(" ", region, grape)),
            "_k3": F.when(F.col("parsed_type") == "sparkling", "champagne"),
            "_raw": raw,
            "_plain": lookup_key(F.col(text)),
        }
    )
    df = hint_join(df, "_raw", hints, "_hint").withColumn(
        "_text",
        F.concat_ws(" ", F.nullif(lookup_key(F.concat_ws(" ", region, grape)), F.lit("")), "_raw", "_hint.implied"),
    )
    df = longest_key_join(df, "_text", reference, "_contained")
    row = lambda prefix: F.struct(*[F.col(f"{prefix}{c}").alias(c) for c in ("key", "low", "mid", "high")])
    for i in range(4):
        side = reference.select(*[F.col(c).alias(f"_e{i}{c}") for c in ("key", "low", "mid", "high")])
        df = df.join(side, lookup_key(F.col(f"_k{i}")) == F.col(f"_e{i}key"), "left")
    side = varietals.select(*[F.col(c).alias(f"_v{c}") for c in ("key", "low", "mid", "high")])
    df = df.join(side, lookup_key(F.col("_k1")) == F.col("_vkey"), "left")

    stage = F.coalesce(
        *[F.when(F.col(f"_e{i}key").isNotNull(), f"exact_{i}") for i in range(4)],
        F.when(F.col("_contained").isNotNull(), "contained"),
        F.when(F.col("_vkey").isNotNull(), "varietal"),
    )
    inside = F.struct(*[F.col(f"_contained.{c}").alias(c) for c in ("key", "low", "mid", "high")])
    chosen = F.coalesce(
        *[F.when(F.col(f"_e{i}key").isNotNull(), row(f"_e{i}")) for i in range(4)],
        F.when(F.col("_contained").isNotNull(), inside),
        F.when(F.col("_vkey").isNotNull(), row("_v")),
    )
    label = F.coalesce(*[F.when(F.col(f"_e{i}key").isNotNull(), F.col(f"_k{i}")) for i in range(4)], F.col("_base.key"))
    df = premium_join(df.withColumn("stage", stage).withColumn("_base", chosen), "_plain", premiums, "_premium")
    k = F.col("_premium.multiplier")
    up = px.apply_premium(F.col("_base.mid"), F.col("_base.low"), F.col("_base.high"), k)
    boosted = k.isNotNull()
    pick = lambda name, base: F.when(boosted, up[name]).otherwise(base)
    df = df.withColumns(
        {
            "est_avg": F.when(F.col("stage").isNotNull(), pick("avg_retail", F.col("_base.mid"))),
            "est_min": F.when(F.col("stage").isNotNull(), pick("min_retail", F.col("_base.low"))),
            "est_max": F.when(F.col("stage").isNotNull(), pick("max_retail", F.col("_base.high"))),
            "_label": label,
        }
    ).withColumn("est_tier", px.price_tier(F.col("est_avg")))
    span = lambda lo, hi: F.concat(F.lit("$"), px.whole(lo), F.lit("–$"), px.whole(hi))
    note = (
        F.when(
            boosted,
            F.concat(
                F.lit("Producer-adjusted estimate: "), F.col("_premium.note"), F.lit(". Regional base ×"),
                px.one_decimal(k), F.lit(". Typical retail: "), span(F.col("est_min"), F.col("est_max")), F.lit("."),
            ),
        )
        .when(
            F.col("stage") == "varietal",
            F.concat(
                F.lit("No region data. Varietal estimate for '"), F.col("_k1"), F.lit("' (typical retail: "),
                span(F.col("_base.low"), F.col("_base.high")), F.lit("). Wide range — treat as rough guide."),
            ),
        )
        .otherwise(
            F.concat(
                F.lit("No exact catalog match. Regional estimate for '"), F.col("_label"), F.lit("' (typical retail: "),
                span(F.col("_base.low"), F.col("_base.high")), F.lit(")."),
            )
        )
    )
    source = (
        F.when(boosted, "producer_adjusted_estimate").when(F.col("stage") == "varietal", "varietal_proxy")
        .otherwise("regional_proxy")
    )
    has = F.col("stage").isNotNull()
    df = df.withColumns(
        {
            "est_wholesale": px.estimate_wholesale(F.col("est_avg"), F.col("est_tier")),
            "est_source": F.when(has, source),
            "est_confidence": F.when(has, F.when(boosted, "medium").otherwise("low")),
            "est_note": F.when(has, note),
        }
    )
    return df.drop(*[c for c in df.columns if c.startswith("_")])


# ------------------------------------------------------------------ effective price
REAL_SOURCES = ("market_live", "catalog")
EFFECTIVE = ["avg_retail", "min_retail", "max_retail", "estimated_wholesale", "price_tier", "price_source",
             "data_confidence", "price_basis_note"]


def effective_price(df: DataFrame, include_estimates: bool = False) -> DataFrame:
    """Choose one price per item and say where it comes from.

    Order: merged market price, catalog price ±15 % (both for strong matches
    only), live lookup, then, when asked for, the adjusted or regional estimate.
    Reads mk_* (market), cat_* (catalog), live_* and est_* columns.
    """
    strong = F.coalesce(F.col("strong"), F.lit(False))
    low, high = px.price_range(F.col("cat_price"))
    money = lambda c: F.col(c).cast("decimal(12,2)")
    text = lambda *p: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in p])
    market = strong & F.col("mk_avg").isNotNull()
    catalog = strong & (F.col("cat_price") > 0)
    live = ~strong & F.col("live_avg").isNotNull()
    est = ~strong & F.col("est_avg").isNotNull() & F.lit(include_estimates)
    adjusted = F.col("est_source") == "producer_adjusted_estimate"
    percent = px.whole(F.col("confidence") * 100)

    def choose(m, c, l, e):
        return F.when(market, m).when(catalog, c).when(live, l).when(est, e)

    listings = F.when(F.col("live_listings") > 0, text(" (", F.col("live_listings").cast("string"), " listings)")).otherwise("")
    return df.withColumns(
        {
            "avg_retail": choose(money("mk_avg"), money("cat_price"), money("live_avg"), money("est_avg")),
            "min_retail": choose(money("mk_min"), low, money("live_min"), money("est_min")),
            "max_retail": choose(money("mk_max"), high, money("live_max"), money("est_max")),
            "estimated_wholesale": choose(
                money("mk_wholesale"), px.estimate_wholesale(F.col("cat_price"), F.col("cat_tier")),
                money("live_wholesale"), money("est_wholesale"),
            ),
            "price_tier": choose(F.col("cat_tier"), F.col("cat_tier"), F.col("live_tier"), F.col("est_tier")),
            "price_source": F.coalesce(
                choose(
                    F.lit("market_live"), F.lit("catalog"), F.lit("market_live"),
                    F.when(adjusted, "producer_adjusted_estimate").otherwise("regional_estimate"),
                ),
                F.lit("unavailable"),
            ),
            "data_confidence": choose(
                F.when(F.col("mk_confidence").isin("high", "medium", "low"), F.col("mk_confidence")).otherwise("low"),
                F.lit("low"), F.lit("high"), F.when(adjusted, "medium").otherwise("low"),
            ),
            "price_basis_note": choose(
                text("Matched '", F.col("cat_name"), "' in curated catalog (confidence ", percent,
                     "%). Price from: aggregated."),
                text("Catalog reference price for '", F.col("cat_name"),
                     "'. Live market data not yet cached — refresh for a real-time quote."),
                text("Live market data", listings, ". Wine not in catalog – retrieved in real time."),
                F.when(adjusted, F.col("est_note")).otherwise(
                    text("Regional bucket estimate only – producer unknown. Range: $", px.whole(F.col("est_min")), "–$",
                         px.whole(F.col("est_max")), ". Wide confidence interval; verify before acting.")
                ),
            ),
        }
    )


def real_source_filter(df: DataFrame) -> DataFrame:
    """Null every price that is not observed or from the catalog."""
    real = F.col("price_source").isin(*REAL_SOURCES)
    cols = ["avg_retail", "min_retail", "max_retail", "estimated_wholesale", "data_confidence", "price_source"]
    return df.withColumns({c: F.when(real, F.col(c)) for c in cols})
