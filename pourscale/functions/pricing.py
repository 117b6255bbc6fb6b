"""Price tiers, wholesale estimates, markup scores and their texts as columns."""

from __future__ import annotations

from decimal import ROUND_HALF_EVEN, Decimal

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pourscale import fixed_values as fv

_FIELDS = ("tier", "upper", "wholesale_ratio", "ideal", "fair_low", "fair_high", "excessive", "ttl_days")


def tier_table(spark: SparkSession) -> DataFrame:
    """The five tier rows (constant size, safe to broadcast)."""
    schema = (
        "tier string, upper int, wholesale_ratio double, ideal double, fair_low double, "
        "fair_high double, excessive double, ttl_days int"
    )
    return spark.createDataFrame(fv.TIERS, schema)


def tier_value(tier: Column, field: str) -> Column:
    """Tier setting by name; an unknown tier takes the default."""
    i = _FIELDS.index(field)
    rows = {row[0]: row[i] for row in fv.TIERS}
    default = fv.DEFAULT_WHOLESALE_RATIO if field == "wholesale_ratio" else rows[fv.DEFAULT_TIER]
    out = F.lit(default)
    for name, value in rows.items():
        out = F.when(tier == name, F.lit(value)).otherwise(out)
    return out


def price_tier(price: Column) -> Column:
    out = F.lit(fv.TIERS[-1][0])
    for name, upper, *_ in reversed(fv.TIERS[:-1]):
        out = F.when(price <= upper, name).otherwise(out)
    return F.when(price.isNotNull(), out)


def estimate_wholesale(retail: Column, tier: Column) -> Column:
    # exact decimal product, so the cents do not depend on binary rounding
    ratio = tier_value(tier, "wholesale_ratio").cast("decimal(4,2)")
    return F.round(retail.cast("decimal(12,2)") * ratio, 2).cast("decimal(12,2)")


def ratio(a: Column, b: Column, digits: int = 3) -> Column:
    """a / b of amounts in whole cents, rounded half to even on the exact quotient; null when either is missing or b is zero."""
    cents = lambda x: F.round(x.cast("double") * 100).cast("bigint")
    n, d = cents(a) * 10**digits, F.nullif(cents(b), F.lit(0))
    rest = F.pmod(n, d)
    whole_part = ((n - rest) / d).cast("bigint")
    up = (2 * rest > d) | ((2 * rest == d) & (whole_part % 2 == 1))
    return F.when(b != 0, (whole_part + up.cast("int")) / F.lit(float(10**digits)))


def fairness_score(multiple: Column, tier: Column) -> Column:
    m = multiple
    low, high, top = (tier_value(tier, f) for f in ("fair_low", "fair_high", "excessive"))
    score = (
        F.when(m <= low, F.least(F.lit(100.0), F.bround(F.lit(85) + (low - m) / low * 30)))
        .when(m <= high, F.bround(F.lit(85) - (m - low) / (high - low) * 25))
        .when(m <= top, F.bround(F.lit(60) - (m - high) / (top - high) * 40))
        .otherwise(F.bround(F.lit(20.0) * F.exp(F.lit(-3.0) * ((m - top) / top))))
    )
    return F.when(m.isNotNull(), F.greatest(score, F.lit(0.0)).cast("int"))


def verdict(score: Column) -> Column:
    return _by_score(score, 1)


def verdict_label(score: Column) -> Column:
    return _by_score(score, 2)


def _by_score(score: Column, field: int) -> Column:
    out = F.lit(fv.VERDICTS[-1][field])
    for row in reversed(fv.VERDICTS[:-1]):
        out = F.when(score >= row[0], row[field]).otherwise(out)
    return F.when(score.isNotNull(), out)


def markup_flags(menu: Column, wholesale: Column, w_multiple: Column, r_multiple: Column, tier: Column) -> Column:
    r = F.coalesce(r_multiple, F.lit(0.0))
    flags = F.array(
        F.when(w_multiple <= tier_value(tier, "fair_low"), "below_market"),
        F.when(w_multiple >= tier_value(tier, "excessive"), "excessive_markup"),
        F.when(r >= 4.0, "price_gouging"),
        F.when(r <= 1.0, "below_retail"),
        F.when(menu < wholesale, "below_wholesale"),
    )
    return F.when(w_multiple.isNotNull(), F.array_compact(flags))


def whole(x: Column) -> Column:
    """Number as text without decimals, half to even."""
    return F.bround(x.cast("double")).cast("bigint").cast("string")


def one_decimal(x: Column) -> Column:
    return F.format_string("%.1f", F.bround(x.cast("double"), 1))


def usual_range(tier: Column) -> Column:
    """The fair range of a tier as text: one of five, so no number is formatted for a row."""
    short = lambda x: str(Decimal(str(x)).quantize(Decimal("0.1"), ROUND_HALF_EVEN))
    low, high = _FIELDS.index("fair_low"), _FIELDS.index("fair_high")
    spans = {row[0]: f"{short(row[low])}–{short(row[high])}×" for row in fv.TIERS}
    out = F.lit(spans[fv.DEFAULT_TIER])
    for name, text in spans.items():
        out = F.when(tier == name, text).otherwise(out)
    return out


def insight_text(menu: Column, retail: Column, wholesale: Column, multiple: Column, tier: Column) -> Column:
    low, high = tier_value(tier, "fair_low"), tier_value(tier, "fair_high")
    m, w, r, x = whole(menu), whole(wholesale), whole(retail), one_decimal(multiple)
    span = usual_range(tier)
    c = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.when(
        multiple.isNotNull(),
        F.when(
            menu <= wholesale,
            c("At $", m, ", this wine is priced at or below estimated wholesale (~$", w,
              ").  This is an extraordinary value."),
        )
        .when(
            multiple <= low,
            c("Priced at ", x, "× estimated wholesale ($", w, "), this is below the typical restaurant range of ",
              span, ". Great value relative to a retail price of ~$", r, "."),
        )
        .when(
            multiple <= high,
            c("At $", m, " (", x, "× estimated wholesale), this falls within the typical restaurant range of ",
              span, ". Retail is ~$", r, "."),
        )
        .when(
            multiple <= tier_value(tier, "excessive"),
            c("At $", m, ", the markup is ", x, "× estimated wholesale ($", w, "), above the typical range of ",
              span, ". Average retail is ~$", r, "."),
        )
        .otherwise(
            c("At $", m, ", the markup is ", x, "× estimated wholesale ($", w, ").  Average retail is ~$", r,
              ". This significantly exceeds the typical restaurant range of ", span, ".")
        ),
    )


def deal_rating(menu: Column, retail: Column) -> Column:
    x = F.when(retail != 0, menu.cast("double") / retail.cast("double"))
    return (
        F.when(x.isNull(), "unknown").when(x < 0.8, "steal").when(x <= 1.5, "good").when(x <= 2.5, "fair")
        .otherwise("expensive")
    )


def price_range(price: Column) -> tuple[Column, Column]:
    """±15 % around one price, to the cent."""
    p = price.cast("decimal(12,2)")
    return tuple(F.round(p * F.lit(k).cast("decimal(3,2)"), 2).cast("decimal(12,2)") for k in ("0.85", "1.15"))


def confidence_level(score: Column) -> Column:
    out = F.lit("none")
    for floor, name in reversed(fv.CONFIDENCE_LEVELS):
        out = F.when(score >= floor, name).otherwise(out)
    return out


def is_strong(level: Column) -> Column:
    return level.isin("very_high", "high")


def price_confidence(n_sources: Column, n_listings: Column) -> Column:
    return (
        F.when(F.coalesce(n_sources, F.lit(0)) == 0, "none")
        .when((n_sources >= 2) & (n_listings >= 10), "high")
        .otherwise("medium")
    )


def ttl_seconds(tier: Column) -> Column:
    return tier_value(tier, "ttl_days") * F.lit(86_400)


def expires_at(fetched: Column, seconds: Column) -> Column:
    return fetched + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def apply_premium(avg: Column, low: Column, high: Column, k: Column) -> dict[str, Column]:
    """Scale an estimate by a house multiplier: the range widens, all in whole units."""
    return {
        "avg_retail": F.bround(F.coalesce(avg, F.lit(50.0)) * k),
        "min_retail": F.bround(F.coalesce(low, F.lit(30.0)) * k * 0.6),
        "max_retail": F.bround(F.coalesce(high, F.lit(100.0)) * k * 1.5),
    }
