"""Markup of a menu price against retail and wholesale, as one projection."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pourscale.functions import pricing as px


def analyze_markup(
    df: DataFrame, menu: str = "menu_price", retail: str = "avg_retail", wholesale: str = "estimated_wholesale",
    tier: str = "price_tier",
) -> DataFrame:
    """Add multiples, score, verdict, flags, text and the usual range.

    Columns stay null unless menu price, retail and wholesale are all present
    and non-zero.
    """
    m, r, w, t = (F.col(c) for c in (menu, retail, wholesale, tier))
    usable = F.coalesce((m != 0) & (r != 0) & (w != 0), F.lit(False))
    out = df.withColumns(
        {
            "retail_multiple": F.when(usable, px.ratio(m, r)),
            "wholesale_multiple": F.when(usable, px.ratio(m, w)),
        }
    )
    x = F.col("wholesale_multiple")
    out = out.withColumn("fairness_score", px.fairness_score(x, t))
    s = F.col("fairness_score")
    return out.withColumns(
        {
            "verdict": px.verdict(s),
            "verdict_label": px.verdict_label(s),
            "flags": px.markup_flags(m, w, x, F.col("retail_multiple"), t),
            "insight": px.insight_text(m, r, w, x, t),
            "range_low": F.when(usable, px.tier_value(t, "fair_low")),
            "range_high": F.when(usable, px.tier_value(t, "fair_high")),
        }
    )
