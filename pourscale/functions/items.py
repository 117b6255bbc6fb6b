"""Attribute extraction from one item line (price, size, year, grape, region, style)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from pourscale import fixed_values as fv
from pourscale.sources.lookups import region_rows
from pourscale.functions.text import normalize_text, rewrite


def strip_price_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, fv.PRICE_TEXT, " "))


#: What every size in a text holds.
_SIZED = r"(?i)\b(?:magnum|jeroboam|methuselah|imperial|half[\s-]bottle|\d+(?:\.\d+)?\s*(?:ml|cl|l|ltr|litre|liter))\b"


def extract_format_ml(text: Column) -> Column:
    """Bottle size in ml: named sizes in order, else number and unit; most texts have none and need one test only."""
    amount = F.regexp_extract(text, fv.SIZE_TEXT, 1).try_cast("double")
    unit = F.lower(F.regexp_extract(text, fv.SIZE_TEXT, 2))
    scale = F.when(unit.isin("l", "ltr", "litre", "liter"), 1000).when(unit == "cl", 10).otherwise(1)
    out = F.floor(amount * scale).cast("int")
    for pattern, ml in reversed(fv.NAMED_SIZES):
        out = F.when(F.regexp_like(text, F.lit(pattern)), ml).otherwise(out)
    return F.when(F.regexp_like(text, F.lit(_SIZED)), out)


def strip_format(text: Column) -> Column:
    bare = rewrite(text, [(pattern, " ") for pattern, _ in fv.NAMED_SIZES] + [(fv.SIZE_TEXT, " ")])
    return F.when(F.regexp_like(text, F.lit(_SIZED)), bare).otherwise(text)


def extract_vintage(text: Column) -> Column:
    return F.regexp_extract(text, fv.YEAR, 1).try_cast("int")


def strip_vintage(text: Column) -> Column:
    """Blank the first year only."""
    return F.regexp_replace(text, r"(?s)^(.*?)" + fv.YEAR + r"(.*)$", "$1 $3")


def flag_non_vintage(text: Column) -> Column:
    return F.regexp_like(text, F.lit(fv.NON_VINTAGE))


def strip_non_vintage(text: Column) -> Column:
    return F.regexp_replace(text, fv.NON_VINTAGE, " ")


def clean_separators(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, fv.SEPARATOR_RUN, " "))


def first_words(patterns) -> list[str]:
    """The whole words with which matches of rules on normalised text begin."""
    found = [w for p in patterns for run in re.findall(r"\\b(?:\(\?:)?([a-z]+(?:\|[a-z]+)*)", p) for w in run.split("|")]
    return sorted(set(found))


def has_word(normalized: Column, words: list[str]) -> Column:
    """Whether a normalised text holds one of the words: a lookup for each of its words, however many rules there are."""
    return F.exists(F.split(normalized, " "), lambda w: w.isin(words))


def extract_varietal(normalized: Column) -> Column:
    """Grape of the first rule with a hit; texts without a word that begins one are skipped."""
    rules = None
    for pattern, label in fv.GRAPE_RULES:
        hit = F.regexp_like(normalized, F.lit(pattern))
        rules = F.when(hit, label) if rules is None else rules.when(hit, label)
    return F.when(has_word(normalized, first_words(p for p, _ in fv.GRAPE_RULES)), rules)


def extract_region(normalized: Column, keywords=None) -> Column:
    """Region of the longest keyword contained in the text; ties go to the earlier keyword.

    Keywords are tried longest first, so the first hit is the answer and the
    test stays a chain of substring searches in generated code.
    """
    rows = sorted(keywords or region_rows(), key=lambda r: (-len(r[0]), r[2]))
    out = None
    for word, region, _ in rows:
        hit = F.contains(normalized, F.lit(word))
        out = F.when(hit, region) if out is None else out.when(hit, region)
    return out


def extract_type(normalized: Column) -> Column:
    out = None
    for style, names in fv.STYLE_WORDS:
        hit = F.regexp_like(normalized, F.lit(r"\b(?:" + "|".join(names) + r")\b"))
        out = F.when(hit, style) if out is None else out.when(hit, style)
    words = [re.match("[a-z]+", name)[0] for _, names in fv.STYLE_WORDS for name in names]
    return F.when(has_word(normalized, words), out)


def split_producer(text: Column) -> tuple[Column, Column]:
    """Producer and name around the first comma; without one, all text is the producer."""
    t = F.trim(text)
    blank = lambda c: F.when(c != "", c)
    has = F.contains(t, F.lit(","))
    producer = F.when(has, blank(F.trim(F.substring_index(t, ",", 1)))).otherwise(blank(t))
    name = F.when(has, blank(F.trim(F.regexp_replace(t, r"(?s)^[^,]*,", ""))))
    return producer, name


def parse_items(df: DataFrame, text: str = "menu_text", split_before_clean: bool = False, regions=None) -> DataFrame:
    """Add the parsed columns of ``text`` to every row.

    Steps run in a fixed order (price, size, year, NV, separators) because each
    removes what it found.  Columns are added in stages, so a later stage reads
    the earlier one instead of repeating its regular expressions.
    ``split_before_clean`` splits the producer before separator runs become
    blanks, which keeps ``Producer, Name`` apart.  ``regions`` are (word, region,
    ordinal) rows; without them a small sample is used.
    """
    t = F.col("_t")
    out = (
        df.withColumn("_t", strip_price_text(F.col(text)))
        .withColumn("format_ml", extract_format_ml(t))
        .withColumn("_t", strip_format(t))
        .withColumn("parsed_vintage", extract_vintage(t))
        .withColumn("_t", strip_vintage(t))
        .withColumn("non_vintage", flag_non_vintage(t))
        .withColumn("_raw", strip_non_vintage(t))
        .withColumn("cleaned_text", clean_separators(F.col("_raw")))
        .withColumn("normalized_search", normalize_text(F.col("cleaned_text")))
    )
    n = F.col("normalized_search")
    producer, name = split_producer(F.col("_raw" if split_before_clean else "cleaned_text"))
    return out.withColumns(
        {
            "parsed_varietal": extract_varietal(n),
            "parsed_region": extract_region(n, regions),
            "parsed_type": extract_type(n),
            "parsed_producer": producer,
            "parsed_name": name,
        }
    ).drop("_t", "_raw")


def parse_distinct(df: DataFrame, text: str = "menu_text", **options) -> DataFrame:
    """``parse_items`` where every distinct text is parsed once, whatever the number of rows that hold it."""
    given = F.col(text).alias("_given")
    texts = parse_items(df.select(given).distinct(), "_given", **options)
    return df.join(texts, F.col(text).eqNullSafe(F.col("_given"))).drop("_given")


def override_vintage(given: Column, parsed: Column) -> Column:
    """The caller's year wins; zero counts as not given."""
    return F.coalesce(F.when(given != 0, given), parsed)
