"""Text normalisation as Spark column expressions (no Python per row)."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, functions as F

from pourscale import fixed_values as fv


@lru_cache(maxsize=1)
def accent_map() -> tuple[str, str]:
    """Source and target characters for ``translate``.

    Built from the Unicode tables: every character whose compatibility form
    without combining marks is one other character.  Combining marks come last
    and have no target, so ``translate`` deletes them.
    """
    src, dst = [], []
    for start, stop in ((0xA0, 0x250), (0x1E00, 0x1F00), (0x2000, 0x2010), (0xFF01, 0xFF5F)):
        for cp in range(start, stop):
            ch = chr(cp)
            base = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))
            if len(base) == 1 and base != ch:
                src.append(ch)
                dst.append(base)
    marks = [chr(cp) for cp in range(0x300, 0x370) if unicodedata.combining(chr(cp))]
    return "".join(src + marks), "".join(dst)


def strip_accents(text: Column) -> Column:
    src, dst = accent_map()
    return F.translate(text, src, dst)


def rewrite(text: Column, rules) -> Column:
    """Apply ordered (pattern, replacement) rules."""
    return reduce(lambda c, r: F.regexp_replace(c, r[0], r[1]), rules, text)


def _needed(pattern: str) -> str:
    """Letters that any match of a pattern holds: the longest run outside of its groups and options."""
    plain = re.sub(r"\\.\??", " ", pattern)
    while "(" in plain:
        plain = re.sub(r"\([^()]*\)\??", " ", plain)
    return max(re.findall(r"[a-z]+", re.sub(r".[?*]", " ", plain)), key=len)


def rewrite_guarded(text: Column, rules) -> Column:
    """``rewrite`` where a rule's expression only runs on texts that hold the letters it needs.

    A search for letters costs a small part of an expression; the text is bound to a name, so that it isn't made anew for each use.
    """
    def change(pattern, replacement):
        needed = F.lit(_needed(pattern))
        return lambda x: F.when(F.contains(x, needed), F.regexp_replace(x, pattern, replacement)).otherwise(x)

    return reduce(lambda t, rule: F.transform(F.array(t), change(*rule))[0], rules, text)


def any_of(patterns) -> str:
    """One pattern for texts that hold a match of at least one of the patterns."""
    scoped = [re.sub(r"^\(\?([a-zA-Z]+)\)(.*)$", r"(?\1:\2)", p, flags=re.S) for p in patterns]
    return "|".join(p if p.startswith("(?") else f"(?:{p})" for p in scoped)


def in_pieces(value: Column) -> Column:
    """The same value, made by several small compiled methods.

    A lambda that is never reached keeps its projection out of the one method that Spark makes of a whole stage: over some
    thousands of instructions the JVM does not compile that, and over 64 KB Spark gives it up.
    """
    return F.coalesce(value, F.get(F.transform(F.array(F.lit(None)), lambda x: x), F.lit(0)))


def finished(df: DataFrame, **values: Column) -> DataFrame:
    """Columns made once in a projection below a generator: filters on them stay above it and read the finished value.

    Spark moves filters below a projection and repeats its expressions there.
    """
    made = df.withColumns({f"_{n}": in_pieces(v) for n, v in values.items()})
    rows = made.select("*", F.explode(F.array(F.struct(*[F.col(f"_{n}").alias(n) for n in values]))).alias("_made"))
    return rows.select(*[c for c in df.columns if c not in values], *[F.col(f"_made.{n}").alias(n) for n in values])


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value made once, however often it is read."""
    return F.transform(F.array(value), use)[0]


#: Letters that equal ASCII ones where rules compare without case in Unicode, and what such rules take for white space.
_ODD = "[ſ\u212aİı\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_BLANKS = "\t\n\x0b\x0c\r"


def ascii_rule(pattern: str) -> str:
    """A rule without Unicode classes: on ASCII texts it matches what the rule matches, for a part of the time."""
    return re.sub(r"\(\?([is]*)U([is]*)([:)])", lambda m: f"(?{m[1]}{m[2]}{m[3]}" if m[1] + m[2] or m[3] == ":" else "", pattern)


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def is_odd(text: Column) -> Column:
    """Whether a text holds letters or blanks that rules with Unicode classes take for ASCII ones."""
    return ~is_ascii(text) & F.regexp_like(text, F.lit(_ODD))


def holds(text: Column, *parts: str) -> Column:
    """Whether a text holds one of the parts: a search for bytes, which costs a small part of an expression."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in parts])


def may_hold(text: Column, *parts: str) -> Column:
    """Whether a rule without case may match that needs one of the parts, given in lower case.

    For projections, which lower a text once for all searches.
    """
    return holds(F.lower(text), *parts) | is_odd(text)


def like(text: Column, pattern: str) -> Column:
    """Whether a rule matches; ASCII texts are spared its Unicode classes."""
    return F.when(is_ascii(text), F.regexp_like(text, F.lit(ascii_rule(pattern)))).otherwise(F.regexp_like(text, F.lit(pattern)))


def replaced(text: Column, pattern: str, by: str) -> Column:
    """``regexp_replace`` that spares ASCII texts the Unicode classes of a rule."""
    return F.when(is_ascii(text), F.regexp_replace(text, ascii_rule(pattern), by)).otherwise(F.regexp_replace(text, pattern, by))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalize_text(text: Column) -> Column:
    """Comparison form: unaccented, lower case, short forms spelled out, [a-z0-9 ] only."""
    spelled = rewrite_guarded(F.lower(strip_accents(text)), fv.SHORT_FORMS)
    return F.trim(F.regexp_replace(spelled, r"[^a-z0-9]+", " "))


def normalize_producer(text: Column) -> Column:
    plain = F.regexp_replace(strip_accents(F.lower(text)), r"[^a-z0-9]+", " ")
    return F.trim(rewrite(plain, fv.PRODUCER_FORMS))


def _word_pattern(words) -> str:
    return r"(?i)\b(" + "|".join(words) + r")\b"


def producer_key(text: Column) -> Column:
    """Producer name without company boilerplate, for duplicate checks."""
    bare = F.regexp_replace(strip_accents(F.lower(text)), _word_pattern(fv.HOUSE_WORDS), "")
    return F.trim(F.regexp_replace(bare, r"\s{2,}", " "))


def slug(text: Column, limit: int | None = None) -> Column:
    dashed = F.regexp_replace(strip_accents(F.lower(text)), r"[^a-z0-9]+", "-")
    trimmed = F.regexp_replace(dashed, r"^-+|-+$", "")
    return F.substring(trimmed, 1, limit) if limit else trimmed


def item_slug(producer: Column, name: Column) -> Column:
    """Id of an unknown product: producer-name when a producer is known."""
    has = F.coalesce(F.length(producer), F.lit(0)) > 0
    return slug(F.when(has, F.concat(producer, F.lit("-"), name)).otherwise(name))


def lookup_key(text: Column) -> Column:
    spaced = F.regexp_replace(strip_accents(F.lower(text)), r"[-'’‘]", " ")
    return squeeze(F.regexp_replace(spaced, r"[^a-z0-9 ]", ""))


def expand_terms(text: Column) -> Column:
    return rewrite(text, [(rf"(?i)\b{short}\b", full) for short, full in fv.TERM_FORMS])


def words(text: Column) -> Column:
    """Whitespace-separated words, no empty strings."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def significant_tokens(normalized: Column) -> Column:
    stop = F.array(*[F.lit(w) for w in fv.STOP_WORDS])
    return F.array_distinct(
        F.filter(F.split(normalized, " "), lambda t: (F.length(t) >= fv.MIN_TOKEN) & ~F.array_contains(stop, t))
    )


def key_words(name: Column, producer: Column) -> Column:
    """Distinctive words of a product, to verify that a listing names it."""
    text = F.lower(strip_accents(F.concat_ws(" ", name, producer)))
    text = F.regexp_replace(text, _word_pattern(fv.KEY_NOISE_WORDS), " ")
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"([a-z]{3,})"), 1))


def plain_words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(strip_accents(text)), F.lit(r"([a-z]{3,})"), 1))


def search_phrases(name: Column, producer: Column, vintage: Column) -> Column:
    """Lookup phrases from most to least specific: producer + name, then name."""
    n = F.trim(strip_accents(name))
    p = F.regexp_replace(F.trim(strip_accents(producer)), _word_pattern(fv.PHRASE_HOUSE_WORDS), "")
    p = F.trim(F.regexp_replace(F.trim(p), r"\s{2,}", " "))
    apart = (p != "") & ~F.contains(F.lower(n), F.lower(p))
    both = F.when(apart, F.concat_ws(" ", p, n))
    year = vintage.cast("string")
    phrases = F.array(F.concat(both, F.lit(" "), year), both, F.concat(n, F.lit(" "), year), n)
    return F.array_distinct(F.filter(phrases, lambda x: x.isNotNull()))


def catalog_phrases(name: Column, producer: Column, vintage: Column) -> Column:
    """Phrase cascade used to find a product's external id."""
    p, n = listing_text(producer), listing_text(name)
    half = F.substring(p, F.lit(1), F.floor(F.length(p) / 2).cast("int"))
    base = F.when(F.startswith(n, half), name).otherwise(F.concat_ws(" ", producer, name))
    year = vintage.cast("string")
    return F.array_distinct(
        F.array(F.concat_ws(" ", base, year), base, F.concat_ws(" ", producer, year), producer)
    )


def retail_phrase(name: Column, producer: Column, vintage: Column) -> Column:
    """Producer, up to three telling words of the name, year."""
    skip = F.array(*[F.lit(w) for w in fv.RETAIL_SKIP_WORDS])
    telling = F.filter(words(name), lambda w: (F.length(w) > 2) & ~F.array_contains(skip, F.lower(w)))
    parts = F.concat(F.array(producer), F.slice(telling, 1, 3), F.array(vintage.cast("string")))
    return F.array_join(parts, " ")


def listing_text(text: Column) -> Column:
    """Lower case without accents, punctuation as single spaces kept in place."""
    return F.trim(F.regexp_replace(F.lower(strip_accents(text)), r"[^a-z0-9 ]", " "))


def producer_guess(title: Column) -> Column:
    """First two words of a listing title, three after a house prefix."""
    w = words(F.trim(F.regexp_replace(title, r"\b(19|20)\d{2}\b", "")))
    prefix = F.lower(F.get(w, F.lit(0))).isin(fv.HOUSE_PREFIXES)
    take = F.when(prefix, 3).otherwise(2)
    return F.array_join(F.slice(w, F.lit(1), take), " ")


def price_cache_key(wine_id: Column, vintage: Column) -> Column:
    return F.concat_ws(":", F.lit("pricing"), wine_id, F.coalesce(vintage.cast("string"), F.lit("nv")))


def lookup_cache_key(text: Column, vintage: Column) -> Column:
    body = F.concat_ws(":", F.trim(F.lower(text)), vintage.cast("string"))
    return F.concat(F.lit("dynamic_lookup:"), F.md5(body))


def split_vintage_key(key: Column) -> tuple[Column, Column]:
    """``id-YYYY`` to (id, year); a key without a year keeps itself and null."""
    has = F.regexp_like(key, F.lit(r"^.+-\d{4}$"))
    base = F.when(has, F.regexp_extract(key, r"^(.+)-\d{4}$", 1))
    year = F.when(has, F.regexp_extract(key, r"-(\d{4})$", 1).cast("int"))
    return F.coalesce(base, key), year


def money(text: Column) -> Column:
    """``"$1,250.00"`` to a number; null when it is none."""
    cleaned = F.trim(F.regexp_replace(text.cast("string"), r"[$,]", ""))
    return F.when(F.regexp_like(cleaned, F.lit(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")), cleaned).try_cast("double")


# ------------------------------------------------------------------ menu lines
_LEADING = "•·-–—►▶→✦◆◇▪▸★☆✓✗ "
_TAILS = ("aq", "mp", "mkt", "price", "market", "sea", "seasonal", "request", "tbd")
_CRITICS = ("rp", "ws", "js", "vm", "ag", "jd", "nt", "tp", "st", "jr", "bh")
#: Scores as ``_CRITICS`` start them, and those with points.
_SCORED = r"(?i)(?:[rt]p|[wj]s|vm|ag|jd|[ns]t|jr|bh)(?<![a-z]..)\s*\p{Nd}|\p{Nd}\s*p|/\s*100"


def _last(text: Column, chars: str) -> Column:
    return F.contains(F.lit(chars), F.substring(text, -1, 1))


def _may_lead(text: Column) -> Column:
    return F.contains(F.lit(_LEADING + _BLANKS), F.substring(text, 1, 1))


def _may_end(text: Column) -> Column:
    ends = reduce(lambda a, b: a | b, [F.endswith(F.lower(text), F.lit(w)) for w in _TAILS])
    return _last(text, " " + _BLANKS) | ends | is_odd(text)


def _may_be_scored(text: Column) -> Column:
    return (may_hold(text, "pt", "point", "100", *_CRITICS)) & F.regexp_like(text, F.lit(r"\p{Nd}")) & (is_odd(text) | F.regexp_like(text, F.lit(_SCORED)))


def _odd_blanks(text: Column) -> Column:
    return holds(text, "  ", *_BLANKS) | is_odd(text)


def clean_line(raw: Column) -> Column:
    """Menu line without leaders, bullets, critic scores and price placeholders.

    A line that no rule matches stays as it is and costs searches for what the rules need instead of all of them,
    and the others meet only the rules that may match.
    """
    parts = F.filter(F.transform(F.split(raw, r"\|"), lambda p: F.trim(p)), lambda p: p != "")
    line = F.when(F.contains(raw, F.lit("|")), F.array_join(parts, " ")).otherwise(raw)
    fill = lambda x: holds(x, "...", "..") | holds(x, "-", "_", "·", "•", "*")
    edge = lambda x: _odd_blanks(x) | F.startswith(x, F.lit(" ")) | F.endswith(x, F.lit(" "))
    rules = [
        (lambda x: holds(x, ","), fv.US_THOUSANDS, "$1$2"), (lambda x: holds(x, "."), fv.EURO_THOUSANDS, "$1$2"), (fill, fv.FILL, " "),
        (_odd_blanks, r"(?U)\s{2,}", " "), (edge, r"(?U)^\s+|\s+$", ""), (lambda x: _may_lead(x) | is_odd(x), fv.LEAD_MARKS, ""), (_may_end, fv.ASK_TAIL, ""),
        None, (_may_end, fv.MARKET_TAIL, ""), None, (_may_be_scored, fv.CRITIC_SCORE, ""), None,
        (_odd_blanks, r"(?U)\s{2,}", " "), (edge, r"(?U)^\s+|\s+$", ""),
    ]
    def change(may, pattern, by):
        return lambda x: F.when(may(x), replaced(x, pattern, by)).otherwise(x)

    for rule in rules:
        line = bound(line, change(*rule)) if rule else F.trim(line)
    touched = (
        holds(raw, "|", "  ", *_BLANKS) | _may_lead(raw) | _may_end(raw) | (holds(raw, ",", ".") & F.regexp_like(raw, F.lit(r"[,.]\d")))
        | (fill(raw) & F.regexp_like(raw, F.lit(fv.FILL))) | _may_be_scored(raw)
    )
    return F.when(touched, line).otherwise(raw)


def looks_like_name(name: Column) -> Column:
    """Plausible product name: mostly letters, words long enough, no OCR debris.

    Names of letters and single blanks only, as most are, are measured as they are.
    """
    size = F.length(name)
    letters = F.length(F.regexp_replace(name, r"[^\p{L}\s]", ""))
    sizes = F.transform(F.regexp_extract_all(name, F.lit(r"(?<!\S)\p{L}+(?!\S)"), 0), lambda w: F.length(w))
    long_enough = lambda n: (
        (F.size(n) > 0) & (F.aggregate(n, F.lit(0), lambda acc, k: acc + k) >= 2.8 * F.size(n)) & F.exists(n, lambda k: k >= 3)
    )
    ok = (size >= 4) & ~F.regexp_like(name, F.lit(fv.BAD_MARKS)) & (letters / size >= 0.65) & bound(sizes, long_enough)
    total = F.length(F.replace(name, F.lit(" "), F.lit("")))
    plain = (size >= 4) & (total >= 2.8 * (size - total + 1)) & F.regexp_like(name, F.lit(r"\p{L}{3}"))
    return F.coalesce(F.when(F.regexp_like(name, F.lit(r"^\p{L}++(?: \p{L}++)*+\z")), plain).otherwise(ok), F.lit(False))


def is_header_line(text: Column) -> Column:
    return like(text, fv.HEADER_LINE)


def is_region_line(text: Column) -> Column:
    return F.contains(text, F.lit(",")) & like(text, fv.REGION_LINE)


def names_other_beverage(text: Column) -> Column:
    return may_hold(text, *fv.OTHER_BEVERAGES) & like(text, r"(?iU)\b(" + "|".join(fv.OTHER_BEVERAGES) + r")\b")


def is_caps_dash(text: Column) -> Column:
    ascii_letters = F.regexp_replace(text, r"[^a-zA-Z]", "")
    return holds(text, "-", "–", "—") & F.regexp_like(ascii_letters, F.lit(r"^[A-Z]+\z"))


def may_be_section(text: Column) -> Column:
    """Whether a text holds what every section's name needs."""
    words = ("glass", "btg", "oz", "ounce", "half", "demi", "375", "magnum", "1.5", "bottle", "by", "b ")
    return may_hold(text, *words, *("b" + c for c in _BLANKS))


def is_section_text(text: Column) -> Column:
    return may_be_section(text) & like(text, any_of([fv.GLASS_HEADER, fv.HALF_HEADER, fv.MAGNUM_HEADER, fv.BOTTLE_HEADER]))


def entry_suffix(section: Column) -> Column:
    """Ending shown after the name of a glass, half-bottle or magnum entry."""
    out = F.lit("")
    for name, suffix in fv.SUFFIXES.items():
        out = F.when(section == name, suffix).otherwise(out)
    return out


def bottle_equivalent(price: Column, section: Column) -> Column:
    """Price of 750 ml: glass x pours, half x 2, magnum / 2, rounded to cents."""
    p = price.cast("decimal(12,2)")
    scaled = (
        F.when(section == "glass", p * fv.POURS_PER_BOTTLE)
        .when(section == "half", p * 2)
        .when(section == "magnum", F.round(p / 2, 2))
        .otherwise(p)
    )
    return scaled.cast("decimal(12,2)")


# ------------------------------------------------------------------ HTML
def html_to_text(html: Column) -> Column:
    out = F.regexp_replace(html, r"(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>", "")
    out = F.regexp_replace(out, r"(?i)<(?:br|p|div|tr|li|h[1-6]|section|article)[^/>]*/?>", "\n")
    out = F.regexp_replace(out, r"(?i)</(?:p|div|tr|li|h[1-6]|section|article)>", "\n")
    out = decode_entities(F.regexp_replace(out, r"<[^>]+>", " "))
    out = F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r"\n[ \t]*\n+", "\n")
    return F.regexp_replace(out, r"^\s+|\s+$", "")


@lru_cache(maxsize=1)
def _entity_table() -> list[tuple[str, str]]:
    from html.entities import name2codepoint

    return sorted((name, chr(cp)) for name, cp in name2codepoint.items()) + [("apos", "'")]


def decode_entities(text: Column) -> Column:
    """Named, decimal and hexadecimal character references in one pass."""
    pairs = [c for name, ch in _entity_table() for c in (F.lit(name), F.lit(ch))]
    table = F.create_map(*pairs)
    head = F.split(text, "&", -1)

    def one(piece: Column) -> Column:
        name = F.regexp_extract(piece, r"^(#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);", 1)
        code = (
            F.when(F.startswith(F.lower(name), F.lit("#x")), F.conv(F.substring(name, 3, 8), 16, 10))
            .when(F.startswith(name, F.lit("#")), F.substring(name, 2, 8))
            .try_cast("int")
        )
        point = F.when(code.between(1, 0x10FFFF), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        char = F.when(name == "", F.lit(None)).when(F.startswith(name, F.lit("#")), point).otherwise(
            F.try_element_at(table, name)
        )
        rest = F.substring(piece, F.length(name) + 2, F.length(piece))
        return F.when(char.isNull(), F.concat(F.lit("&"), piece)).otherwise(F.concat(char, rest))

    decoded = F.concat(
        F.get(head, F.lit(0)),
        F.array_join(F.transform(F.slice(head, F.lit(2), F.size(head)), one), ""),
    )
    return F.when(F.contains(text, F.lit("&")), decoded).otherwise(text)
