"""DuckDB text of the input views and of shared expressions."""

from __future__ import annotations

import re

from pourscale import fixed_values as fv
from pourscale.checks.views import EXTRAS, GRAPES, PLACES, STYLES
from pourscale.sources import lookups as lk

AS_OF = "TIMESTAMP '2024-02-01 00:00:00'"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(options) -> str:
    return "[" + ", ".join(quote(o) for o in options) + "]"


def re2(pattern: str) -> str:
    """The same pattern in the other engine's syntax: no Unicode flag."""
    flags = re.match(r"\(\?([a-zA-Z]+)\)", pattern)
    if flags:
        kept = flags.group(1).replace("U", "")
        pattern = (f"(?{kept})" if kept else "") + pattern[flags.end():]
    return pattern.replace(r"[\w", r"[\pL\pN_")


def sub(expr: str, pattern: str, repl: str = "") -> str:
    return f"regexp_replace({expr}, {quote(re2(pattern))}, {quote(re.sub(r'[$](\d)', r'\\\1', repl))}, 'g')"


def sub1(expr: str, pattern: str, repl: str = "") -> str:
    return f"regexp_replace({expr}, {quote(re2(pattern))}, {quote(re.sub(r'[$](\d)', r'\\\1', repl))})"


def has(expr: str, pattern: str) -> str:
    return f"regexp_matches({expr}, {quote(re2(pattern))})"


def chain(expr: str, rules) -> str:
    for pattern, repl in rules:
        expr = sub(expr, pattern, repl)
    return expr


def normalize(expr: str) -> str:
    spelled = chain(f"lower(strip_accents({expr}))", fv.SHORT_FORMS)
    return f"trim({sub(spelled, '[^a-z0-9]+', ' ')})"


def normalize_producer(expr: str) -> str:
    plain = sub(f"strip_accents(lower({expr}))", "[^a-z0-9]+", " ")
    return f"trim({chain(plain, fv.PRODUCER_FORMS)})"


def lookup_key(expr: str) -> str:
    spaced = sub(f"strip_accents(lower({expr}))", "[-'’‘]", " ")
    return f"trim({sub(sub(spaced, '[^a-z0-9 ]', ''), r'\s+', ' ')})"


def expand_terms(expr: str) -> str:
    return chain(expr, [(rf"(?i)\b{a}\b", b) for a, b in fv.TERM_FORMS])


def producer_key(expr: str) -> str:
    bare = sub(f"strip_accents(lower({expr}))", r"(?i)\b(" + "|".join(fv.HOUSE_WORDS) + r")\b", "")
    return f"trim({sub(bare, r'\s{2,}', ' ')})"


def other_key(condition: str, other: str = "z") -> str:
    return f"CASE WHEN {condition} THEN wine_id ELSE '{other}' || wine_id END"


def slug(expr: str, limit: int | None = None) -> str:
    out = sub(sub(f"strip_accents(lower({expr}))", "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return f"left({out}, {limit})" if limit else out


def listing_text(expr: str) -> str:
    return f"trim({sub(f'lower(strip_accents({expr}))', '[^a-z0-9 ]', ' ')})"


def tokens(expr: str) -> str:
    return (
        f"list_distinct(list_filter(string_split({expr}, ' '), lambda t: length(t) >= {fv.MIN_TOKEN} "
        f"AND NOT list_contains({values(fv.STOP_WORDS)}, t)))"
    )


def tier(price: str) -> str:
    cases = " ".join(f"WHEN {price} <= {u} THEN '{n}'" for n, u, *_ in fv.TIERS if u)
    return f"CASE WHEN {price} IS NULL THEN NULL {cases} ELSE 'ultra' END"


_FIELD = {"wholesale_ratio": 2, "ideal": 3, "fair_low": 4, "fair_high": 5, "excessive": 6, "ttl_days": 7}


def tier_value(col: str, field: str) -> str:
    i = _FIELD[field]
    default = fv.DEFAULT_WHOLESALE_RATIO if field == "wholesale_ratio" else next(r[i] for r in fv.TIERS if r[0] == "mid")
    cases = " ".join(f"WHEN '{r[0]}' THEN {r[i]}" for r in fv.TIERS)
    return f"(CASE {col} {cases} ELSE {default} END)"


def wholesale(retail: str, tier_col: str) -> str:
    return f"CAST(round(CAST({retail} AS DECIMAL(12,2)) * CAST({tier_value(tier_col, 'wholesale_ratio')} AS DECIMAL(4,2)), 2) AS DECIMAL(12,2))"


def ratio(a: str, b: str, d: int = 3) -> str:
    n, m = f"CAST(round(CAST({a} AS DOUBLE) * 100) AS BIGINT) * {10 ** d}", f"CAST(round(CAST({b} AS DOUBLE) * 100) AS BIGINT)"
    up = f"CASE WHEN 2 * (({n}) % {m}) > {m} OR (2 * (({n}) % {m}) = {m} AND (({n}) // {m}) % 2 = 1) THEN 1 ELSE 0 END"
    return f"CASE WHEN {b} <> 0 THEN ((({n}) // {m}) + {up}) / CAST({10 ** d} AS DOUBLE) END"


def score(m: str, t: str) -> str:
    lo, hi, top = (f"CAST({tier_value(t, f)} AS DOUBLE)" for f in ("fair_low", "fair_high", "excessive"))
    return (
        f"CASE WHEN {m} IS NULL THEN NULL ELSE CAST(greatest(0, CASE "
        f"WHEN {m} <= {lo} THEN least(100.0, round_even(85 + ({lo} - {m}) / {lo} * 30, 0)) "
        f"WHEN {m} <= {hi} THEN round_even(85 - ({m} - {lo}) / ({hi} - {lo}) * 25, 0) "
        f"WHEN {m} <= {top} THEN round_even(60 - ({m} - {hi}) / ({top} - {hi}) * 40, 0) "
        f"ELSE round_even(20.0 * exp(-3.0 * (({m} - {top}) / {top})), 0) END) AS INTEGER) END"
    )


def verdict(s: str, field: int = 1) -> str:
    cases = " ".join(f"WHEN {s} >= {r[0]} THEN '{r[field]}'" for r in fv.VERDICTS)
    return f"CASE WHEN {s} IS NULL THEN NULL {cases} ELSE '{fv.VERDICTS[-1][field]}' END"


def whole(x: str) -> str:
    return f"CAST(CAST(round_even(CAST({x} AS DOUBLE), 0) AS BIGINT) AS VARCHAR)"


def one(x: str) -> str:
    return f"printf('%.1f', round_even(CAST({x} AS DOUBLE), 1))"


def level(s: str) -> str:
    return "CASE " + " ".join(f"WHEN {s} >= {f} THEN '{n}'" for f, n in fv.CONFIDENCE_LEVELS) + " ELSE 'none' END"


def deal(menu: str, retail: str) -> str:
    x = f"(CASE WHEN {retail} <> 0 THEN CAST({menu} AS DOUBLE) / CAST({retail} AS DOUBLE) END)"
    return f"CASE WHEN {x} IS NULL THEN 'unknown' WHEN {x} < 0.8 THEN 'steal' WHEN {x} <= 1.5 THEN 'good' WHEN {x} <= 2.5 THEN 'fair' ELSE 'expensive' END"


def flags(menu: str, whole_: str, wm: str, rm: str, t: str) -> str:
    return (
        f"CASE WHEN {wm} IS NOT NULL THEN array_to_string(list_filter([CASE WHEN {wm} <= {tier_value(t, 'fair_low')} THEN 'below_market' END, "
        f"CASE WHEN {wm} >= {tier_value(t, 'excessive')} THEN 'excessive_markup' END, "
        f"CASE WHEN coalesce({rm}, 0) >= 4.0 THEN 'price_gouging' END, "
        f"CASE WHEN coalesce({rm}, 0) <= 1.0 THEN 'below_retail' END, "
        f"CASE WHEN {menu} < {whole_} THEN 'below_wholesale' END], lambda f: f IS NOT NULL), '|') END"
    )


def insight(menu: str, retail: str, ws: str, m: str, t: str) -> str:
    lo, hi, top = (tier_value(t, f) for f in ("fair_low", "fair_high", "excessive"))
    span = f"{one(lo)} || '–' || {one(hi)} || '×'"
    return (
        f"CASE WHEN {m} IS NULL THEN NULL WHEN {menu} <= {ws} THEN 'At $' || {whole(menu)} || ', this wine is priced at or below estimated wholesale (~$' || {whole(ws)} || ').  This is an extraordinary value.' "
        f"WHEN {m} <= {lo} THEN 'Priced at ' || {one(m)} || '× estimated wholesale ($' || {whole(ws)} || '), this is below the typical restaurant range of ' || {span} || '. Great value relative to a retail price of ~$' || {whole(retail)} || '.' "
        f"WHEN {m} <= {hi} THEN 'At $' || {whole(menu)} || ' (' || {one(m)} || '× estimated wholesale), this falls within the typical restaurant range of ' || {span} || '. Retail is ~$' || {whole(retail)} || '.' "
        f"WHEN {m} <= {top} THEN 'At $' || {whole(menu)} || ', the markup is ' || {one(m)} || '× estimated wholesale ($' || {whole(ws)} || '), above the typical range of ' || {span} || '. Average retail is ~$' || {whole(retail)} || '.' "
        f"ELSE 'At $' || {whole(menu)} || ', the markup is ' || {one(m)} || '× estimated wholesale ($' || {whole(ws)} || ').  Average retail is ~$' || {whole(retail)} || '. This significantly exceeds the typical restaurant range of ' || {span} || '.' END"
    )


def upper_median(price: str) -> str:
    return f"list_sort(list({price}))[CAST(floor(count({price}) / 2) AS BIGINT) + 1]"


# ------------------------------------------------------------------ similarity
def lcs(a: str, b: str) -> str:
    """Common subsequence length with one 120-bit word per text."""
    full = f"((1::HUGEINT << CAST(length({b}) AS INTEGER)) - 1::HUGEINT)"
    mask = (
        f"list_transform(string_split({a}, ''), lambda c: coalesce(list_sum(list_transform(range(1, length({b}) + 1), "
        f"lambda j: CASE WHEN substr({b}, j, 1) = c THEN 1::HUGEINT << CAST(j - 1 AS INTEGER) ELSE 0::HUGEINT END))::HUGEINT, 0::HUGEINT))"
    )
    step = f"lambda v, m: ((v + (v & m)) | (v - (v & m))) & {full}"
    rest = f"list_reduce(list_prepend({full}, {mask}), {step})"
    return f"(length({b}) - bit_count(CAST({rest} AS HUGEINT)))"


def indel(a: str, b: str) -> str:
    return (
        f"CASE WHEN {a} = {b} THEN 1.0 WHEN length({a}) = 0 OR length({b}) = 0 THEN 0.0 "
        f"ELSE 2.0 * {lcs(a, b)} / (length({a}) + length({b})) END"
    )


VIEWS: dict[str, tuple[list[str], str]] = {}


def cents(x: str) -> str:
    return f"CAST(CAST(floor({x} * 100) AS BIGINT) / 100 AS DECIMAL(12,2))"


def mean(total: str, n: str) -> str:
    """Decimal mean to the cent, half up, in whole numbers."""
    return f"CAST((2 * CAST({total} * 100 AS HUGEINT) + {n}) // (2 * {n}) / 100 AS DECIMAL(12,2))"


def _kind() -> str:
    return "upper(p_type[1]) || lower(p_type[2:])"


def _producer() -> str:
    k = _kind()
    return f"CASE WHEN p_size % 4 = 0 THEN 'Château ' || {k} WHEN p_size % 4 = 1 THEN {k} || ' Estate' ELSE {k} || ' House' END"


def _title(c: str) -> str:
    return (
        f"array_to_string(list_transform(string_split({c}, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"
    )


_PRICE = cents("l_extendedprice / l_quantity / (1 + l_partkey % 40)")
_AMOUNT = "(1 + CAST(floor(l_extendedprice) AS BIGINT) % 400)"

VIEWS["cat"] = ([], f"""
  SELECT 'p' || p_partkey AS id, p_partkey AS catalog_ordinal, {_title('p_name')} AS name, {_producer()} AS producer,
    n_name || ', ' || r_name AS region, n_name AS country, r_name AS appellation,
    {values(GRAPES)}[CAST(p_size % 7 + 1 AS INTEGER)] AS varietal, {values(STYLES)}[CAST(p_size % 5 + 1 AS INTEGER)] AS wine_type,
    {cents('p_retailprice / (1 + p_partkey % 40)')} AS avg_retail_price,
    [split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1)] AS aliases,
    {tier(cents('p_retailprice / (1 + p_partkey % 40)'))} AS price_tier
  FROM part JOIN nation ON p_partkey % 25 = n_nationkey JOIN region ON n_regionkey = r_regionkey""")

VIEWS["offers"] = ([], f"""
  SELECT 'p' || l_partkey AS wine_id, 'src' || (l_suppkey % 7) AS source,
    CASE WHEN l_linenumber % 3 <> 0 THEN CAST(year(l_shipdate) AS INTEGER) END AS vintage, {_PRICE} AS price,
    CASE WHEN l_linenumber % 4 = 0 THEN '1500ml' ELSE '750ml' END AS unit, l_shipdate AS fetched_at,
    l_orderkey, l_linenumber, l_suppkey, l_partkey FROM lineitem""")

VIEWS["parts"] = ([], f"""
  SELECT l.*, {_producer()} AS producer, {_title('p_name')} AS name, {_PRICE} AS price, {_AMOUNT} AS amount,
    concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS item_id
  FROM lineitem l JOIN part ON l_partkey = p_partkey""")

VIEWS["menu"] = (["parts"], f"""
  SELECT item_id, l_orderkey AS menu_id, l_linenumber, l_suppkey, l_partkey,
    (CASE WHEN l_linenumber % 3 <> 1 THEN year(l_shipdate) || ' ' ELSE '' END)
    || (CASE WHEN l_linenumber = 6 THEN 'Ch. ' ELSE '' END) || producer
    || (CASE WHEN l_suppkey % 3 = 0 THEN ',' ELSE ', ' END) || name
    || (CASE WHEN l_suppkey % 4 = 0 THEN {values(PLACES)}[CAST(l_suppkey // 4 % 4 + 1 AS INTEGER)] ELSE '' END)
    || (CASE l_linenumber WHEN 2 THEN ' NV' WHEN 3 THEN ' Magnum' WHEN 4 THEN ' 375ml'
        WHEN 5 THEN ' $' || CAST(floor(price) AS BIGINT) WHEN 7 THEN {values(EXTRAS)}[CAST(l_suppkey % 4 + 1 AS INTEGER)] ELSE '' END) AS menu_text,
    price AS menu_price, CASE WHEN l_linenumber = 1 THEN CAST(year(l_shipdate) AS INTEGER) END AS given_vintage
  FROM parts""")

_ORDER = "ORDER BY l_partkey, l_suppkey, l_linenumber, sub_no"

VIEWS["raw_lines"] = (["parts"], f"""
  SELECT l_orderkey AS menu_id, l_partkey, l_suppkey, l_linenumber, unnest(ls) AS raw, generate_subscripts(ls, 1) - 1 AS sub_no
  FROM (SELECT *, CASE WHEN l_linenumber % 7 = 0
      THEN list_prepend(['BY THE GLASS', 'HALF BOTTLES', 'MAGNUM', 'REDS'][CAST(l_suppkey % 4 + 1 AS INTEGER)], body) ELSE body END AS ls
    FROM (SELECT *, CASE l_linenumber % 5
        WHEN 0 THEN [CASE l_suppkey % 5 WHEN 1 THEN '• ' || full_name || ' ..... $' || amount
            WHEN 2 THEN full_name || ' | ' || yr || ' | ' || amount
            WHEN 3 THEN full_name || ' ' || (10 + amount % 40) || ' ' || (40 + amount % 90)
            WHEN 4 THEN full_name || ' ' || yr || ' 92 pts 1,' || (100 + amount % 400)
            ELSE full_name || ' ' || yr || ' ' || amount END]
        WHEN 1 THEN [full_name || ' ' || (5 + amount % 60) || '/' || (9 + amount % 95)]
        WHEN 2 THEN [full_name || ' ' || (5 + amount % 20) || '/' || (15 + amount % 20) || '/' || (30 + amount % 70)]
        WHEN 3 THEN [full_name, yr || ' ' || amount]
        ELSE [full_name || ',', CASE WHEN l_suppkey % 2 = 0 THEN 'Napa Valley, California' ELSE 'irpinia, italy' END, CAST(amount AS VARCHAR)] END AS body
      FROM (SELECT *, producer || ' ' || name AS full_name, CAST(1990 + l_partkey % 30 AS VARCHAR) AS yr FROM parts)))""")


def clean_line(c: str) -> str:
    """Line cleaning without look-around: digit groups are bounded by what surrounds them."""
    out = (
        f"CASE WHEN contains({c}, '|') THEN array_to_string(list_filter(list_transform(string_split({c}, '|'), "
        f"lambda p: trim(p)), lambda p: p <> ''), ' ') ELSE {c} END"
    )
    for sep in (",", r"\.", r"\."):  # twice: a match here eats the character the next one starts with
        out = sub(out, rf"(^|[^\d])(\d{{1,3}}){sep}(\d{{3}})($|[^\d])", "$1$2$3$4")
    out = sub(sub(out, fv.FILL, " "), r"\s{2,}", " ")
    out = sub(out, r"^\s+|\s+$", "")
    out = sub(sub(out, fv.LEAD_MARKS, ""), fv.ASK_TAIL, "")
    out = sub(f"trim({out})", fv.MARKET_TAIL, "")
    out = sub(f"trim({out})", fv.CRITIC_SCORE, "")
    return sub(sub(f"trim({out})", r"\s{2,}", " "), r"^\s+|\s+$", "")


VIEWS["lines"] = (["raw_lines"], f"""
  SELECT menu_id, CAST(row_number() OVER (PARTITION BY menu_id {_ORDER}) - 1 AS INTEGER) AS line_no, line
  FROM (SELECT *, {clean_line('raw')} AS line FROM raw_lines) WHERE line <> ''""")

VIEWS["docs"] = ([], "SELECT doc_id AS menu_id, text AS content FROM documents")

VIEWS["html"] = ([], """
  SELECT page_id, url, html, html || '<script type="application/ld+json">{"@type":"Product","name":"House ' || page_id || ' ' || (1990 + page_id % 30)
    || '","url":"https://shop.example/wines/' || page_id || '","offers":' || CASE WHEN page_id % 3 = 0 THEN '[' ELSE '' END
    || '{"price":"' || CASE WHEN page_id % 5 = 0 THEN '1,' ELSE '' END || (100 + page_id % 700) || '.50"}' || CASE WHEN page_id % 3 = 0 THEN ']' ELSE '' END
    || ',"aggregateRating":{"ratingValue":"4.' || (page_id % 10) || '","reviewCount":"' || (page_id % 90) || '"}}</script>'
    || CASE WHEN page_id % 2 = 0 THEN '<a href="/products/' || page_id || '"><h2 class="x">Linked ' || (1990 + page_id % 30) || '</h2></a>'
       ELSE '<h3>Headed bottle ' || (1990 + page_id % 30) || '</h3>' END
    || '<p>$' || CASE WHEN page_id % 7 = 0 THEN '2,' ELSE '' END || (100 + page_id % 800) || '.25</p><span data-price="' || (3 + page_id % 60) || '.5"></span>' AS shop_html
  FROM pages""")

VIEWS["ev"] = ([], f"""
  SELECT event_id, user_id AS job_id, json_extract_string(props, '$.k') AS wine_id, {cents('value')} AS price,
    event_type AS kind, ts AS seen_at, props FROM events""")

VIEWS["pipe_lines"] = (["parts"], """
  SELECT l_orderkey AS menu_id, l_partkey * 1000000 + l_suppkey * 10 + l_linenumber AS line_no,
    producer || ' ' || name AS nm,
    CASE l_linenumber % 4 WHEN 0 THEN 'NV' WHEN 1 THEN 'none' ELSE CAST(year(l_shipdate) AS VARCHAR) END AS mark,
    CASE l_suppkey % 5 WHEN 0 THEN '$' || amount WHEN 1 THEN amount || '/' || (amount + 15)
      WHEN 2 THEN amount || '/' || (amount + 10) || '/' || (amount + 40) WHEN 3 THEN '1,' || (100 + amount) ELSE 'MP' END AS money,
    CASE WHEN l_linenumber % 3 = 0 THEN ' | glass' ELSE '' END AS tail FROM parts""")

VIEWS["free_lines"] = (["parts"], f"""
  SELECT menu_id, CAST(row_number() OVER (PARTITION BY menu_id {_ORDER}) - 1 AS INTEGER) AS line_no, line FROM (
    SELECT l_orderkey AS menu_id, l_partkey, l_suppkey, l_linenumber, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS sub_no
    FROM (SELECT *, CASE WHEN l_linenumber = 7 THEN [CASE WHEN l_suppkey % 2 = 0 THEN 'Red (5oz/9oz)' ELSE 'Wines by the bottle' END, body] ELSE [body] END AS ls
      FROM (SELECT *, CASE l_suppkey % 4
        WHEN 0 THEN '• ' || producer || ' ' || name || ' — Napa, California ' || (1990 + l_partkey % 30) || ' — $' || amount || '/' || (amount + 20)
        WHEN 1 THEN '- ' || producer || ' ' || name || ' - Irpinia - $' || amount
        WHEN 2 THEN producer || ' ' || name || ' ' || (1990 + l_partkey % 30) || ' $' || (10 + amount)
        ELSE '* ' || name || ' (5 oz) — $' || (6 + amount % 30) || '/' || (20 + amount % 30) || '/' || (60 + amount % 30) END AS body FROM parts)))""")

VIEWS["pairs"] = ([], """
  SELECT DISTINCT CASE l_linenumber % 4 WHEN 1 THEN a.p_name[1] || a.p_name[3:] WHEN 2 THEN split_part(a.p_name, ' ', 2) || ' ' || split_part(a.p_name, ' ', 1)
      WHEN 3 THEN a.p_name || ' ' || lower(a.p_type) || ' house' ELSE a.p_name END AS a, b.p_name AS b
  FROM lineitem JOIN part a ON l_partkey = a.p_partkey JOIN part b ON l_suppkey = b.p_partkey""")


# ------------------------------------------------------------------ parsed items
def _sizes(t: str) -> str:
    cases = " ".join(f"WHEN {has(t, p)} THEN {ml}" for p, ml in fv.NAMED_SIZES)
    unit = f"lower(regexp_extract({t}, {quote(fv.SIZE_TEXT)}, 2))"
    amount = f"TRY_CAST(regexp_extract({t}, {quote(fv.SIZE_TEXT)}, 1) AS DOUBLE)"
    return f"CASE {cases} ELSE CAST(floor({amount} * CASE WHEN {unit} IN ('l','ltr','litre','liter') THEN 1000 WHEN {unit} = 'cl' THEN 10 ELSE 1 END) AS INTEGER) END"


def _strip_sizes(t: str) -> str:
    for p, _ in fv.NAMED_SIZES:
        t = sub(t, p, " ")
    return sub(t, fv.SIZE_TEXT, " ")


def varietal(n: str) -> str:
    rules = [(label, p.replace(r"(?!\s+franc)", "").replace(r"(?!\s+doc)", "")) for p, label in fv.GRAPE_RULES]
    return "CASE " + " ".join(f"WHEN {has(n, p)} THEN {quote(label)}" for label, p in rules) + " END"


def region(n: str) -> str:
    rows = ", ".join(f"({quote(w)}, {quote(r)}, {i})" for w, r, i in lk.region_rows())
    return (
        f"(SELECT arg_max(r, length(w) * 1000 - i) FROM (VALUES {rows}) k(w, r, i) WHERE contains({n}, w))"
    )


def style(n: str) -> str:
    return "CASE " + " ".join(
        f"WHEN {has(n, chr(92) + 'b(?:' + '|'.join(ws) + ')' + chr(92) + 'b')} THEN '{s}'" for s, ws in fv.STYLE_WORDS
    ) + " END"


VIEWS["p1"] = (["menu"], f"SELECT *, trim({sub('menu_text', fv.PRICE_TEXT, ' ')}) AS t1 FROM menu")
VIEWS["p2"] = (["p1"], f"SELECT *, {_sizes('t1')} AS format_ml, {_strip_sizes('t1')} AS t2 FROM p1")
VIEWS["p3"] = (["p2"], f"SELECT *, TRY_CAST(regexp_extract(t2, {quote(fv.YEAR)}, 1) AS INTEGER) AS parsed_vintage, {sub1('t2', fv.YEAR, ' ')} AS t3 FROM p2")
VIEWS["p4"] = (["p3"], f"SELECT *, {has('t3', fv.NON_VINTAGE)} AS non_vintage, {sub('t3', fv.NON_VINTAGE, ' ')} AS t4 FROM p3")
VIEWS["p5"] = (["p4"], f"SELECT *, trim({sub('t4', fv.SEPARATOR_RUN, ' ')}) AS cleaned_text FROM p4")
VIEWS["p6"] = (["p5"], f"SELECT *, {normalize('cleaned_text')} AS normalized_search FROM p5")
VIEWS["known"] = (["p6"], f"""
  SELECT n AS normalized_search, {varietal('n')} AS parsed_varietal, {style('n')} AS parsed_type, {region('n')} AS parsed_region
  FROM (SELECT DISTINCT normalized_search AS n FROM p6)""")
VIEWS["parsed"] = (["p6", "known"], """
  SELECT p6.*, parsed_varietal, parsed_type, parsed_region,
    CASE WHEN contains(cleaned_text, ',') THEN nullif(trim(split_part(cleaned_text, ',', 1)), '') ELSE nullif(trim(cleaned_text), '') END AS parsed_producer,
    CASE WHEN contains(cleaned_text, ',') THEN nullif(trim(substr(cleaned_text, strpos(cleaned_text, ',') + 1)), '') END AS parsed_name,
    coalesce(given_vintage, parsed_vintage) AS vintage
  FROM p6 JOIN known USING (normalized_search)""")

# lookup samples
def _rows(rows) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(quote(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


VIEWS["reference"] = ([], f"SELECT * FROM ({_rows(lk.SAMPLE_REFERENCE)}) t(key, low, mid, high, ordinal)")
VIEWS["varietals"] = ([], f"SELECT * FROM ({_rows(lk.SAMPLE_VARIETAL)}) t(key, low, mid, high, ordinal)")
VIEWS["premiums"] = ([], f"SELECT * FROM ({_rows(lk.SAMPLE_PREMIUMS)}) t(key, multiplier, note, ordinal)")
VIEWS["hints"] = ([], f"SELECT * FROM ({_rows(lk.SAMPLE_HINTS)}) t(key, implied, ordinal)")

# prices per source and merged
VIEWS["banded"] = (["offers"], "SELECT * FROM offers WHERE price BETWEEN 5 AND 50000")
VIEWS["source_prices"] = (["banded"], f"""
  SELECT wine_id, source, {mean('sum(price)', 'count(price)')} AS avg_price,
    min(price) AS min_price, max(price) AS max_price, {upper_median('price')} AS median_price, CAST(count(price) AS INTEGER) AS num_listings
  FROM banded GROUP BY wine_id, source""")
VIEWS["marked"] = (["source_prices"], """
  SELECT *, NOT coalesce(tm > 0 AND om > 0 AND tm / om >= 4.0, false) OR source = 'src0' AS counted FROM (
    SELECT *, avg(avg_price) FILTER (source = 'src0') OVER (PARTITION BY wine_id) AS tm,
      avg(avg_price) FILTER (source <> 'src0') OVER (PARTITION BY wine_id) AS om FROM source_prices)""")
VIEWS["merged0"] = (["marked"], f"""
  SELECT wine_id, {mean('sum(CASE WHEN counted THEN avg_price * num_listings END)', 'sum(CASE WHEN counted THEN num_listings END)')} AS avg_retail,
    min(min_price) FILTER (counted) AS min_retail, max(max_price) FILTER (counted) AS max_retail,
    {mean('sum(CASE WHEN counted THEN median_price END)', 'count(CASE WHEN counted THEN median_price END)')} AS median_retail,
    CAST(count(*) AS INTEGER) AS n_sources, CAST(sum(num_listings) AS BIGINT) AS total_listings FROM marked GROUP BY wine_id""")
VIEWS["merged"] = (["merged0", "cat"], f"""
  SELECT c.id AS wine_id, c.avg_retail_price AS base_price, c.price_tier, avg_retail, min_retail, max_retail, coalesce(median_retail, avg_retail) AS median_retail,
    CASE WHEN n_sources > 0 THEN {wholesale('coalesce(avg_retail, c.avg_retail_price)', 'c.price_tier')} END AS estimated_wholesale,
    CASE WHEN n_sources > 0 THEN 'aggregated' ELSE 'no_data' END AS source,
    CASE WHEN coalesce(n_sources, 0) = 0 THEN 'none' WHEN n_sources >= 2 AND total_listings >= 10 THEN 'high' ELSE 'medium' END AS data_confidence,
    coalesce(n_sources, 0) AS n_sources, coalesce(total_listings, 0) AS total_listings
  FROM cat c LEFT JOIN merged0 m ON m.wine_id = c.id""")


def q(views: str, body: str) -> str:
    """Query text with the named views and all they need in front."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in order:
            return
        for dep in VIEWS[name][0]:
            add(dep)
        order.append(name)

    for name in views.split():
        add(name)
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in order) + "\n" + body


def millionths(expr: str) -> str:
    """A number of zero or more in six decimals: whole billionths first, so that halves fall alike in both engines."""
    return f"CAST((CAST(round(CAST({expr} AS DOUBLE) * 1000000000) AS BIGINT) + 500) // 1000 AS DOUBLE) / 1000000"


def clone(top: str, base: str, suffix: str) -> str:
    """The same views from ``base`` up to ``top`` over another base, the view base + suffix; gives the new name of top."""

    def above(name: str) -> bool:
        return name == base or any(above(d) for d in VIEWS[name][0])

    def renamed(text: str, name: str) -> str:
        text = re.sub(rf"(?i)(\b(?:from|join)\s+|,\s*)({name})\b(?=\s|,|\)|$)", rf"\g<1>\g<2>{suffix}", text)
        return re.sub(rf"\b{name}\.", f"{name}{suffix}.", text)

    def add(name: str) -> None:
        if name + suffix in VIEWS:
            return
        needs, text = VIEWS[name]
        for d in [d for d in needs if above(d)]:
            add(d)
            text = renamed(text, d)
        VIEWS[name + suffix] = ([d + suffix if above(d) else d for d in needs], text)

    add(top)
    return top + suffix
