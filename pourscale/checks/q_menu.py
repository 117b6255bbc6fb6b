"""Queries of the menu parsers."""

from pyspark.sql import functions as F

from pourscale import fixed_values as fv
from pourscale.checks import sql as s, views as v
from pourscale.checks.registry import register
from pourscale.functions import text as tx
from pourscale.operators import menu as m

V = s.VIEWS
_GLASS, _HALF, _MAG, _BOTTLE = fv.GLASS_HEADER, fv.HALF_HEADER, fv.MAGNUM_HEADER, fv.BOTTLE_HEADER
_DUAL, _TRIPLE = r"(\d{1,3})/(\d{1,3})", r"(\d{1,3})/(\d{1,3})/(\d{1,3})"
_NUM = r"\d+(?:\.\d{1,2})?"

# numbers of a line that are no years and lie in the menu band
V["lf0"] = (["lines"], rf"""
  SELECT menu_id, line_no, line, list_filter(regexp_extract_all(line, '{_NUM}'),
      lambda d: length(split_part(d, '.', 1)) BETWEEN 2 AND 5 AND NOT regexp_matches(d, '^(19|20)\d{{2}}$') AND CAST(d AS DOUBLE) BETWEEN 8 AND 50000) AS nums,
    regexp_matches(line, '{_TRIPLE}') AS is_triple, regexp_matches(line, '{_DUAL}') AS is_dual,
    CASE WHEN {s.has('line', _GLASS)} THEN 'glass' WHEN {s.has('line', _HALF)} THEN 'half' WHEN {s.has('line', _MAG)} THEN 'magnum'
      WHEN {s.has('line', _BOTTLE)} THEN 'bottle'
      WHEN line = upper(line) AND length(line) BETWEEN 3 AND 45 AND NOT regexp_matches(line, '(^|[^0-9])[0-9]{{2,5}}($|[^0-9])') AND NOT regexp_matches(line, '{_DUAL}') THEN 'bottle' END AS marker,
    replace(upper(regexp_extract_all(line, {s.quote(s.re2(fv.LINE_YEAR))}, 1)[-1]), '.', '') AS mark FROM lines""")
V["lf"] = (["lf0"], r"""
  SELECT *, len(nums) > 0 OR is_triple OR is_dual AS priced,
    CASE WHEN is_triple THEN regexp_extract(line, '^(.*?)\d{1,3}/', 1) WHEN is_dual THEN regexp_extract(line, '^(.*?)\d{1,3}/\d', 1) END AS slash_before,
    CASE WHEN is_triple THEN CAST(regexp_extract_all(line, '\d+')[-3] AS INTEGER) END AS t1, CASE WHEN is_triple THEN CAST(regexp_extract_all(line, '\d+')[-2] AS INTEGER) END AS t2,
    CASE WHEN is_triple THEN CAST(regexp_extract_all(line, '\d+')[-1] AS INTEGER) END AS t3,
    CASE WHEN is_dual THEN CAST(regexp_extract(line, '(\d{1,3})/(\d{1,3})', 1) AS INTEGER) END AS d1,
    CASE WHEN is_dual THEN CAST(regexp_extract(line, '(\d{1,3})/(\d{1,3})', 2) AS INTEGER) END AS d2,
    CASE WHEN len(nums) > 0 THEN regexp_extract(line, '^(.*?)[$]?' || replace(nums[-1], '.', '[.]') || '[^0-9]*(/[0-9])?$', 1) END AS last_before,
    CASE WHEN len(nums) > 1 THEN regexp_extract(line, '^(.*?)[$]?' || nums[-2] || '[^0-9]+' || nums[-1] || '[^0-9]*$', 1) END AS prev_before
  FROM lf0""")
V["sec"] = (["lf"], """
  SELECT *, coalesce(last_value(marker IGNORE NULLS) OVER (PARTITION BY menu_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'bottle') AS section,
    lead(line, 1) OVER w AS line_1, lead(line, 2) OVER w AS line_2, lead(priced, 1) OVER w AS priced_1, lead(mark, 1) OVER w AS mark_1,
    lead(nums, 1) OVER w AS nums_1, lead(nums, 2) OVER w AS nums_2, lead(last_before, 1) OVER w AS before_1, lead(last_before, 2) OVER w AS before_2,
    lead(is_triple, 1) OVER w AS is_triple_1, lead(is_dual, 1) OVER w AS is_dual_1, lead(t1, 1) OVER w AS t1_1, lead(t2, 1) OVER w AS t2_1, lead(t3, 1) OVER w AS t3_1,
    lead(d1, 1) OVER w AS d1_1, lead(d2, 1) OVER w AS d2_1, lead(slash_before, 1) OVER w AS slash_1
  FROM lf WINDOW w AS (PARTITION BY menu_id ORDER BY line_no)""")


def _mark(t):
    return f"replace(upper(regexp_extract_all({t}, {s.quote(s.re2(fv.LINE_YEAR))}, 1)[-1]), '.', '')"


def _nomark(t):
    return f"trim({s.sub(t, fv.LINE_YEAR_INLINE, '')})"


_OTHER = r"(?i)\b(" + "|".join(fv.OTHER_BEVERAGES) + r")\b"
_SECTION_TEXT = lambda c: " OR ".join(s.has(c, p) for p in (_GLASS, _HALF, _MAG, _BOTTLE))
_NAME_OK = (
    f"NOT priced AND length(line) >= 5 AND NOT {s.has('line', fv.HEADER_LINE)} AND NOT {s.has('line', _OTHER)} AND NOT ({_SECTION_TEXT('line')})"
)
_TOK = "t3 BETWEEN 8 AND 50000 AND t1 <= t2 AND t2 < t3"
_DOK = "d1 BETWEEN 8 AND 50000 AND d2 BETWEEN 8 AND 50000"
_NEXT = "CASE WHEN NOT priced_1 THEN mark_1 END"
_GAP = "length(last_before) - length(prev_before) - length(nums[-2])"
_SHARE = "CAST(nums[-1] AS DOUBLE) / CAST(nums[-2] AS DOUBLE)"
V["c_triple"] = (["sec"], f"SELECT menu_id, line_no, 1 AS step, 0 AS sub, {_nomark('trim(slash_before)')} AS raw_desc, {_mark('slash_before')} AS mark, CAST(t3 AS DOUBLE) AS price, 'bottle' AS section FROM sec WHERE is_triple AND {_TOK}")
V["c_dual"] = (["sec"], f"SELECT menu_id, line_no, 1 AS step, 0 AS sub, CASE WHEN mk IS NULL THEN trim(slash_before) ELSE {_nomark('trim(slash_before)')} END AS raw_desc, mk AS mark, CAST(least(d1, d2) AS DOUBLE) AS price, 'glass' AS section FROM (SELECT *, coalesce({_mark('slash_before')}, {_NEXT}) AS mk FROM sec) WHERE is_dual AND NOT is_triple AND {_DOK}")
V["c_two"] = (["sec"], f"""SELECT menu_id, line_no, 1 AS step, sub, CASE WHEN mk IS NULL THEN trim(prev_before) ELSE {_nomark('trim(prev_before)')} END AS raw_desc, mk AS mark,
    CAST(CASE sub WHEN 0 THEN nums[-2] ELSE nums[-1] END AS DOUBLE) AS price, CASE WHEN sub = 0 THEN 'glass' WHEN section = 'glass' THEN 'bottle' ELSE section END AS section
  FROM (SELECT *, {_mark('prev_before')} AS mk FROM sec), (VALUES (0), (1)) k(sub) WHERE NOT is_triple AND NOT is_dual AND len(nums) > 1 AND {_GAP} <= 6 AND {_SHARE} BETWEEN 2.0 AND 8.0""")
V["c_one"] = (["sec"], f"SELECT menu_id, line_no, 1 AS step, 0 AS sub, CASE WHEN {_mark('last_before')} IS NULL THEN trim(last_before) ELSE {_nomark('trim(last_before)')} END AS raw_desc, coalesce({_mark('last_before')}, {_NEXT}) AS mark, CAST(nums[-1] AS DOUBLE) AS price, section FROM sec WHERE NOT is_triple AND NOT is_dual AND len(nums) = 1")
V["c_three"] = (["sec"], f"""SELECT menu_id, line_no, 2 AS step, 0 AS sub, concat_ws(' ', trim(regexp_replace({_nomark('line')}, ',+$', '')), line_1) AS raw_desc,
    coalesce({_mark('before_2')}, {_mark('line_2')}, mark, mark_1) AS mark, CAST(nums_2[-1] AS DOUBLE) AS price, section
  FROM sec WHERE {_NAME_OK} AND NOT priced_1 AND NOT {s.has('line_1', fv.HEADER_LINE)} AND len(nums_2) > 0
    AND (suffix(line, ',') OR (length(line_1) <= 50 AND {s.has('line_1', fv.PLACE_WORDS)}) OR length(line_1) <= 30)""")
_TOK1, _DOK1 = "t3_1 BETWEEN 8 AND 50000 AND t1_1 <= t2_1 AND t2_1 < t3_1", "d1_1 BETWEEN 8 AND 50000 AND d2_1 BETWEEN 8 AND 50000"
_KEPT = "CASE WHEN section = 'glass' THEN 'bottle' ELSE section END"
V["c_next"] = (["sec"], f"""SELECT menu_id, line_no, 3 AS step, 0 AS sub, line AS raw_desc,
    CASE WHEN is_triple_1 AND {_TOK1} THEN coalesce({_mark('slash_1')}, mark) WHEN is_dual_1 AND {_DOK1} THEN coalesce({_mark('slash_1')}, mark)
      ELSE coalesce({_mark("coalesce(nullif(trim(before_1), ''), line_1)")}, mark) END AS mark,
    CASE WHEN is_triple_1 AND {_TOK1} THEN t3_1 WHEN is_dual_1 AND {_DOK1} THEN least(d1_1, d2_1) ELSE CAST(nums_1[-1] AS DOUBLE) END AS price,
    CASE WHEN is_triple_1 AND {_TOK1} THEN {_KEPT} WHEN is_dual_1 AND {_DOK1} THEN 'glass' ELSE section END AS section
  FROM sec WHERE {_NAME_OK} AND NOT {s.has('line', fv.REGION_LINE)} AND (coalesce(is_triple_1 AND {_TOK1}, false) OR coalesce(is_dual_1 AND {_DOK1}, false) OR len(nums_1) > 0)""")


def name_ok(d):
    words = f"list_filter(string_split_regex({d}, '\\s+'), lambda w: regexp_matches(w, '^\\pL+$'))"
    total = f"coalesce(list_sum(list_transform({words}, lambda w: length(w))), 0)"
    return (
        f"(length({d}) >= 4 AND NOT {s.has(d, fv.BAD_MARKS)} AND length(regexp_replace({d}, '[^\\pL\\s]', '', 'g')) / length({d}) >= 0.65 "
        f"AND len({words}) > 0 AND {total} >= 2.8 * len({words}) AND len(list_filter({words}, lambda w: length(w) >= 3)) > 0)"
    )


def clean_name(raw):
    d = s.sub(raw, fv.BIN_NUMBER, "")
    d = f"trim({s.sub(d, fv.TAIL_MARKS, '')})"
    return f"trim({s.sub(d, fv.LINE_YEAR_TAIL, '')})"


_CAPS = lambda d: f"(regexp_replace({d}, '[^a-zA-Z]', '', 'g') <> '' AND regexp_replace({d}, '[^a-zA-Z]', '', 'g') = upper(regexp_replace({d}, '[^a-zA-Z]', '', 'g')) AND regexp_matches({d}, '[-–—]'))"
_SCALE = "CAST(CASE section WHEN 'glass' THEN price * 5 WHEN 'half' THEN price * 2 WHEN 'magnum' THEN ((CAST(price * 100 AS BIGINT) + 1) // 2) / 100 ELSE price END AS DECIMAL(12,2))"
_SUFFIX = "CASE section WHEN 'glass' THEN ' (by glass)' WHEN 'half' THEN ' (half btl)' WHEN 'magnum' THEN ' (magnum ÷2)' ELSE '' END"


def added(source):
    return f"""SELECT menu_id, line_no, step, sub, name, name || {_SUFFIX} AS "desc", TRY_CAST(mark AS INTEGER) AS vintage, {_SCALE} AS menu_price,
      CASE WHEN section = 'glass' THEN CAST(price AS DECIMAL(12,2)) END AS glass_price
    FROM (SELECT *, {clean_name('raw_desc')} AS name FROM {source})
    WHERE {name_ok('name')} AND NOT {s.has('name', fv.HEADER_LINE)} AND NOT ({_SECTION_TEXT('name')}) AND NOT {s.has('name', fv.REGION_LINE)}
      AND NOT {_CAPS('name')} AND NOT {s.has('name', _OTHER)} AND {_SCALE} BETWEEN 8 AND 50000"""


def once(source):
    return f"""SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY menu_id, lower(name), vintage, CAST(floor(menu_price) AS BIGINT) ORDER BY step, line_no, sub) = 1"""


V["c_first"] = (["c_triple", "c_dual", "c_two", "c_one", "c_three"], "SELECT * FROM c_triple UNION ALL SELECT * FROM c_dual UNION ALL SELECT * FROM c_two UNION ALL SELECT * FROM c_one UNION ALL SELECT * FROM c_three")
V["e_first0"] = (["c_first"], added("c_first"))
V["e_first"] = (["e_first0"], once("e_first0"))
V["e_next"] = (["c_next", "e_first"], f"""SELECT n.* FROM ({added('c_next')}) n WHERE NOT EXISTS (SELECT 1 FROM e_first f WHERE f.menu_id = n.menu_id
    AND ((f.step = 1 AND f.line_no = n.line_no + 1) OR (f.step = 2 AND n.line_no IN (f.line_no, f.line_no + 1))))""")
V["e_all"] = (["e_first", "e_next"], "SELECT * FROM e_first UNION ALL SELECT * FROM e_next")
V["entries"] = (["e_all"], once("e_all"))

_COLS = ["menu_id", "line_no", "name", "desc", "vintage", "menu_price", "glass_price"]
_SQLCOLS = ', '.join(f'"{c}"' for c in _COLS)


def entries(spark, sf):
    return m.parse_menu(v.menu_lines(spark, sf))


def sectioned(spark, sf):
    return m.with_sections(v.menu_lines(spark, sf))


@register("parse_menu", s.q("entries", f"SELECT {_SQLCOLS}, step FROM entries"))
def _(spark, sf):
    return entries(spark, sf).select(*_COLS, "step")


@register("scan_menu_text", s.q("docs", f"""SELECT menu_id, CAST(row_number() OVER (PARTITION BY menu_id ORDER BY i) - 1 AS INTEGER) AS line_no, line FROM (
    SELECT menu_id, i, {s.clean_line('raw')} AS line FROM (SELECT menu_id, unnest(ls) AS raw, generate_subscripts(ls, 1) AS i FROM (SELECT menu_id, string_split(content, chr(10)) AS ls FROM docs))) WHERE line <> ''"""))
def _(spark, sf):
    return m.scan_menu_text(v.docs(spark, sf))


@register("section_state", s.q("sec", "SELECT menu_id, line_no, line, section FROM sec"))
def _(spark, sf):
    return m.section_state(v.menu_lines(spark, sf))


@register("line_prices", s.q("lf", "SELECT menu_id, line_no, array_to_string(nums, '|') AS prices, last_before FROM lf"))
def _(spark, sf):
    f = m.line_facts(v.lines(spark, sf))
    return f.select(
        "menu_id", "line_no", F.array_join(F.transform("prices", lambda p: p["digits"]), "|").alias("prices"),
        F.try_element_at("prices", F.lit(-1))["before"].alias("last_before"),
    )


@register("line_vintage", s.q("lf", "SELECT menu_id, line_no, mark FROM lf"))
def _(spark, sf):
    return m.line_facts(v.lines(spark, sf)).select("menu_id", "line_no", "mark")


def pass_query(name, view, which, keep):
    sql = s.q(view, f"SELECT menu_id, line_no, sub, raw_desc, mark, CAST(price AS DECIMAL(12,2)) AS price, section FROM {view}")

    @register(name, sql)
    def _(spark, sf):
        rows = m.candidates(sectioned(spark, sf).where(keep), which())
        return rows.select("menu_id", "line_no", "sub", "raw_desc", "mark", "price", "section")


_plain = "triple is null and dual is null"
pass_query("parse_triple_price", "c_triple", m.one_line_candidates, "triple is not null")
pass_query("parse_dual_price", "c_dual", m.one_line_candidates, "triple is null and dual is not null")
pass_query("parse_two_column", "c_two", m.one_line_candidates, f"{_plain} and size(prices) > 1")
pass_query("parse_single_price", "c_one", m.one_line_candidates, f"{_plain} and size(prices) = 1")
pass_query("parse_three_line", "c_three", m.three_line_candidates, "true")
pass_query("parse_two_line", "c_next", m.two_line_candidates, "true")


@register("add_entry", s.q("e_first0", f"SELECT {_SQLCOLS}, step, sub FROM e_first0"))
def _(spark, sf):
    return m.add_entry(m.candidates(sectioned(spark, sf), m.first_candidates())).select(*_COLS, "step", "sub")


@register("dedupe_entries", s.q("e_first", f"SELECT {_SQLCOLS} FROM e_first"))
def _(spark, sf):
    return m.dedupe_entries(m.add_entry(m.candidates(sectioned(spark, sf), m.first_candidates()))).select(*_COLS)


@register("cap_menu_entries", s.q("entries", f"SELECT {_SQLCOLS} FROM entries QUALIFY row_number() OVER (PARTITION BY menu_id ORDER BY step, line_no, sub) <= 3"))
def _(spark, sf):
    return m.cap_entries(entries(spark, sf), 3).select(*_COLS)


@register("bottle_equivalent", s.q("offers", "SELECT wine_id, l_orderkey, l_linenumber, l_suppkey, CAST(CASE l_linenumber % 4 WHEN 0 THEN price * 5 WHEN 1 THEN price * 2 WHEN 2 THEN ((CAST(price * 100 AS BIGINT) + 1) // 2) / 100 ELSE price END AS DECIMAL(14,2)) AS menu_price FROM offers"))
def _(spark, sf):
    n = F.col("l_linenumber") % 4
    section = F.when(n == 0, "glass").when(n == 1, "half").when(n == 2, "magnum").otherwise("bottle")
    return v.offers(spark, sf).select(
        "wine_id", "l_orderkey", "l_linenumber", "l_suppkey", tx.bottle_equivalent(F.col("price"), section).alias("menu_price")
    )


@register("entry_suffix", s.q("entries", 'SELECT menu_id, line_no, step, sub, "desc", glass_price IS NOT NULL AS by_glass FROM entries'))
def _(spark, sf):
    return entries(spark, sf).select("menu_id", "line_no", "step", "sub", "desc", F.col("glass_price").isNotNull().alias("by_glass"))


# ------------------------------------------------------------------ line filters
def line_filter(name, keep, sql):
    register(name, s.q("lines", f"SELECT menu_id, line_no, line FROM lines WHERE {sql}"))(
        lambda spark, sf: v.lines(spark, sf).where(keep(F.col("line")))
    )


line_filter("looks_like_name", tx.looks_like_name, name_ok("line"))
line_filter("reject_header_lines", lambda c: ~tx.is_header_line(c), f"NOT {s.has('line', fv.HEADER_LINE)}")
line_filter("reject_region_lines", lambda c: ~tx.is_region_line(c), f"NOT {s.has('line', fv.REGION_LINE)}")
line_filter("reject_caps_dash", lambda c: ~tx.is_caps_dash(c), f"NOT {_CAPS('line')}")


@register("reject_other_beverages", s.q("lines", f"SELECT menu_id, line_no, text_ FROM (SELECT menu_id, line_no, line || CASE line_no % 4 WHEN 0 THEN ' gin' WHEN 1 THEN ' Aleatico' ELSE '' END AS text_ FROM lines) WHERE NOT {s.has('text_', _OTHER)}"))
def _(spark, sf):
    n = F.col("line_no") % 4
    text = F.concat("line", F.when(n == 0, " gin").when(n == 1, " Aleatico").otherwise(""))
    return v.lines(spark, sf).select("menu_id", "line_no", text.alias("text_")).where(~tx.names_other_beverage(F.col("text_")))


# ------------------------------------------------------------------ other row formats
V["pipe1"] = (["pipe_lines"], """
  SELECT *, list_transform(list_filter(string_split(replace(replace(money, ',', ''), '$', ''), '/'), lambda x: x <> ''), lambda x: TRY_CAST(x AS DECIMAL(12,2))) AS vs, contains(money, '/') AS slashed FROM pipe_lines""")
V["pipe2"] = (["pipe1"], """
  SELECT menu_id, line_no, 1 AS step, 0 AS sub, nm AS name, CASE WHEN regexp_matches(mark, '^\\d{4}$') THEN CAST(mark AS INTEGER) END AS vintage,
    CASE WHEN slashed AND len(vs) >= 3 AND vs[1] < vs[2] AND vs[2] < vs[3] THEN vs[-1] WHEN slashed THEN list_min(vs) ELSE vs[1] END AS price,
    CASE WHEN slashed AND len(vs) >= 3 AND vs[1] < vs[2] AND vs[2] < vs[3] THEN 'bottle' WHEN slashed OR tail <> '' THEN 'glass' ELSE 'bottle' END AS section
  FROM pipe1 WHERE NOT list_has_any(list_transform(vs, lambda x: x IS NULL), [true])""")
V["pipe3"] = (["pipe2"], f"""SELECT menu_id, line_no, step, sub, name, name || {_SUFFIX} AS "desc", vintage, {_SCALE} AS menu_price, CASE WHEN section = 'glass' THEN price END AS glass_price
  FROM pipe2 WHERE price BETWEEN 3 AND 50000 AND {_SCALE} BETWEEN 8 AND 50000""")


@register("parse_pipe_rows", s.q("pipe3", f"SELECT {_SQLCOLS} FROM ({once('pipe3')})"))
def _(spark, sf):
    return m.parse_pipe_rows(v.pipe_lines(spark, sf)).select(*_COLS)


V["free1"] = (["free_lines"], r"""
  SELECT menu_id, line_no, line AS whole_line, trim(regexp_replace(line, '^[-\*•·▸►\d\.]+\s*', '')) AS line FROM free_lines""")
V["free2"] = (["free1"], r"""
  SELECT *, CASE WHEN regexp_matches(line, '(?i)\b\d+\s*oz\b') AND length(line) < 40 THEN 'glass' WHEN regexp_matches(line, '(?i)\bby\s+the\s+(glass|bottle)\b')
      THEN CASE WHEN contains(lower(line), 'glass') THEN 'glass' ELSE 'bottle' END END AS marker FROM free1 WHERE length(line) >= 4""")
V["free3"] = (["free2"], r"""
  SELECT *, coalesce(last_value(marker IGNORE NULLS) OVER (PARTITION BY menu_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'bottle') AS sect,
    regexp_extract_all(line, '\d+')  AS ds, regexp_matches(line, '\d+/\d+/\d+$') AS tri, regexp_matches(line, '[^/]\d/\d+$|\d\d/\d+$') AS du, regexp_matches(line, '\$\d{2,5}$') AS single FROM free2""")
V["free4"] = (["free3"], r"""
  SELECT menu_id, line_no, 1 AS step, 0 AS sub, name, CASE WHEN regexp_matches(head, '\b(19|20)\d{2}\b') THEN CAST(regexp_extract(head, '\b((?:19|20)\d{2})\b', 1) AS INTEGER) END AS vintage, CAST(price AS DECIMAL(12,2)) AS price, section FROM (
    SELECT *, trim(regexp_replace(trim(regexp_replace(CASE WHEN contains(cut, ' — ') THEN trim(split_part(cut, ' — ', 1)) WHEN contains(cut, ' – ') THEN trim(split_part(cut, ' – ', 1)) WHEN contains(cut, ' - ') THEN trim(split_part(cut, ' - ', 1)) ELSE cut END, '[\s,\-–—:;]+$', '')), '(?i)\s*\(\s*\d+\s*oz[^)]*\)', '', 'g')) AS name FROM (
      SELECT *, trim(regexp_replace(head, '\b((?:19|20)\d{2})\b', '')) AS cut FROM (
        SELECT *, trim(regexp_replace(line, '\$?\d+(/\d+)*$', '')) AS head,
          CASE WHEN tri AND CAST(ds[-3] AS INTEGER) < CAST(ds[-2] AS INTEGER) AND CAST(ds[-2] AS INTEGER) < CAST(ds[-1] AS INTEGER) THEN CAST(ds[-1] AS INTEGER)
            WHEN tri THEN least(CAST(ds[-3] AS INTEGER), CAST(ds[-2] AS INTEGER), CAST(ds[-1] AS INTEGER)) WHEN du THEN least(CAST(ds[-2] AS INTEGER), CAST(ds[-1] AS INTEGER)) WHEN single THEN CAST(ds[-1] AS INTEGER) END AS price,
          CASE WHEN tri AND CAST(ds[-3] AS INTEGER) < CAST(ds[-2] AS INTEGER) AND CAST(ds[-2] AS INTEGER) < CAST(ds[-1] AS INTEGER) THEN 'bottle' WHEN tri OR du THEN 'glass' ELSE sect END AS section
        FROM free3 WHERE marker IS NULL)))""")
V["free5"] = (["free4"], f"""SELECT menu_id, line_no, step, sub, name, name || {_SUFFIX} AS "desc", vintage, {_SCALE} AS menu_price, CASE WHEN section = 'glass' THEN price END AS glass_price
  FROM free4 WHERE price BETWEEN 8 AND 50000 AND {_SCALE} BETWEEN 8 AND 50000 AND {name_ok('name')} AND NOT {s.has('name', fv.HEADER_LINE)} AND NOT {s.has('name', fv.REGION_LINE)} AND NOT {s.has('name', _OTHER)}""")


@register("parse_free_rows", s.q("free5", f"SELECT {_SQLCOLS} FROM ({once('free5')})"))
def _(spark, sf):
    return m.parse_free_rows(v.free_lines(spark, sf)).select(*_COLS)
