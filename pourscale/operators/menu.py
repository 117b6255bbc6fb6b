"""Menu documents to priced entries.

A menu is a numbered list of cleaned lines.  Windows run per (menu, block of
lines), never per whole menu: each block carries copies of the next two lines
for look-ahead, and the section in force at its start comes from a small table
of block ends.  One menu holding a third of all lines therefore spreads over
many tasks and gives the same entries.

Lines may say in ``APART`` whether those of their menu are dealt out so.  All
others lie together in one task: their windows run per menu there, and no step
after their numbering moves them again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from pourscale import fixed_values as fv
from pourscale.functions import text as tx

BLOCK = 4096
LOOKAHEAD = 2
#: Whether the lines of a menu are dealt over several tasks; without this column all may be.
APART = "apart"
#: Stands on rows of which those of every menu lie together in one task.
WHOLE = "whole"


def _marked(df: DataFrame) -> list[str]:
    return [c for c in (WHOLE, APART) if c in df.columns]


def _by_place(df: DataFrame, whole, parted) -> DataFrame:
    """``whole`` of the menus that lie together and ``parted`` of the others, each by a plan of its own.

    The mark is written anew as a constant above either plan, so that the next step takes just one of the two.
    """
    if WHOLE in df.columns:
        return whole(df)
    if APART not in df.columns:
        return parted(df)
    mark = lambda out, value: out.drop(APART).withColumn(APART, F.lit(value))
    return mark(whole(df.where(~F.col(APART))), False).unionByName(mark(parted(df.where(APART)), True))


# ------------------------------------------------------------------ lines
def scan_menu_text(docs: DataFrame, menu: str = "menu_id", content: str = "content") -> DataFrame:
    """Documents to numbered, cleaned, non-empty lines; no shuffle."""
    lines = F.split(F.col(content), "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]")
    kept = F.filter(F.transform(lines, tx.clean_line), lambda l: l != "")
    return docs.select(menu, F.posexplode(kept).alias("line_no", "line"))


def number_lines(df: DataFrame, group: str, bucket: Column, order: list) -> DataFrame:
    """Dense 0-based ``line_no`` per group in ``order``, without one task per group.

    ``bucket`` must grow with ``order``.  Rows are ranked inside (group, bucket)
    and shifted by the running size of the earlier buckets.
    """
    b = df.withColumn("_b", bucket)
    sizes = b.groupBy(group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(group, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(group, "_b").orderBy(*order)
    ranked = b.withColumn("_i", F.row_number().over(inside) - 1)
    return (
        ranked.join(starts, [group, "_b"])
        .withColumn("line_no", (F.col("_start") + F.col("_i")).cast("int"))
        .drop("_b", "_i", "_start")
    )


def number_whole(df: DataFrame, group: str, order: list) -> DataFrame:
    """``number_lines`` of groups that each lie together in one task, marked so."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.where(F.col(group).isNotNull()).withColumn("line_no", F.row_number().over(w) - 1).withColumn(WHOLE, F.lit(True))


# ------------------------------------------------------------------ line facts
#: Letters of which every section header holds some: most lines need this test only.
_HEADER_LETTERS = r"(?i)(?=[bg\dhdm])(?:by|glass|btg|b\s*y\s+t|\d\s*o|half|demi|375|magnum|1\.5|bottle)"


def _may_be_dated(text: Column) -> Column:
    """Whether a text holds what every year or NV/MV mark does."""
    return F.regexp_like(text, F.lit(r"19|20|[nNmM][.vV]"))



def section_marker(line: Column) -> Column:
    """Section a header line starts, null for other lines."""
    has = lambda p: F.regexp_like(line, F.lit(p))
    caps = (line == F.upper(line)) & F.length(line).between(3, 45) & ~has(fv.LINE_PRICE) & ~has(fv.DUAL_PRICE)
    named = (
        F.when(has(fv.GLASS_HEADER), "glass")
        .when(has(fv.HALF_HEADER), "half")
        .when(has(fv.MAGNUM_HEADER), "magnum")
        .otherwise("bottle")
    )
    return F.when(tx.may_be_section(line) & has(_HEADER_LETTERS) & tx.is_section_text(line), named).when(caps, "bottle")


def _marked_prices(line: Column) -> Column:
    """A line cut before each number that may be a price, which a mark ends."""
    return F.when(F.regexp_like(line, F.lit(r"\d\d")), F.split(F.regexp_replace(line, fv.LINE_PRICE, "\u0001$0\u0002"), "\u0001"))


def line_prices(marked: Column) -> Column:
    """Prices of a line (``_marked_prices``) in order: position, text before, digits, value.

    Numbers that look like years or lie outside the menu band do not count.
    """
    bare = lambda seg: F.replace(seg, F.lit("\u0002"), F.lit(""))
    digits_of = lambda seg: F.replace(F.substring_index(seg, "\u0002", 1), F.lit("$"), F.lit(""))
    valued = lambda before, d: F.struct(F.length(before).alias("pos"), before.alias("before"), d.alias("digits"), d.cast("decimal(12,2)").alias("price"))
    year = lambda d: (F.length(d) == 4) & (F.startswith(d, F.lit("19")) | F.startswith(d, F.lit("20"))) & ~F.contains(d, F.lit("."))
    ok = lambda d: d.cast("decimal(12,2)").between(*fv.MENU_PRICE_BAND) & ~year(d)
    none = F.array().cast("array<struct<pos:int,before:string,digits:string,price:decimal(12,2)>>")
    # two numbers at most, as most lines have, need no lambda, which would run uncompiled
    first, second = F.get(marked, F.lit(1)), F.get(marked, F.lit(2))
    start = F.get(marked, F.lit(0))
    one = F.when(ok(digits_of(first)), F.array(valued(start, digits_of(first)))).otherwise(none)
    two = F.when(ok(digits_of(second)), F.array(valued(F.concat(start, bare(first)), digits_of(second)))).otherwise(none)
    found = F.transform(
        F.slice(marked, F.lit(2), F.size(marked)), lambda seg, i: valued(bare(F.array_join(F.slice(marked, F.lit(1), i + 1), "")), digits_of(seg))
    )
    n = F.size(marked)
    return F.when(n == 2, one).when(n == 3, F.concat(one, two)).when(n > 3, F.filter(found, lambda s: ok(s["digits"]))).otherwise(none)


def line_vintage(text: Column) -> Column:
    """Last year or NV/MV mark of a text, dots removed, upper case."""
    found = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), 1)
    marks = F.when(tx.is_ascii(text), found(tx.ascii_rule(fv.LINE_YEAR))).otherwise(found(fv.LINE_YEAR))
    last = F.replace(F.upper(F.try_element_at(marks, F.lit(-1))), F.lit("."), F.lit(""))
    return F.when(_may_be_dated(text), last)


def strip_vintage_inline(text: Column) -> Column:
    return F.trim(tx.replaced(text, fv.LINE_YEAR_INLINE, ""))


def _slash_prices(line: Column, pattern: str, n: int) -> Column:
    parts = [F.regexp_extract(line, pattern, i).try_cast("int").alias(f"p{i}") for i in range(1, n + 1)]
    before = F.regexp_replace(line, f"(?s){pattern}.*", "").alias("before")
    return F.when((F.size(F.split(line, "/")) >= n) & F.regexp_like(line, F.lit(pattern)), F.struct(before, *parts))


def line_facts(lines: DataFrame) -> DataFrame:
    """Per-line columns every pass reads; row-local."""
    line = F.col("line")
    facts = {
        "marker": section_marker(line),
        "prices": line_prices(F.col("_marked")),
        "triple": _slash_prices(line, fv.TRIPLE_PRICE, 3),
        "dual": _slash_prices(line, fv.DUAL_PRICE, 2),
        "mark": line_vintage(line),
    }
    # the marked line is a column of its own, read by all that is made of it
    return lines.withColumn("_marked", _marked_prices(line)).withColumns(facts).drop("_marked").withColumn(
        "priced", (F.size("prices") > 0) | F.col("dual").isNotNull() | F.col("triple").isNotNull()
    )


# ------------------------------------------------------------------ windows
def _ahead(w) -> dict[str, Column]:
    return {
        f"{c}_{i}": F.lead(c, i).over(w) for c in ("line", "prices", "priced", "mark", "dual", "triple") for i in (1, 2)
        if not (i == 2 and c in ("mark", "dual", "triple"))
    }


def with_sections(lines: DataFrame, menu: str = "menu_id", facts=line_facts) -> DataFrame:
    """Lines with their ``facts``, the section in force and the next two lines of each."""
    return _by_place(lines, lambda x: _whole_sections(x, menu, facts), lambda x: _block_sections(x, menu, facts))


def _whole_sections(lines: DataFrame, menu: str, facts) -> DataFrame:
    # sorted before the facts are made, which hold parts of the line many times over
    rows = facts(lines.sortWithinPartitions(menu, "line_no"))
    w = Window.partitionBy(menu).orderBy("line_no")
    local = F.last("marker", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumns({**_ahead(w), "section": F.coalesce(local, F.lit("bottle"))})


def _block_sections(lines: DataFrame, menu: str, facts) -> DataFrame:
    """Lines are shuffled as they are and get their facts where they arrive: the facts hold parts of
    the line many times over.
    """
    block = F.floor(F.col("line_no") / BLOCK).cast("int")
    near_start = (F.col("line_no") % BLOCK < LOOKAHEAD) & (F.col("line_no") >= BLOCK)
    spread = lines.withColumn("_home", block).withColumn(
        "_block", F.explode(F.when(near_start, F.array("_home", F.col("_home") - 1)).otherwise(F.array("_home")))
    )
    # an explicit exchange: input that already lies by menu would keep a big menu in one task,
    # and the passes of parse_menu all read this one
    spread = facts(spread.repartition(menu, "_block"))
    w = Window.partitionBy(menu, "_block").orderBy("line_no")
    local = F.last("marker", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    windowed = spread.withColumns({**_ahead(w), "_local": local}).where(F.col("_block") == F.col("_home"))

    # section at the end of each block, carried to the later blocks of the menu
    ends = facts(lines).groupBy(menu, block.alias("_home")).agg(
        F.max_by("marker", F.when(F.col("marker").isNotNull(), F.col("line_no"))).alias("_end")
    )
    chain = Window.partitionBy(menu).orderBy("_home").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        ends.withColumn("_carry", F.last("_end", ignorenulls=True).over(chain))
        .where((F.col("_home") > 0) & F.col("_carry").isNotNull())
        .select(menu, "_home", "_carry")
    )
    out = windowed.join(carried, [menu, "_home"], "left")
    return out.withColumn("section", F.coalesce("_local", "_carry", F.lit("bottle"))).drop(
        "_local", "_carry", "_home", "_block"
    )


def section_state(lines: DataFrame, menu: str = "menu_id") -> DataFrame:
    return with_sections(lines, menu).select(menu, "line_no", "line", "section")


# ------------------------------------------------------------------ passes
def _candidate(step: int, sub: int, desc: Column, mark: Column, price: Column, section: Column) -> Column:
    return F.struct(
        F.lit(step).alias("step"), F.lit(sub).alias("sub"), desc.alias("raw_desc"), mark.alias("mark"),
        price.cast("decimal(12,2)").alias("price"), section.alias("section"),
    )


def _none() -> Column:
    return F.array().cast(
        "array<struct<step:int,sub:int,raw_desc:string,mark:string,price:decimal(12,2),section:string>>"
    )


def _in_menu_band(price: Column) -> Column:
    return price.between(*fv.MENU_PRICE_BAND)


def _desc_without_mark(before: Column) -> Column:
    b = F.trim(before)
    return F.when(line_vintage(b).isNotNull(), strip_vintage_inline(b)).otherwise(b)


def _triple_ok(t: Column) -> Column:
    return (t["p1"] <= t["p2"]) & (t["p2"] < t["p3"]) & _in_menu_band(t["p3"])


def _dual_ok(d: Column) -> Column:
    return _in_menu_band(d["p1"]) & _in_menu_band(d["p2"])


def _mark_or_next(before: Column) -> Column:
    """Year of the name, else of the following line when that has no price."""
    follow = F.when(~F.coalesce(F.col("priced_1"), F.lit(True)), F.col("mark_1"))
    return F.coalesce(line_vintage(F.trim(before)), follow)


def one_line_candidates() -> Column:
    """Array of candidates of a line that holds both name and price.

    A triple or dual price consumes the line, credible or not; two plain prices
    make a glass and a bottle entry when adjacent and in ratio, and otherwise
    the line is skipped.
    """
    t, d, p = F.col("triple"), F.col("dual"), F.col("prices")
    last, prev = F.try_element_at(p, F.lit(-1)), F.try_element_at(p, F.lit(-2))
    none = _none()
    triple = _candidate(1, 0, _desc_without_mark(t["before"]), line_vintage(F.trim(t["before"])), t["p3"], F.lit("bottle"))
    dual_mark = _mark_or_next(d["before"])
    dual = _candidate(
        1, 0,
        F.when(dual_mark.isNotNull(), strip_vintage_inline(F.trim(d["before"]))).otherwise(F.trim(d["before"])),
        dual_mark, F.least(d["p1"], d["p2"]), F.lit("glass"),
    )
    gap = last["pos"] - prev["pos"] - F.length(prev["digits"])
    share = last["price"].cast("double") / prev["price"].cast("double")
    two_desc, two_mark = _desc_without_mark(prev["before"]), line_vintage(F.trim(prev["before"]))
    pair = F.array(
        _candidate(1, 0, two_desc, two_mark, prev["price"], F.lit("glass")),
        _candidate(1, 1, two_desc, two_mark, last["price"], F.when(F.col("section") == "glass", "bottle").otherwise(F.col("section"))),
    )
    single = _candidate(1, 0, _desc_without_mark(last["before"]), _mark_or_next(last["before"]), last["price"], F.col("section"))
    return (
        F.when(t.isNotNull(), F.when(_triple_ok(t), F.array(triple)).otherwise(none))
        .when(d.isNotNull(), F.when(_dual_ok(d), F.array(dual)).otherwise(none))
        .when(F.size(p) >= 2, F.when((gap <= 6) & share.between(2.0, 8.0), pair).otherwise(none))
        .when(F.size(p) == 1, F.array(single))
        .otherwise(none)
    )


def _name_line_ok(line: Column) -> Column:
    return (
        ~F.col("priced") & (F.length(line) >= 5) & ~tx.is_section_text(line) & ~tx.names_other_beverage(line) & ~tx.is_header_line(line)
    )


def three_line_candidates() -> Column:
    """Name line, continuation line, price line."""
    line, mid, p = F.col("line"), F.col("line_1"), F.col("prices_2")
    last = F.try_element_at(p, F.lit(-1))
    continues = (
        F.endswith(line, F.lit(","))
        | (F.length(mid) <= 30)
        | ((F.length(mid) <= 50) & tx.like(mid, fv.PLACE_WORDS))
    )
    ok = ~F.col("priced_1") & (F.size(p) > 0) & _name_line_ok(line) & continues & ~tx.is_header_line(mid)
    mark = F.coalesce(line_vintage(last["before"]), line_vintage(F.col("line_2")), F.col("mark"), F.col("mark_1"))
    name = F.trim(F.regexp_replace(strip_vintage_inline(line), r",+$", ""))
    row = _candidate(2, 0, F.concat_ws(" ", name, mid), mark, last["price"], F.col("section"))
    return F.when(ok, F.array(row))


def first_candidates() -> Column:
    """One-line candidates of priced lines, three-line candidates of the others."""
    three = ~F.col("priced_1") & (F.size("prices_2") > 0)
    return F.when(F.col("priced"), one_line_candidates()).when(three, three_line_candidates())


def two_line_candidates() -> Column:
    """Name line, then a line with the price."""
    line, t, d, p = F.col("line"), F.col("triple_1"), F.col("dual_1"), F.col("prices_1")
    last = F.try_element_at(p, F.lit(-1))
    ok = _name_line_ok(line) & ~tx.is_region_line(line)
    own = F.col("mark")
    make = lambda mark, price, section: F.array(_candidate(3, 0, line, mark, price, section))
    kept = F.when(F.col("section") == "glass", "bottle").otherwise(F.col("section"))
    rest = F.trim(last["before"])
    return F.when(
        ok,
        F.when(_triple_ok(t), make(F.coalesce(line_vintage(t["before"]), own), t["p3"], kept))
        .when(_dual_ok(d), make(F.coalesce(line_vintage(d["before"]), own), F.least(d["p1"], d["p2"]), F.lit("glass")))
        .when(
            F.size(p) > 0,
            make(
                F.coalesce(line_vintage(F.when(rest != "", rest).otherwise(F.col("line_1"))), own),
                last["price"], F.col("section"),
            ),
        ),
    )


def candidates(sectioned: DataFrame, which: Column, menu: str = "menu_id") -> DataFrame:
    """Rows of one pass: menu, line_no and the raw entry with its cleaned name, a finished value."""
    # not exploded as a plain column: Spark would then filter on it first, and make all candidates a second time for that
    place = [menu, "line_no", *_marked(sectioned)]
    found = sectioned.select(*place, tx.in_pieces(which).alias("_found"))
    rows = found.select(*place, F.explode(F.coalesce("_found", _none())).alias("_c")).select(*place, "_c.*")
    return tx.finished(rows, name=entry_name(F.col("raw_desc")))


def entry_name(raw: Column) -> Column:
    """Name without bin number, trailing marks and years; what no rule can match is not tried."""
    desc = F.when(F.substring(raw, 1, 1).between("0", "9"), F.regexp_replace(raw, fv.BIN_NUMBER, "")).otherwise(raw)
    desc = F.trim(F.regexp_replace(desc, fv.TAIL_MARKS, ""))
    tail = F.trim(F.regexp_replace(desc, fv.LINE_YEAR_TAIL, ""))
    return F.when(_may_be_dated(desc), F.trim(F.regexp_replace(tail, fv.LINE_YEAR_TWICE, "$1"))).otherwise(desc)


# ------------------------------------------------------------------ entries
def add_entry(cands: DataFrame, menu: str = "menu_id") -> DataFrame:
    """Drop what is no product and scale prices to a bottle."""
    d = F.col("name")
    product = (
        tx.looks_like_name(d) & ~tx.is_header_line(d) & ~tx.is_section_text(d) & ~tx.is_region_line(d)
        & ~tx.is_caps_dash(d) & ~tx.names_other_beverage(d)
    )
    out = tx.finished(cands, product=product).where("product").drop("product")
    out = out.withColumn("menu_price", tx.bottle_equivalent(F.col("price"), F.col("section"))).where(
        _in_menu_band(F.col("menu_price"))
    )
    return out.select(
        menu, "line_no", "step", "sub", "name",
        F.concat("name", tx.entry_suffix(F.col("section"))).alias("desc"),
        F.when(F.regexp_like("mark", F.lit(r"^\d+$")), F.col("mark")).cast("int").alias("vintage"),
        "menu_price",
        F.when(F.col("section") == "glass", F.col("price")).alias("glass_price"),
        *_marked(cands),
    )


def _same_entry(menu: str, head: int | None = None) -> list[Column]:
    name = F.lower("name") if head is None else F.substring(F.lower("name"), 1, head)
    return [F.col(menu), name.alias("_head"), F.col("vintage"), F.floor("menu_price").cast("int").alias("_whole")]


def dedupe_entries(entries: DataFrame, menu: str = "menu_id", order=("step", "line_no", "sub"), head: int | None = None) -> DataFrame:
    """First entry per menu, name, year and whole price; combined on the map side where menus are dealt out.

    Whole names are compared unless ``head`` gives the characters that count.
    """
    same = _same_entry(menu, head)

    def parted(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in (menu, "vintage")]
        return rows.groupBy(*same).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(menu, "vintage", "_row.*")

    def whole(rows: DataFrame) -> DataFrame:
        w = Window.partitionBy(*same).orderBy(*order)
        return rows.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")

    return _by_place(entries, whole, parted)


def parse_menu(lines: DataFrame, menu: str = "menu_id", strict_consumed: bool = False) -> DataFrame:
    """Entries of every menu.

    One-line entries come first, then three-line, then two-line ones.  A name
    line has no price and a one-line entry has one, so the first two passes
    never compete for a line; a two-line entry may use neither a line of a kept
    three-line entry nor the price of a kept one-line entry.  With
    ``strict_consumed`` a three-line entry may not reuse such a price either.
    """
    if strict_consumed:
        return _parse_parted(lines.drop(WHOLE, APART), menu, strict_consumed)
    return _by_place(lines, lambda x: _parse_whole(x, menu), lambda x: _parse_parted(x.drop(APART), menu, False))


def _parse_whole(lines: DataFrame, menu: str) -> DataFrame:
    """Entries of menus that lie together: what a pass keeps tells the next one by windows, without joins."""
    sectioned = _whole_sections(lines, menu, line_facts)
    found = add_entry(candidates(sectioned, F.coalesce(first_candidates(), F.when(_next_priced(), two_line_candidates())), menu), menu)
    same, place = _same_entry(menu), ("step", "line_no", "sub")
    w = Window.partitionBy(*same).orderBy(*place)
    # first of its kind among the first two passes; two-line entries only where these have none
    found = found.withColumns({"_nth": F.row_number().over(w), "_least": F.first("step").over(w)}).where("_nth = 1 or _least = 3")
    near = Window.partitionBy(menu).orderBy("line_no")
    used = lambda step, first, last: F.coalesce(F.max(F.col("step") == step).over(near.rangeBetween(first, last)), F.lit(False))
    blocked = (F.col("step") == 3) & F.col(menu).isNotNull() & (used(1, 1, 1) | used(2, -1, 0))
    free = found.withColumn("_blocked", blocked).where("not _blocked").drop("_nth", "_least", "_blocked")
    return free.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def _next_priced() -> Column:
    return ~F.col("priced") & F.col("priced_1")


def _parse_parted(lines: DataFrame, menu: str, strict_consumed: bool) -> DataFrame:
    sectioned = with_sections(lines, menu)
    firsts = add_entry(candidates(sectioned, first_candidates(), menu), menu)
    twos = add_entry(candidates(sectioned.where(_next_priced()), two_line_candidates(), menu), menu)
    if strict_consumed:
        ones, threes = firsts.where("step = 1"), firsts.where("step = 2")
        taken = dedupe_entries(ones, menu).select(menu, (F.col("line_no") - 2).alias("line_no")).distinct()
        threes = threes.join(taken, [menu, "line_no"], "left_anti")
        first = dedupe_entries(ones.unionByName(threes), menu)
    else:
        first = dedupe_entries(firsts, menu)
    blocked = first.select(
        menu,
        F.explode(
            F.when(F.col("step") == 1, F.array(F.col("line_no") - 1)).otherwise(F.array("line_no", F.col("line_no") + 1))
        ).alias("line_no"),
    ).distinct()
    twos = twos.join(blocked, [menu, "line_no"], "left_anti")
    return dedupe_entries(first.unionByName(twos), menu)


def cap_entries(entries: DataFrame, limit: int | None = None, menu: str = "menu_id") -> DataFrame:
    """Entries numbered within their menu (``entry_no``); only the first ``limit`` of each where the caller sets one."""
    w = Window.partitionBy(menu).orderBy("step", "line_no", "sub")
    numbered = entries.withColumn("entry_no", F.row_number().over(w))
    return numbered if limit is None else numbered.where(F.col("entry_no") <= limit)


# ------------------------------------------------------------------ other row formats
def parse_pipe_rows(lines: DataFrame, menu: str = "menu_id") -> DataFrame:
    """``NAME | VINTAGE | PRICE [| GLASS]`` rows to entries."""
    line = F.trim(F.regexp_replace(F.trim("line"), r"^-+|-+$", ""))
    parts = F.transform(F.split(line, r"\|"), lambda p: F.trim(p))
    out = lines.withColumn("_p", parts).where(F.size("_p") >= 3)
    name, mark = F.get("_p", F.lit(0)), F.upper(F.get("_p", F.lit(1)))
    tiers = F.filter(
        F.transform(F.split(F.trim(F.regexp_replace(F.get("_p", F.lit(2)), "[,$]", "")), "/"), lambda p: F.trim(p)), lambda x: x != ""
    )
    values = F.transform(tiers, lambda x: x.try_cast("decimal(12,2)"))
    v = F.col("_v")
    slashed = F.contains(F.get("_p", F.lit(2)), F.lit("/"))
    rising = (F.size(v) >= 3) & (F.get(v, F.lit(0)) < F.get(v, F.lit(1))) & (F.get(v, F.lit(1)) < F.get(v, F.lit(2)))
    said_glass = F.coalesce(F.contains(F.upper(F.get(F.col("_p"), F.lit(3))), F.lit("GLASS")), F.lit(False))
    out = (
        out.withColumn("_v", values)
        .where((F.length(name) >= 3) & (F.size("_v") > 0) & ~F.exists("_v", lambda x: x.isNull()))
        .withColumn("price", F.when(slashed & rising, F.element_at(v, -1)).when(slashed, F.array_min(v)).otherwise(F.get(v, F.lit(0))))
        .withColumn("section", F.when(slashed & rising, "bottle").when(slashed | said_glass, "glass").otherwise("bottle"))
        .where(F.col("price").between(*fv.GLASS_PRICE_BAND))
        .withColumn("menu_price", tx.bottle_equivalent(F.col("price"), F.col("section")))
        .where(_in_menu_band(F.col("menu_price")))
        .withColumn("step", F.lit(1))
        .withColumn("sub", F.lit(0))
    )
    entries = out.select(
        menu, "line_no", "step", "sub", name.alias("name"),
        F.concat(name, tx.entry_suffix(F.col("section"))).alias("desc"),
        F.when(F.regexp_like(mark, F.lit(r"^(?:19|20)\d{2}$")), mark).cast("int").alias("vintage"),
        "menu_price", F.when(F.col("section") == "glass", F.col("price")).alias("glass_price"),
    )
    return dedupe_entries(entries, menu)


def free_row_facts(lines: DataFrame) -> DataFrame:
    """Bulleted prose lines with the glass marker each one sets."""
    lower = F.lower("line")
    pour = F.contains(lower, F.lit("oz")) & (F.length("line") < 40) & F.regexp_like("line", F.lit(r"(?iU)\b\d+\s*oz\b"))
    by = F.contains(lower, F.lit("by")) & F.regexp_like("line", F.lit(r"(?iU)\bby\s+the\s+(glass|bottle)\b"))
    return lines.withColumn(
        "marker", F.when(pour, "glass").when(by, F.when(F.contains(lower, F.lit("glass")), "glass").otherwise("bottle"))
    ).withColumns({c: F.lit(None).cast("string") for c in ("prices", "mark", "dual", "triple")}).withColumn("priced", F.lit(False))


def _free_price(line: Column) -> Column:
    """Price, section the price itself tells, and text before it; null for a line without a price or an introduction.

    Made as one value: filters on it read the finished value instead of repeating its regular expressions.
    """
    num = lambda pattern, i: F.nullif(F.regexp_extract(line, pattern, i), F.lit("")).try_cast("decimal(12,2)")
    before = lambda p: F.trim(F.regexp_extract(line, r"(?s)^(.*?)" + p, 1))

    def dual(v: Column) -> Column:
        a, b, c = v["a"], v["b"], v["c"]
        rising = F.coalesce((a < b) & (b < c), F.lit(False))
        return F.struct(
            F.when(rising, c).otherwise(F.least(a, b, c)).alias("price"),
            F.when(rising, "bottle").otherwise("glass").alias("own"),
            before(fv.FREE_DUAL).alias("text"),
        )

    three = F.struct(*[num(fv.FREE_DUAL, i).alias(n) for i, n in ((1, "a"), (2, "b"), (3, "c"))])
    single = F.struct(num(fv.FREE_SINGLE, 1).alias("price"), F.lit(None).cast("string").alias("own"), before(fv.FREE_SINGLE).alias("text"))
    has = lambda mark, p: F.contains(line, F.lit(mark)) & F.regexp_like(line, F.lit(p))
    intro = F.regexp_like(line, F.lit(fv.FREE_INTRO)) & ~F.regexp_like(line, F.lit(r"\$?\d{2,}"))
    return F.when(intro, None).when(has("/", fv.FREE_DUAL), tx.bound(three, dual)).when(has("$", fv.FREE_SINGLE), single)


def _free_name(text: Column) -> Column:
    """Year mark and name of the text before a price."""
    mark = F.upper(F.regexp_extract(text, r"(?iU)\b((?:19|20)\d{2}|NV|MV)\b", 1))
    bare = F.trim(F.regexp_replace(text, r"(?isU)^(.*?)\b((?:19|20)\d{2}|NV|MV)\b(.*)$", "$1$3"))
    dated = F.regexp_like(text, F.lit(r"19|20|[nNmM][vV]"))

    def head(n: Column) -> Column:
        out = n
        for sep in (" - ", " – ", " — "):
            out = F.when(F.contains(n, F.lit(sep)), F.trim(F.substring_index(n, sep, 1))).otherwise(out)
        return out

    name = F.trim(F.regexp_replace(tx.bound(F.when(dated, bare).otherwise(F.trim(text)), head), r"[\s,\-–—:;]+$", ""))
    spoken = lambda n: F.when(F.contains(n, F.lit("(")), F.trim(F.regexp_replace(n, r"(?i)\s*\(\s*\d+\s*oz[^)]*\)", ""))).otherwise(n)
    return F.struct(F.when(dated, mark).otherwise("").alias("mark"), tx.bound(name, spoken).alias("name"))


def parse_free_rows(lines: DataFrame, menu: str = "menu_id") -> DataFrame:
    """``• Name — Place 2019 — $20/38`` prose rows to entries."""
    bare = lines.withColumn("line", F.trim(F.regexp_replace(F.trim("line"), r"^[\-\*•·▸►\d\.]+\s*", ""))).where(F.length("line") >= 4)
    rows = with_sections(bare, menu, free_row_facts).where("marker is null")
    priced = rows.select(menu, "line_no", "section", F.explode(F.array(_free_price(F.col("line")))).alias("_p"))
    priced = priced.where(_in_menu_band(F.col("_p.price"))).select(
        menu, "line_no", F.col("_p.price").alias("price"), F.coalesce("_p.own", "section").alias("_section"), F.col("_p.text").alias("_t")
    )
    named = priced.select(menu, "line_no", "price", "_section", F.inline(F.array(_free_name(F.col("_t")))))
    n = F.col("name")
    out = (
        named.where(
            (F.length(n) >= 3) & tx.looks_like_name(n) & ~tx.is_header_line(n) & ~tx.is_region_line(n)
            & ~tx.names_other_beverage(n)
        )
        .withColumn("_glass", F.col("_section") == "glass")
        .withColumn("menu_price", tx.bottle_equivalent(F.col("price"), F.when(F.col("_glass"), "glass").otherwise("bottle")))
        .where(_in_menu_band(F.col("menu_price")))
    )
    entries = out.select(
        menu, "line_no", F.lit(1).alias("step"), F.lit(0).alias("sub"), "name",
        F.when(F.col("_glass"), F.concat("name", F.lit(fv.SUFFIXES["glass"]))).otherwise(F.col("name")).alias("desc"),
        F.when(F.regexp_like("mark", F.lit(r"^\d{4}$")), F.col("mark")).cast("int").alias("vintage"),
        "menu_price", F.when(F.col("_glass"), F.col("price")).alias("glass_price"),
    )
    return dedupe_entries(entries, menu)
