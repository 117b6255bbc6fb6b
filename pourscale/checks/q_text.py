"""Queries of the text functions."""

from pyspark.sql import functions as F

from pourscale import fixed_values as fv
from pourscale.checks import sql as s, views as v
from pourscale.checks.registry import register
from pourscale.functions import text as tx
from pourscale.functions.pricing import confidence_level  # noqa: F401


@register("strip_accents", "SELECT doc_id, strip_accents(text) AS plain FROM documents")
def _(spark, sf):
    return v.table(spark, sf, "documents").select("doc_id", tx.strip_accents(F.col("text")).alias("plain"))


@register("normalize_text", s.q("menu", f"SELECT item_id, {s.normalize('menu_text')} AS normalized FROM menu"))
def _(spark, sf):
    return v.menu(spark, sf).select("item_id", tx.normalize_text(F.col("menu_text")).alias("normalized"))


@register(
    "normalize_producer",
    s.q("cat", f"SELECT id, {s.normalize_producer(chr(39) + 'Mt. St. ' + chr(39) + ' || producer')} AS producer_norm FROM cat"),
)
def _(spark, sf):
    text = F.concat(F.lit("Mt. St. "), F.col("producer"))
    return v.cat(spark, sf).select("id", tx.normalize_producer(text).alias("producer_norm"))


@register("producer_key", s.q("cat", f"SELECT id, {s.producer_key('producer')} AS producer_key FROM cat"))
def _(spark, sf):
    return v.cat(spark, sf).select("id", tx.producer_key(F.col("producer")).alias("producer_key"))


@register(
    "slug_id",
    s.q("cat", f"SELECT id, {s.slug(chr(39).join(['producer || ', '-', ' || name']))} AS slug, {s.slug('name || id', None)} AS long_slug FROM cat"),
)
def _(spark, sf):
    return v.cat(spark, sf).select(
        "id", tx.item_slug(F.col("producer"), F.col("name")).alias("slug"),
        tx.slug(F.concat("name", "id"), None).alias("long_slug"),
    )


@register("lookup_key", s.q("menu", f"SELECT item_id, {s.lookup_key('menu_text')} AS lookup_key FROM menu"))
def _(spark, sf):
    return v.menu(spark, sf).select("item_id", tx.lookup_key(F.col("menu_text")).alias("lookup_key"))


_TERMS = "menu_text || CASE l_linenumber % 4 WHEN 0 THEN ' GC VV' WHEN 1 THEN ' 1er' WHEN 2 THEN ' TBA kab' ELSE '' END"


@register("expand_terms", s.q("menu", f"SELECT item_id, {s.expand_terms(_TERMS)} AS expanded FROM menu"))
def _(spark, sf):
    n = F.col("l_linenumber") % 4
    tail = F.when(n == 0, " GC VV").when(n == 1, " 1er").when(n == 2, " TBA kab").otherwise("")
    return v.menu(spark, sf).select("item_id", tx.expand_terms(F.concat("menu_text", tail)).alias("expanded"))


@register("clean_line", s.q("raw_lines", f"SELECT menu_id, l_partkey, l_suppkey, l_linenumber, sub_no, {s.clean_line('raw')} AS line FROM raw_lines"))
def _(spark, sf):
    return v.raw_lines(spark, sf).select(
        "menu_id", "l_partkey", "l_suppkey", "l_linenumber", F.col("sub_no").cast("bigint").alias("sub_no"),
        tx.clean_line(F.col("raw")).alias("line"),
    )


@register("significant_tokens", s.q("pairs", f"SELECT a, b, array_to_string(list_sort({s.tokens('a')}), ' ') AS tokens FROM pairs"))
def _(spark, sf):
    return v.pairs(spark, sf).select(
        "a", "b", F.array_join(F.array_sort(tx.significant_tokens(F.col("a"))), " ").alias("tokens")
    )


_KEYS = r"(?i)\b(" + "|".join(fv.KEY_NOISE_WORDS) + r")\b"


def key_words_sql(name: str, producer: str) -> str:
    text = s.sub(f"lower(strip_accents({name} || ' ' || {producer}))", _KEYS, " ")
    return f"list_sort(list_distinct(regexp_extract_all({text}, '[a-z]{{3,}}')))"


@register("key_words", s.q("cat", f"SELECT id, array_to_string({key_words_sql('name', 'producer')}, ' ') AS key_words FROM cat"))
def _(spark, sf):
    words = tx.key_words(F.col("name"), F.col("producer"))
    return v.cat(spark, sf).select("id", F.array_join(F.array_sort(words), " ").alias("key_words"))


_P = f"trim({s.sub('trim(' + s.sub('trim(strip_accents(producer))', r'(?i)\b(' + '|'.join(fv.PHRASE_HOUSE_WORDS) + r')\b', '') + ')', r'\s{2,}', ' ')})"


@register(
    "search_phrases",
    s.q("cat", f"""SELECT id, array_to_string(list_filter(CASE WHEN p <> '' AND NOT contains(lower(n), lower(p))
        THEN [p || ' ' || n || ' ' || y, p || ' ' || n, n || ' ' || y, n] ELSE [n || ' ' || y, n] END, lambda x: x IS NOT NULL), '|') AS phrases
      FROM (SELECT id, strip_accents(name) AS n, {_P} AS p, CASE WHEN catalog_ordinal % 3 > 0 THEN CAST(2000 + catalog_ordinal % 20 AS VARCHAR) END AS y FROM cat)"""),
)
def _(spark, sf):
    year = F.when(F.col("catalog_ordinal") % 3 > 0, 2000 + F.col("catalog_ordinal") % 20)
    return v.cat(spark, sf).select(
        "id", F.array_join(tx.search_phrases(F.col("name"), F.col("producer"), year), "|").alias("phrases")
    )


_Y = "CAST(2000 + catalog_ordinal % 20 AS VARCHAR)"
_TITLED = "CASE WHEN catalog_ordinal % 5 = 0 THEN producer || ' ' || name ELSE name END"


def titled(spark, sf):
    """Products of which some have their producer in the name."""
    name = F.when(F.col("catalog_ordinal") % 5 == 0, F.concat_ws(" ", "producer", "name")).otherwise(F.col("name"))
    return v.cat(spark, sf).select("id", name.alias("name"), "producer", (2000 + F.col("catalog_ordinal") % 20).alias("year"))


@register(
    "catalog_phrases",
    s.q("cat", f"""SELECT id, base || ' ' || y || '|' || base || '|' || producer || ' ' || y || '|' || producer AS phrases FROM (
        SELECT *, CASE WHEN starts_with(n, left(p, length(p) // 2)) THEN title ELSE producer || ' ' || title END AS base FROM (
          SELECT id, producer, {_TITLED} AS title, {_Y} AS y, {s.listing_text('producer')} AS p, {s.listing_text(_TITLED)} AS n FROM cat))"""),
)
def _(spark, sf):
    return titled(spark, sf).select("id", F.array_join(tx.catalog_phrases(F.col("name"), F.col("producer"), F.col("year")), "|").alias("phrases"))


@register(
    "retail_phrase",
    s.q("cat", f"""SELECT id, array_to_string(list_concat([producer], list_slice(list_filter(string_split({_TITLED}, ' '), lambda w: length(w) > 2 AND NOT list_contains({s.values(fv.RETAIL_SKIP_WORDS)}, lower(w))), 1, 3), [{_Y}]), ' ') AS phrase FROM cat"""),
)
def _(spark, sf):
    return titled(spark, sf).select("id", tx.retail_phrase(F.col("name"), F.col("producer"), F.col("year")).alias("phrase"))


@register(
    "producer_guess",
    s.q("cat", f"""SELECT id, array_to_string(list_slice(w, 1, CASE WHEN list_contains({s.values(fv.HOUSE_PREFIXES)}, lower(w[1])) THEN 3 ELSE 2 END), ' ') AS guess
      FROM (SELECT id, string_split(trim(regexp_replace(regexp_replace(producer || ' ' || name || ' ' || (1990 + catalog_ordinal % 30), '\\b(19|20)\\d{{2}}\\b', '', 'g'), '\\s+', ' ', 'g')), ' ') AS w FROM cat)"""),
)
def _(spark, sf):
    title = F.concat_ws(" ", "producer", "name", (1990 + F.col("catalog_ordinal") % 30).cast("string"))
    return v.cat(spark, sf).select("id", tx.producer_guess(title).alias("guess"))


@register(
    "cache_key",
    s.q("menu", """SELECT item_id, concat_ws(':', 'pricing', 'p' || l_partkey, coalesce(CAST(given_vintage AS VARCHAR), 'nv')) AS price_key,
      'dynamic_lookup:' || md5(concat_ws(':', trim(lower(menu_text)), CAST(given_vintage AS VARCHAR))) AS text_key FROM menu"""),
)
def _(spark, sf):
    product = F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    return v.menu(spark, sf).select(
        "item_id", tx.price_cache_key(product, F.col("given_vintage")).alias("price_key"),
        tx.lookup_cache_key(F.col("menu_text"), F.col("given_vintage")).alias("text_key"),
    )


@register(
    "split_vintage_key",
    s.q("offers", """SELECT wine_id, base, year, count(*) AS n FROM (SELECT wine_id,
        CASE WHEN regexp_matches(k, '-\\d{4}$') THEN left(k, length(k) - 5) ELSE k END AS base,
        CASE WHEN regexp_matches(k, '-\\d{4}$') THEN CAST(right(k, 4) AS INTEGER) END AS year
      FROM (SELECT wine_id, wine_id || CASE WHEN vintage IS NULL THEN '' ELSE '-' || vintage END AS k FROM offers)) GROUP BY ALL"""),
)
def _(spark, sf):
    key = F.concat("wine_id", F.coalesce(F.concat(F.lit("-"), F.col("vintage").cast("string")), F.lit("")))
    base, year = tx.split_vintage_key(key)
    return v.offers(spark, sf).groupBy("wine_id", base.alias("base"), year.alias("year")).agg(F.count(F.lit(1)).alias("n"))


@register(
    "money_parse",
    s.q("ev", """SELECT event_id, TRY_CAST(regexp_replace(m, '[$,]', '', 'g') AS DOUBLE) AS amount FROM (
      SELECT event_id, CASE event_id % 4 WHEN 0 THEN '$1,' || (100 + event_id % 900) || '.50' WHEN 1 THEN CAST(price AS VARCHAR)
        WHEN 2 THEN 'ask' ELSE '$' || (event_id % 50) END AS m FROM ev)"""),
)
def _(spark, sf):
    e = F.col("event_id")
    text = (
        F.when(e % 4 == 0, F.concat(F.lit("$1,"), (100 + e % 900).cast("string"), F.lit(".50")))
        .when(e % 4 == 1, F.col("price").cast("string")).when(e % 4 == 2, "ask")
        .otherwise(F.concat(F.lit("$"), (e % 50).cast("string")))
    )
    return v.events(spark, sf).select("event_id", tx.money(text).alias("amount"))


@register(
    "first_present",
    s.q("ev", """SELECT event_id, coalesce(json_extract_string(props, '$.price'), json_extract_string(props, '$.k'), kind) AS first_value,
      coalesce(CASE WHEN event_id % 2 = 0 THEN kind END, wine_id) AS second_value FROM ev"""),
)
def _(spark, sf):
    j = lambda k: F.get_json_object("props", f"$.{k}")
    return v.events(spark, sf).select(
        "event_id", F.coalesce(j("price"), j("k"), F.col("kind")).alias("first_value"),
        F.coalesce(F.when(F.col("event_id") % 2 == 0, F.col("kind")), F.col("wine_id")).alias("second_value"),
    )


@register(
    "token_set_algebra",
    s.q("pairs", """SELECT a, b, array_to_string(list_sort(list_intersect(x, y)), ' ') AS both_, array_to_string(list_sort(list_filter(x, lambda t: NOT list_contains(y, t))), ' ') AS only_a,
      array_to_string(list_sort(list_distinct(list_concat(x, y))), ' ') AS either_, list_has_any(x, y) AS overlap
      FROM (SELECT a, b, list_distinct(string_split(a, ' ')) AS x, list_distinct(string_split(b, ' ')) AS y FROM pairs)"""),
)
def _(spark, sf):
    x, y = F.split("a", " "), F.split("b", " ")
    join = lambda c: F.array_join(F.array_sort(c), " ")
    return v.pairs(spark, sf).select(
        "a", "b", join(F.array_intersect(x, y)).alias("both_"), join(F.array_except(x, y)).alias("only_a"),
        join(F.array_union(x, y)).alias("either_"), F.arrays_overlap(x, y).alias("overlap"),
    )


# ------------------------------------------------------------------ dates
@register(
    "parse_iso_ts",
    s.q("ev", """SELECT event_id, TRY_CAST(CASE WHEN event_id % 5 = 0 THEN NULL ELSE strftime(seen_at, '%Y-%m-%dT%H:%M:%S') END AS TIMESTAMP) AS parsed,
      event_id % 5 = 0 OR seen_at < TIMESTAMP '2024-01-15' AS stale FROM ev"""),
)
def _(spark, sf):
    e = F.col("event_id")
    text = F.when(e % 5 == 0, "not a time").otherwise(F.date_format("seen_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    parsed = F.try_to_timestamp(text)
    stale = parsed.isNull() | (F.col("seen_at") < F.lit("2024-01-15").cast("timestamp"))
    return v.events(spark, sf).select("event_id", parsed.alias("parsed"), stale.alias("stale"))


@register(
    "age_cutoff",
    s.q("ev", f"SELECT event_id, seen_at, seen_at >= {s.AS_OF} - INTERVAL 14 DAY AS fresh FROM ev"),
)
def _(spark, sf):
    from pourscale.operators.catalog import age_cutoff

    cut = age_cutoff(F.lit(v.AS_OF).cast("timestamp"), F.lit(14))
    return v.events(spark, sf).select("event_id", "seen_at", (F.col("seen_at") >= cut).alias("fresh"))


@register(
    "expires_at",
    s.q("offers", f"SELECT wine_id, l_orderkey, l_linenumber, l_suppkey, fetched_at + to_seconds(CAST({s.tier_value(chr(34) + 't' + chr(34), 'ttl_days')} * 86400 AS BIGINT)) AS expires_at FROM (SELECT *, {s.tier('price')} AS t FROM offers)"),
)
def _(spark, sf):
    from pourscale.functions import pricing as px

    o = v.offers(spark, sf).withColumn("t", px.price_tier(F.col("price")))
    return o.select(
        "wine_id", "l_orderkey", "l_linenumber", "l_suppkey",
        px.expires_at(F.col("fetched_at"), px.ttl_seconds(F.col("t"))).alias("expires_at"),
    )


@register(
    "elapsed",
    s.q("ev", "SELECT job_id, round((epoch_us(max(seen_at)) - epoch_us(min(seen_at))) / 1000000.0, 1) AS elapsed_s FROM ev GROUP BY job_id"),
)
def _(spark, sf):
    from pourscale.operators.report import elapsed_seconds

    return v.events(spark, sf).groupBy("job_id").agg(elapsed_seconds(F.min("seen_at"), F.max("seen_at")).alias("elapsed_s"))
