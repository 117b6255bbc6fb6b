"""Queries of catalog upkeep and reports."""

from pyspark.sql import functions as F

from pourscale import fixed_values as fv
from pourscale.checks import sql as s, views as v
from pourscale.checks.q_offers import year_prices
from pourscale.checks.registry import register
from pourscale.session import work_folder
from pourscale.sources.readers import read_catalog
from pourscale.functions import text as tx
from pourscale.operators import catalog as c, report as r

V = s.VIEWS
YEARS = [None, *range(2013, 2024)]
_CAT = ["id", "name", "producer", "region", "country", "wine_type", "avg_retail_price", "price_tier", "catalog_ordinal"]
_C = ", ".join(_CAT)
as_of = lambda: F.lit(v.AS_OF).cast("timestamp")

# products found later: half of them known already
V["found"] = (["cat"], "SELECT CASE WHEN catalog_ordinal % 2 = 0 THEN id ELSE 'x' || (catalog_ordinal % 500) END AS id, catalog_ordinal, name, producer, region, country, CASE WHEN catalog_ordinal % 3 = 0 THEN NULL ELSE wine_type END AS wine_type, avg_retail_price + 1 AS avg_retail_price, price_tier FROM cat")


def found(spark, sf):
    o = F.col("catalog_ordinal")
    return v.cat(spark, sf).select(
        F.when(o % 2 == 0, F.col("id")).otherwise(F.concat(F.lit("x"), (o % 500).cast("string"))).alias("id"),
        "catalog_ordinal", "name", "producer", "region", "country", F.when(o % 3 != 0, F.col("wine_type")).alias("wine_type"),
        (F.col("avg_retail_price") + 1).cast("decimal(12,2)").alias("avg_retail_price"), "price_tier",
    )


@register("scan_catalog", s.q("cat", f"SELECT {_C}, array_to_string(aliases, '|') AS aliases FROM cat"))
def _(spark, sf):
    folder = work_folder(spark, "catalog")
    stored = v.cat(spark, sf).withColumn("price_tier", F.lit("ultra-luxury"))  # a stored tier is not believed
    stored.withColumn("avg_retail_price", F.col("avg_retail_price").cast("decimal(10,2)")).write.json(folder)
    return read_catalog(spark, folder, "json").select(*_CAT, F.array_join("aliases", "|").alias("aliases"))


@register("union_catalog", s.q("cat found", f"SELECT {_C} FROM (SELECT {_C}, 0 AS k FROM cat UNION ALL SELECT {_C}, 1 FROM found) QUALIFY row_number() OVER (PARTITION BY id ORDER BY k, catalog_ordinal) = 1"))
def _(spark, sf):
    return c.union_catalog(v.cat(spark, sf), found(spark, sf)).select(*_CAT)


@register("catalog_union_all", s.q("cat", "SELECT part_no, count(*) AS n, min(catalog_ordinal) AS first_ordinal, sum(avg_retail_price) AS total FROM (SELECT *, catalog_ordinal % 3 AS part_no FROM cat) GROUP BY part_no"))
def _(spark, sf):
    cat = v.cat(spark, sf)
    both = c.catalog_union_all([cat.where(f"catalog_ordinal % 3 = {i}") for i in range(3)])
    return both.groupBy("part_no").agg(F.count(F.lit(1)).alias("n"), F.min("catalog_ordinal").alias("first_ordinal"), F.sum("avg_retail_price").alias("total"))


@register("id_lookup", s.q("offers cat found", """SELECT id, n.name, n.avg_retail_price FROM (SELECT DISTINCT CASE WHEN l_suppkey % 3 = 0 THEN 'x' || (l_partkey % 900) ELSE wine_id END AS id FROM offers)
    LEFT JOIN (SELECT * FROM (SELECT id, name, avg_retail_price, catalog_ordinal, 0 AS k FROM cat UNION ALL SELECT id, name, avg_retail_price, catalog_ordinal, 1 FROM found) QUALIFY row_number() OVER (PARTITION BY id ORDER BY k, catalog_ordinal) = 1) n USING (id)"""))
def _(spark, sf):
    other = F.concat(F.lit("x"), (F.col("l_partkey") % 900).cast("string"))
    ids = v.offers(spark, sf).select(F.when(F.col("l_suppkey") % 3 == 0, other).otherwise(F.col("wine_id")).alias("id")).distinct()
    return c.id_lookup(ids, v.cat(spark, sf), found(spark, sf)).select("id", "name", "avg_retail_price")


@register("insert_if_absent", s.q("cat found", f"""SELECT {_C} FROM cat UNION ALL SELECT id, name, producer, region, country, coalesce(wine_type, 'red'), avg_retail_price, {s.tier('avg_retail_price')}, catalog_ordinal
    FROM (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY id ORDER BY catalog_ordinal) = 1) WHERE id NOT IN (SELECT id FROM cat)"""))
def _(spark, sf):
    return c.insert_if_absent(v.cat(spark, sf).select(*_CAT), found(spark, sf).select(*_CAT)).select(*_CAT)


V["cur"] = (["offers"], f"SELECT {s.other_key('l_suppkey % 4 < 3', 'c')} AS wine_id, max(price) AS avg_price FROM offers GROUP BY 1")
V["seed"] = (["offers"], f"SELECT {s.other_key('l_suppkey % 4 > 0 AND l_linenumber < 6', 's')} AS wine_id, max(price) AS avg_price FROM offers GROUP BY 1")


@register("merge_with_drift", s.q("cur seed", """SELECT wine_id, change, CASE WHEN change IN ('added', 'updated') THEN sp ELSE cp END AS avg_price FROM (
    SELECT coalesce(c.wine_id, s.wine_id) AS wine_id, c.avg_price AS cp, s.avg_price AS sp, CASE WHEN c.wine_id IS NULL THEN 'added'
      WHEN coalesce(s.avg_price <> 0 AND c.avg_price <> 0 AND abs(CAST(s.avg_price AS DOUBLE) - CAST(c.avg_price AS DOUBLE)) / greatest(CAST(c.avg_price AS DOUBLE), 1.0) > 0.01, false) THEN 'updated' ELSE 'kept' END AS change
    FROM cur c FULL JOIN seed s ON c.wine_id = s.wine_id)"""))
def _(spark, sf):
    off = v.offers(spark, sf)
    top = lambda w, other: off.groupBy(v.other_key(w, other)).agg(F.max("price").alias("avg_price"))
    return c.merge_with_drift(top("l_suppkey % 4 < 3", "c"), top("l_suppkey % 4 > 0 and l_linenumber < 6", "s"))


_YEARS = "(VALUES (NULL), " + ", ".join(f"({y})" for y in YEARS if y) + ") y(vintage)"
V["yp"] = (["offers"], f"SELECT {s.other_key('l_partkey % 20 <> 0')} AS wine_id, CASE WHEN vintage IS NULL THEN NULL ELSE vintage + 15 END AS vintage, max(price) AS price, CASE WHEN max(l_linenumber) = 7 THEN NULL ELSE TIMESTAMP '2024-01-31' - to_days(CAST(max(l_partkey) % 60 AS INTEGER)) END AS fetched_at FROM offers GROUP BY ALL")


def shifted_prices(spark, sf):
    day = F.lit("2024-01-31").cast("timestamp") - F.make_dt_interval(days=(F.max("l_partkey") % 60).cast("int"))
    return v.offers(spark, sf).groupBy(v.other_key("l_partkey % 20 <> 0"), (F.col("vintage") + 15).alias("vintage")).agg(
        F.max("price").alias("price"), F.when(F.max("l_linenumber") != 7, day).alias("fetched_at")
    )


def wines(spark, sf):
    return v.cat(spark, sf).select(F.col("id").alias("wine_id"), "price_tier")


_OPEN = lambda cond: f"NOT EXISTS (SELECT 1 FROM yp WHERE yp.wine_id = id AND yp.vintage IS NOT DISTINCT FROM y.vintage AND {cond})"


@register("worklist_cross", s.q("cat yp", f"SELECT id AS wine_id, price_tier, y.vintage FROM cat, {_YEARS} WHERE {_OPEN('true')}"))
def _(spark, sf):
    return c.freshness_worklist(wines(spark, sf), YEARS, shifted_prices(spark, sf))


@register("freshness_worklist", s.q("cat yp", f"SELECT id AS wine_id, price_tier, y.vintage FROM cat, {_YEARS} WHERE {_OPEN(f'yp.fetched_at >= {s.AS_OF} - INTERVAL 30 DAY')}"))
def _(spark, sf):
    return c.freshness_worklist(wines(spark, sf), YEARS, shifted_prices(spark, sf), as_of(), 30)


_DAYS = "CASE WHEN price_tier IN ('ultra', 'luxury') THEN 14 ELSE 30 END"


@register("tiered_refresh_set", s.q("cat yp", f"SELECT id AS wine_id, price_tier, y.vintage, {_DAYS} AS max_age_days FROM cat, {_YEARS} WHERE {_OPEN(f'yp.fetched_at >= {s.AS_OF} - to_days({_DAYS})')}"))
def _(spark, sf):
    return c.tiered_refresh_set(wines(spark, sf), YEARS, shifted_prices(spark, sf), as_of())


@register("ttl_expiry", s.q("cat yp", f"SELECT wine_id, vintage, price_tier, fetched_at + to_seconds(CAST({s.tier_value('price_tier', 'ttl_days')} * 86400 AS BIGINT)) AS expires_at, fetched_at + to_seconds(CAST({s.tier_value('price_tier', 'ttl_days')} * 86400 AS BIGINT)) > {s.AS_OF} AS valid FROM yp JOIN cat ON id = wine_id"))
def _(spark, sf):
    rows = shifted_prices(spark, sf).join(wines(spark, sf), "wine_id")
    return c.ttl_expiry(rows, as_of()).select("wine_id", "vintage", "price_tier", "expires_at", "valid")


V["idmap"] = (["cat"], "SELECT CASE WHEN catalog_ordinal % 20 <> 1 THEN id ELSE 'z' || id END AS wine_id, catalog_ordinal * 7 + 1000 AS external_id FROM cat")
V["seen_price"] = (["offers"], f"SELECT {s.other_key('l_partkey % 20 <> 0')} AS wine_id, max(price) AS price FROM offers GROUP BY 1")


def id_map(spark, sf):
    other = F.when(F.col("catalog_ordinal") % 20 != 1, F.col("id")).otherwise(F.concat(F.lit("z"), F.col("id")))
    return v.cat(spark, sf).select(other.alias("wine_id"), (F.col("catalog_ordinal") * 7 + 1000).alias("external_id"))


@register("drop_bad_mappings", s.q("idmap seen_price cat", """SELECT m.wine_id, external_id, coalesce(bad, false) AS rejected FROM idmap m LEFT JOIN (
    SELECT wine_id, NOT CAST(price AS DOUBLE) / CAST(avg_retail_price AS DOUBLE) BETWEEN 0.1 AND 10.0 AS bad FROM seen_price JOIN cat ON id = wine_id) b ON b.wine_id = m.wine_id"""))
def _(spark, sf):
    seen = v.offers(spark, sf).groupBy(v.other_key("l_partkey % 20 <> 0")).agg(F.max("price").alias("price"))
    kept, bad = c.drop_bad_mappings(id_map(spark, sf), seen, v.cat(spark, sf))
    return kept.withColumn("rejected", F.lit(False)).unionByName(bad.withColumn("rejected", F.lit(True)))


@register("id_map_join", s.q("cat idmap", "SELECT id AS wine_id, external_id, external_id IS NOT NULL AS mapped FROM cat LEFT JOIN idmap ON wine_id = id"))
def _(spark, sf):
    return c.id_map_join(wines(spark, sf).select("wine_id"), id_map(spark, sf))


@register("not_known_anti", s.q("cat found", "SELECT id, name FROM found WHERE id NOT IN (SELECT id FROM cat)"))
def _(spark, sf):
    return c.not_known_anti(found(spark, sf), v.cat(spark, sf)).select("id", "name")


def cards(spark, sf):
    o = F.col("catalog_ordinal")
    title = F.concat_ws(" ", "producer", "name", (1990 + o % 30).cast("string"))
    return v.cat(spark, sf).select(
        (o % 400 + 5000).cast("string").alias("external_id"), title.alias("title"),
        F.when(o % 5 != 0, F.col("avg_retail_price")).alias("price"), "region", "country", o.alias("ordinal"),
    )


V["cards"] = (["cat"], "SELECT CAST(catalog_ordinal % 400 + 5000 AS VARCHAR) AS external_id, producer || ' ' || name || ' ' || (1990 + catalog_ordinal % 30) AS title, CASE WHEN catalog_ordinal % 5 <> 0 THEN avg_retail_price END AS price, region, country, catalog_ordinal AS ordinal FROM cat")
_GUESS = f"array_to_string(list_slice(w, 1, CASE WHEN list_contains({s.values(fv.HOUSE_PREFIXES)}, lower(w[1])) THEN 3 ELSE 2 END), ' ')"


@register("discovered_to_catalog", s.q("cards", f"""SELECT {s.slug("title || ' ' || external_id", None)} AS id, title AS name, {_GUESS} AS producer, region, country, region AS appellation, '' AS varietal, 'red' AS wine_type,
    CAST(coalesce(price, 0) AS DECIMAL(12,2)) AS avg_retail_price, {s.tier('coalesce(price, 0)')} AS price_tier, external_id FROM (SELECT *, string_split(trim(regexp_replace(title, '\\b(19|20)\\d{{2}}\\b', '')), ' ') AS w FROM cards)"""))
def _(spark, sf):
    return c.discovered_to_catalog(cards(spark, sf))


@register("dedupe_discovered", s.q("cards", "SELECT external_id, title FROM cards WHERE CAST(external_id AS INTEGER) % 4 <> 0 QUALIFY row_number() OVER (PARTITION BY external_id ORDER BY ordinal) = 1"))
def _(spark, sf):
    rows = cards(spark, sf).withColumn("id", F.concat(F.lit("p"), F.col("external_id")))
    known = rows.where(F.col("external_id").cast("int") % 4 == 0).select("id")
    return c.dedupe_discovered(rows, known).select("external_id", "title")


@register("cap_per_group", s.q("cat", "SELECT id, region FROM cat QUALIFY row_number() OVER (PARTITION BY region ORDER BY catalog_ordinal) <= 5"))
def _(spark, sf):
    return c.cap_per_group(v.cat(spark, sf), "region", ["catalog_ordinal"], 5).select("id", "region")


@register("region_fill", s.q("cat", "SELECT region, n FROM (SELECT region || ', ' || wine_type AS region, count(*) AS n FROM cat GROUP BY 1) WHERE n < 16"))
def _(spark, sf):
    cat = v.cat(spark, sf).withColumn("region", F.concat_ws(", ", "region", "wine_type"))
    return c.region_fill(cat, cat.select("region").distinct(), 16)


@register("id_set_ops", s.q("yp cat", "(SELECT wine_id FROM yp WHERE vintage IS NULL UNION SELECT wine_id FROM yp WHERE vintage IS NOT NULL) INTERSECT SELECT id FROM cat"))
def _(spark, sf):
    return c.id_set_ops(shifted_prices(spark, sf), v.cat(spark, sf))


# ------------------------------------------------------------------ reports
@register("count_by", s.q("cat", "SELECT 'country' AS kind, country AS value, count(*) AS n FROM cat GROUP BY country UNION ALL SELECT 'price_tier', price_tier, count(*) FROM cat GROUP BY 2 UNION ALL SELECT 'wine_type', wine_type, count(*) FROM cat GROUP BY 2"))
def _(spark, sf):
    return r.count_by(v.cat(spark, sf))


@register("top_regions", s.q("cat", "SELECT trim(split_part(region, ',', 1)) AS region_head, count(*) AS n FROM cat GROUP BY 1 ORDER BY n DESC, min(catalog_ordinal) LIMIT 25"))
def _(spark, sf):
    return r.top_regions(v.cat(spark, sf))


@register("fold_variants", s.q("cat", "SELECT CASE WHEN wine_type IN ('rose', 'rosé') THEN 'rosé' ELSE wine_type END AS wine_type, count(*) AS n FROM (SELECT CASE WHEN catalog_ordinal % 9 = 0 THEN 'rosé' ELSE wine_type END AS wine_type FROM cat) GROUP BY 1"))
def _(spark, sf):
    t = F.when(F.col("catalog_ordinal") % 9 == 0, "rosé").otherwise(F.col("wine_type"))
    return r.fold_variants(v.cat(spark, sf).withColumn("wine_type", t))


V["flags_"] = (["cat", "yp"], "SELECT id, country, coalesce(g, false) AS generic, coalesce(n, 0) AS years FROM cat LEFT JOIN (SELECT wine_id, bool_or(vintage IS NULL) AS g, count(DISTINCT vintage) AS n FROM yp GROUP BY wine_id) ON wine_id = id")


@register("coverage_stats", s.q("flags_", "SELECT count(*) AS total, count(*) FILTER (generic) AS generic_priced, CAST(sum(years) AS BIGINT) AS vintage_entries, count(*) FILTER (generic OR years > 0) AS covered, CAST(round_even(100.0 * count(*) FILTER (generic OR years > 0) / count(*), 0) AS INTEGER) AS covered_pct, count(*) - count(*) FILTER (generic OR years > 0) AS unpriced FROM flags_"))
def _(spark, sf):
    return r.coverage_stats(v.cat(spark, sf), shifted_prices(spark, sf))


@register("country_coverage", s.q("flags_", "SELECT country, count(*) AS total, count(*) FILTER (generic) AS priced, CAST(round_even(100.0 * count(*) FILTER (generic) / count(*), 0) AS INTEGER) AS pct FROM flags_ GROUP BY country"))
def _(spark, sf):
    return r.country_coverage(v.cat(spark, sf), shifted_prices(spark, sf))


@register("coverage_semi", s.q("flags_", "SELECT id, generic OR years > 0 AS priced FROM flags_"))
def _(spark, sf):
    have, lack = r.coverage_semi(v.cat(spark, sf), shifted_prices(spark, sf))
    return have.select("id", F.lit(True).alias("priced")).unionByName(lack.select("id", F.lit(False).alias("priced")))


@register("avg_price_by_country", s.q("cat", "SELECT country, round_even(CAST(sum(avg_retail_price) AS DOUBLE) / count(*), 0) AS avg_price FROM cat GROUP BY country"))
def _(spark, sf):
    return r.avg_price_by_country(v.cat(spark, sf))


@register("run_summary", s.q("ev", "SELECT run_id, count(*) AS total, count(*) FILTER (ok) AS success, count(*) FILTER (NOT ok) AS failed, CAST(round_even(100.0 * count(*) FILTER (ok) / greatest(count(*), 1), 0) AS INTEGER) AS found_pct, round((epoch_us(max(seen_at)) - epoch_us(min(seen_at))) / 1000000.0, 1) AS elapsed_s FROM (SELECT job_id AS run_id, kind <> 'error' AS ok, seen_at FROM ev) GROUP BY run_id"))
def _(spark, sf):
    return r.run_summary(v.events(spark, sf).select(F.col("job_id").alias("run_id"), (F.col("kind") != "error").alias("ok"), "seen_at"))


@register("job_progress", s.q("ev", "SELECT job_id, total, coalesce(done, 0) AS done, coalesce(done, 0) >= total AS finished FROM (SELECT job_id, count(DISTINCT wine_id) AS total, count(DISTINCT CASE WHEN kind IN ('purchase', 'view', 'click') THEN wine_id END) AS done FROM ev GROUP BY job_id)"))
def _(spark, sf):
    e = v.events(spark, sf).select("job_id", F.col("wine_id").alias("item"), "kind")
    return r.job_progress(e.select("job_id", "item").distinct(), e.where(F.col("kind").isin("purchase", "view", "click")))
