"""Queries of the incremental tables: each stream runs over all its input and equals its batch form."""

from pyspark.sql import functions as F

from pourscale.checks import sql as s, views as v
from pourscale.checks.q_estimates import ANALYSIS_SQL, analysis_rows, analyzed
from pourscale.checks.registry import register
from pourscale.streaming import streams as st

as_of = lambda: F.lit(v.AS_OF).cast("timestamp")


def event_stream(spark, sf):
    schema = v.table(spark, sf, "events").schema
    return v.event_columns(st.read_stream(spark, f"{sf}/event[s].parquet", schema))


@register("stream_log", s.q("ev", "SELECT date_trunc('day', seen_at) AS day, kind, count(*) AS n, sum(price) AS total FROM ev GROUP BY ALL"))
def _(spark, sf):
    return st.stream_log(event_stream(spark, sf).select("seen_at", "kind", "price"), st.new_folder(spark, "log"))


@register("sink_append_log", s.q("ev", "SELECT job_id, count(*) AS n, sum(price) AS total FROM ev GROUP BY job_id"))
def _(spark, sf):
    from pourscale.sources.readers import append_log

    path = st.new_folder(spark, "append")
    rows = v.events(spark, sf).select("event_id", "job_id", "price", F.col("seen_at").alias("analyzed_at"))
    for part in (0, 1, 1):  # two appends to one table, one of them repeated
        append_log(rows.where(F.col("event_id") % 2 == part), path, part)
    return spark.read.parquet(path).groupBy("job_id").agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("total"))


@register("stream_inflight_dedupe", s.q("ev", "SELECT DISTINCT wine_id FROM ev"))
def _(spark, sf):
    return st.stream_inflight_dedupe(event_stream(spark, sf).select("wine_id", "seen_at"), st.new_folder(spark, "flight"))


@register("stream_price_upsert", s.q("ev", "SELECT wine_id, arg_max(price, (seen_at, event_id)) AS price, max(seen_at) AS seen_at FROM ev GROUP BY wine_id"))
def _(spark, sf):
    return st.stream_price_upsert(event_stream(spark, sf).select("event_id", "wine_id", "price", "seen_at"), st.new_folder(spark, "upsert"))


@register("stream_ttl", s.q("ev", f"SELECT wine_id, price, {s.tier('price')} AS price_tier, seen_at + to_days(CAST({s.tier_value('(' + s.tier('price') + ')', 'ttl_days')} AS INTEGER)) > {s.AS_OF} AS valid FROM (SELECT wine_id, arg_max(price, (seen_at, event_id)) AS price, max(seen_at) AS seen_at FROM ev GROUP BY wine_id)"))
def _(spark, sf):
    rows = event_stream(spark, sf).select("event_id", "wine_id", "price", "seen_at")
    return st.stream_ttl(rows, st.new_folder(spark, "ttl"), as_of()).select("wine_id", "price", "price_tier", "valid")


@register("stream_job_progress", s.q("ev", "SELECT job_id, count(DISTINCT wine_id) AS total, count(DISTINCT CASE WHEN kind <> 'error' THEN wine_id END) AS done, count(DISTINCT CASE WHEN kind <> 'error' THEN wine_id END) >= count(DISTINCT wine_id) AS finished FROM ev GROUP BY job_id"))
def _(spark, sf):
    done = event_stream(spark, sf).where("kind <> 'error'").select("job_id", F.col("wine_id").alias("item"), "seen_at")
    items = v.events(spark, sf).select("job_id", F.col("wine_id").alias("item")).distinct()
    return st.stream_job_progress(done, items, st.new_folder(spark, "jobs"))


@register("stream_discover", "SELECT id, name FROM (SELECT 'n' || (p_partkey % 700) AS id, arg_min(p_name, p_partkey) AS name FROM part GROUP BY 1) WHERE CAST(substr(id, 2) AS INTEGER) % 5 <> 0")
def _(spark, sf):
    p = v.table(spark, sf, "part")
    shape = lambda d: d.select(
        F.concat(F.lit("n"), (F.col("p_partkey") % 700).cast("string")).alias("id"), F.col("p_name").alias("name"),
        F.col("p_partkey").alias("catalog_ordinal"), F.lit(None).cast("string").alias("wine_type"), F.col("p_retailprice").cast("decimal(12,2)").alias("avg_retail_price"),
    )
    known = shape(p).where("catalog_ordinal % 700 % 5 = 0").select("id").distinct()
    stream = shape(st.read_stream(spark, f"{sf}/par[t].parquet", p.schema))
    return st.stream_discover(stream, known, st.new_folder(spark, "discover")).select("id", "name")


@register("stream_analyze", ANALYSIS_SQL)
def _(spark, sf):
    rows = st.read_stream(spark, f"{sf}/lineite[m].parquet", v.table(spark, sf, "lineitem").schema)
    return st.stream_analyze(rows, st.new_folder(spark, "analyze"), lambda batch: analysis_rows(analyzed(spark, sf, v.menu(spark, sf, batch))))
