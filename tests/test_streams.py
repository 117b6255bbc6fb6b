"""Keyed tables and the streams into them: restarts, repeated and broken batches, what a batch writes."""

import glob
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pourscale.sources import keyed_table as kt
from pourscale.sources.readers import write_price_table
from pourscale.streaming import streams as st

SCHEMA = "event_id bigint, wine_id string, price int, seen_at timestamp, kind string"
START = datetime(2024, 1, 1)


def feed(spark, folder, name, rows):
    df = spark.createDataFrame([(i, w, p, START + timedelta(hours=h), k) for i, w, p, h, k in rows], SCHEMA)
    df.coalesce(1).write.mode("append").parquet(f"{folder}/{name}")
    for f in glob.glob(f"{folder}/{name}/*.parquet"):
        target = f"{folder}/in/{name}-{os.path.basename(f)}"
        if not os.path.exists(target):
            os.makedirs(f"{folder}/in", exist_ok=True)
            os.link(f, target)


BATCHES = [
    [(1, "a", 10, 1, "x"), (2, "b", 20, 2, "y")],
    [(3, "a", 11, 5, "x"), (4, "c", 30, 60, "x")],
    [(5, "a", 9, 3, "y"), (6, "b", 21, 2, "x"), (7, "d", 1, 1000, "y")],
    [(8, "c", 5, 1, "x")],  # weeks late
]


def test_price_stream_over_batches_restarts_and_reruns(spark, tmp_path):
    best, counts = {}, {}
    for n, rows in enumerate(BATCHES):
        feed(spark, tmp_path, f"part{n}", rows)
        for i, w, p, h, k in rows:
            best[w] = max(best.get(w, (-1, 0, 0)), (h, i, p))
            key = ((START + timedelta(hours=h)).date(), k)
            counts[key] = counts.get(key, 0) + p
        for _ in range(2):  # the second run has no new input
            events = st.read_stream(spark, f"{tmp_path}/in", SCHEMA)
            got = st.stream_price_upsert(events, f"{tmp_path}/prices").collect()
            assert {r["wine_id"]: r["price"] for r in got} == {w: p for w, (_, _, p) in best.items()}
            got = st.stream_log(events.select("seen_at", "kind", "price"), f"{tmp_path}/log").collect()
            assert {(r["day"].date(), r["kind"]): r["total"] for r in got} == counts
    assert len(kt.versions(spark, f"{tmp_path}/prices/table")) <= 2


def test_discovered_products_are_known_to_later_batches(spark, tmp_path):
    schema = "id string, name string, catalog_ordinal bigint, wine_type string, avg_retail_price double"
    known = spark.createDataFrame([("k1",)], "id string")
    for n, names in enumerate((["k1:no", "n1:first"], ["n1:second", "n2:two"])):
        rows = [(x.split(":")[0], x.split(":")[1], i, None, None) for i, x in enumerate(names)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        got = st.stream_discover(st.read_stream(spark, f"{tmp_path}/in", schema), known, f"{tmp_path}/found").collect()
    assert {(r["id"], r["name"]) for r in got} == {("n1", "first"), ("n2", "two")}


def prices(spark, rows):
    return spark.createDataFrame([(w, p, START + timedelta(days=d)) for w, p, d in rows], "wine_id string, price int, fetched_at timestamp")


def test_a_batch_writes_only_the_buckets_it_touches_and_may_be_repeated(spark, tmp_path):
    folder = str(tmp_path / "prices")
    write_price_table(prices(spark, [(f"w{i}", i, 0) for i in range(200)]), folder, 0)
    update = prices(spark, [("w7", 1000, 1)])
    for _ in range(2):
        write_price_table(update, folder, 1)
        got = {r["wine_id"]: r["price"] for r in kt.read_table(spark, folder).collect()}
        assert got == {f"w{i}": i for i in range(200)} | {"w7": 1000}
    assert len(glob.glob(f"{folder}/rows/batch=0/bucket=*")) == kt.BUCKETS and len(glob.glob(f"{folder}/rows/batch=1/bucket=*")) == 1
    for batch in range(2, 8):
        write_price_table(prices(spark, [("w7", batch, batch)]), folder, batch)
    assert len(kt.versions(spark, folder)) == 2 and len(glob.glob(f"{folder}/rows/batch=*/bucket=*")) < kt.BUCKETS + 4
    assert kt.read_table(spark, folder).where("wine_id = 'w7'").first()["price"] == 7


def test_readers_see_the_old_version_of_a_write_that_breaks_off(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "prices")
    write_price_table(prices(spark, [("a", 1, 0), ("b", 2, 0)]), folder, 0)
    broken = prices(spark, [("a", 5, 1)]).withColumn("price", F.when(F.col("wine_id") == "a", F.raise_error(F.lit("lost"))).otherwise(F.col("price")))
    with pytest.raises(Exception, match="lost"):
        write_price_table(broken, folder, 1)
    true = type(spark).createDataFrame

    def lost(*args, **more):
        raise OSError("no manifest")

    monkeypatch.setattr(type(spark), "createDataFrame", lost)  # rows are written, the manifest is not
    update = spark.read.parquet(f"{folder}/rows/batch=0").select("wine_id", F.lit(7).alias("price"), F.current_timestamp().alias("fetched_at"))
    with pytest.raises(OSError):
        write_price_table(update, folder, 1)
    monkeypatch.setattr(type(spark), "createDataFrame", true)
    assert {r["wine_id"]: r["price"] for r in kt.read_table(spark, folder).collect()} == {"a": 1, "b": 2}
    write_price_table(prices(spark, [("a", 5, 1)]), folder, 1)
    assert {r["wine_id"]: r["price"] for r in kt.read_table(spark, folder).collect()} == {"a": 5, "b": 2}
