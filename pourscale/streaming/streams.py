"""Incremental versions of the log, price, catalog and analysis tables.

Streams of rows write one directory per micro-batch, overwritten when a batch is
replayed; keyed tables write versions of the buckets a batch touches. Either way a lost
executor or a restart repeats a batch without doubling it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from pourscale.functions import pricing as px
from pourscale.operators.catalog import insert_if_absent, ttl_expiry
from pourscale.operators.report import job_progress
from pourscale.session import work_folder
from pourscale.sources.keyed_table import Merge, largest, read_table, summed, update_table


def read_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def write_batches(
    stream: DataFrame, folder: str, mode: str = "append", step: Callable[[DataFrame, int], DataFrame] | None = None
) -> DataFrame:
    """Run the stream over all available input and return its written rows with ``batch``."""
    spark = stream.sparkSession
    out = f"{folder}/rows"

    def save(rows: DataFrame, batch: int) -> None:
        result = step(rows, batch) if step else rows
        result.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    query = (
        stream.writeStream.outputMode(mode).foreachBatch(save)
        .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.parquet(out)


def merge_batches(stream: DataFrame, folder: str, keys: list[str], merge: Merge) -> DataFrame:
    """Run a stream into a keyed table and return its newest version.

    A batch rewrites only the buckets its keys fall into (``keyed_table``); a restart goes on from the newest
    version, and a run without new input returns it as it is.
    """
    spark, table = stream.sparkSession, f"{folder}/table"
    query = (
        stream.writeStream.outputMode("append").foreachBatch(lambda rows, batch: update_table(rows, table, batch, keys, merge))
        .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    found = read_table(spark, table)
    return spark.createDataFrame([], stream.schema) if found is None else found


def stream_log(log: DataFrame, folder: str) -> DataFrame:
    """Daily counts per kind of logged rows (columns seen_at, kind, price).

    The counts of every batch are added to the table, so rows count whenever they arrive, however late.
    """
    keys = ["day", "kind"]
    rows = log.select(F.date_trunc("day", "seen_at").alias("day"), "kind", F.lit(1).cast("bigint").alias("n"), F.col("price").cast("decimal(22,2)").alias("total"))
    return merge_batches(rows, folder, keys, summed(keys))


def stream_inflight_dedupe(lookups: DataFrame, folder: str, watermark: str = "60 days") -> DataFrame:
    """Lookup requests without those for an id requested within the watermark."""
    once = lookups.withWatermark("seen_at", watermark).dropDuplicatesWithinWatermark(["wine_id"])
    return write_batches(once.select("wine_id"), folder).drop("batch")


def stream_price_upsert(prices: DataFrame, folder: str) -> DataFrame:
    """Latest price per product; ties in time go to the higher event id. The table is the only state."""
    rows = prices.select("wine_id", "price", "seen_at", "event_id")
    return merge_batches(rows, folder, ["wine_id"], largest(["wine_id"], ["seen_at", "event_id"])).drop("event_id")


def stream_discover(found: DataFrame, catalog: DataFrame, folder: str) -> DataFrame:
    """Products that arrive and are not in the catalog; an id already known adds nothing.

    A batch reads only the buckets of earlier finds that its own ids fall into.
    """
    ids = catalog.select("id")

    def merge(old: DataFrame | None, new: DataFrame) -> DataFrame:
        known = ids if old is None else ids.unionByName(old.select("id"))
        added = insert_if_absent(known, new).where("name is not null").select(new.columns)
        return added if old is None else old.unionByName(added)

    return merge_batches(found, folder, ["id"], merge)


def stream_job_progress(done: DataFrame, items: DataFrame, folder: str, watermark: str = "60 days") -> DataFrame:
    """Total, done and finished per job from finished items as they arrive (done: job_id, item, seen_at; items: job_id, item).

    An item counts once; state older than the watermark is dropped.
    """
    once = done.withWatermark("seen_at", watermark).dropDuplicatesWithinWatermark(["job_id", "item"])
    return job_progress(items, write_batches(once.select("job_id", "item"), folder).drop("batch"))


def stream_ttl(prices: DataFrame, folder: str, as_of) -> DataFrame:
    """Latest prices with their expiry by tier, checked at ``as_of``."""
    latest = stream_price_upsert(prices, folder).withColumn("price_tier", px.price_tier(F.col("price")))
    return ttl_expiry(latest.withColumnRenamed("seen_at", "fetched_at"), as_of)


def stream_analyze(items: DataFrame, folder: str, analyze: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run ``analyze`` (a batch plan over static catalog and prices) on each batch of items."""
    return write_batches(items, folder, step=lambda rows, _: analyze(rows)).drop("batch")


def new_folder(spark: SparkSession, name: str) -> str:
    return work_folder(spark, name)
