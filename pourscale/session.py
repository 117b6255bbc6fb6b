"""Session settings and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # percentile aggregates keep many keys per task in a hash map before they sort
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "65536",
}


def build_session(master: str | None = None, app: str = "pourscale", partitions: int | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt over all cores where their files give fewer tasks than there are cores.

    Parquet is split by row groups: a file of one group is one task, however much work its rows take. A large
    input has more splits than cores and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df


#: Bytes of a table whose rows go to one task where ``dealt`` deals them.
DEALT = 16 << 20


def dealt(df: DataFrame, given: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt by keys; for a large table ``given`` that they were made of, over so many tasks that each can sort its rows in memory."""
    size = int(str(given._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    tasks = -(-size // DEALT)
    return df.repartition(tasks, *keys) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(*keys)


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder for intermediate tables and stream state.

    It lies under ``spark.checkpoint.dir``, the folder every executor reaches.
    Only a local session without that setting gets a temporary one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return os.path.join(base.rstrip("/"), f"{name}-{uuid.uuid4().hex}")


def staged(df: DataFrame, name: str) -> DataFrame:
    """The same rows as a table in the shared folder: what several later steps read is computed once, and their plans
    start from a scan instead of repeating all steps before it."""
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
