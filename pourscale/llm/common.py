"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import pourscale
from pourscale.session import work_folder


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once a session: they need not have it installed."""
    context = spark.sparkContext
    if not getattr(context, "_pourscale_shipped", False):
        root = os.path.dirname(os.path.dirname(os.path.abspath(pourscale.__file__)))
        context.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="spark-"), "pourscale"), "zip", root, "pourscale"))
        context._pourscale_shipped = True


def prepare(spark: SparkSession, rows: int = 512, size: int = 4 << 20) -> None:
    """Ships the package and bounds Arrow batches by rows and bytes: with the default of 10 000 rows, long texts fill a worker's memory."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """The same rows as a table in the shared folder: read twice, computed once, with no lineage before it."""
    spark = df.sparkSession
    path = work_folder(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """A column name that no column of df has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_digest(text="text"):
    """Key of a text; null counts as empty."""
    return F.md5(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def id_crc(column: str = "doc_id"):
    """crc32 of an id written as text; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
