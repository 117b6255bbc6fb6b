"""A keyed table in files: whole versions, repeated batches count once, a batch rewrites only the buckets it touches.

Rows lie in buckets by the hash of their keys. A batch reads the buckets its keys fall into, merges, writes these
buckets under its own number, and then a manifest that names for every bucket the batch that wrote it last. The
manifest is complete with its success marker, which the writer sets at the very end, so readers see the table before the
batch or after it and nothing between. A batch that is repeated starts from the manifest before it and gives the same
table. Files that neither of the two newest manifests names are removed.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

BUCKETS = 16
Merge = Callable[[DataFrame | None, DataFrame], DataFrame]


def _files(spark: SparkSession, path: str):
    """The file system of a path, and the path as it knows it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _exists(spark: SparkSession, path: str) -> bool:
    files, at = _files(spark, path)
    return files.exists(at)


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The complete versions of the table, in order."""
    files, at = _files(spark, f"{folder}/manifest")
    if not files.exists(at):
        return []
    names = [x.getPath() for x in files.listStatus(at)]
    done = [p for p in names if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(m[1]) for p in done if (m := re.search(r"version=(\d+)$", p.toString())))


def manifest(spark: SparkSession, folder: str, version: int) -> dict[int, int]:
    """The batch that wrote each bucket last, as of a version: one entry a bucket."""
    return {r["bucket"]: r["batch"] for r in spark.read.parquet(f"{folder}/manifest/version={version}").collect()}


def _read(spark: SparkSession, folder: str, where: dict[int, int]) -> DataFrame | None:
    paths = [f"{folder}/rows/batch={batch}/bucket={bucket}" for bucket, batch in sorted(where.items())]
    return spark.read.parquet(*paths) if paths else None


def read_table(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame | None:
    """The newest complete version, or the given one; None where there is none."""
    known = versions(spark, folder)
    if not known:
        return None
    return _read(spark, folder, manifest(spark, folder, known[-1] if version is None else version))


def update_table(rows: DataFrame, folder: str, batch: int, keys: list[str], merge: Merge, buckets: int = BUCKETS) -> None:
    """Merges a batch into the table: ``merge`` takes the old rows of the buckets touched (None: none) and the new rows."""
    spark = rows.sparkSession
    before = [x for x in versions(spark, folder) if x < batch]
    known = manifest(spark, folder, before[-1]) if before else {}
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    rows = rows.persist()  # read for the buckets and for the merge; a lost copy is computed again
    try:
        touched = [r[0] for r in rows.select(bucket).distinct().collect()]  # at most ``buckets`` numbers
        if touched:
            old = _read(spark, folder, {b: known[b] for b in touched if b in known})
            made = merge(old, rows).withColumn("bucket", bucket).repartition(len(touched), "bucket")
            made.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/rows/batch={batch}")
        filled = [b for b in touched if _exists(spark, f"{folder}/rows/batch={batch}/bucket={b}")]  # a merge may leave a bucket empty
        now = {b: of for b, of in known.items() if b not in touched} | {b: batch for b in filled}
        entries = spark.createDataFrame(sorted(now.items()) or [], "bucket int, batch bigint").coalesce(1)
        entries.write.mode("overwrite").parquet(f"{folder}/manifest/version={batch}")
    finally:
        rows.unpersist()
    if len(before) > 1:
        for b, of in manifest(spark, folder, before[-2]).items():
            if of not in (known.get(b), now.get(b)):
                files, at = _files(spark, f"{folder}/rows/batch={of}/bucket={b}")
                files.delete(at, True)
        files, at = _files(spark, f"{folder}/manifest/version={before[-2]}")
        files.delete(at, True)


def largest(keys: list[str], order: list[str]) -> Merge:
    """Keeps the row of a key that is largest by ``order``."""

    def merge(old: DataFrame | None, new: DataFrame) -> DataFrame:
        both = new if old is None else old.unionByName(new)
        rest = [c for c in new.columns if c not in keys]
        return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_s")).select(*keys, "_s.*")

    return merge


def summed(keys: list[str]) -> Merge:
    """Adds the numbers of a key up."""

    def merge(old: DataFrame | None, new: DataFrame) -> DataFrame:
        both = new if old is None else old.unionByName(new)
        return both.groupBy(*keys).agg(*(F.sum(c).cast(new.schema[c].dataType).alias(c) for c in new.columns if c not in keys))

    return merge
