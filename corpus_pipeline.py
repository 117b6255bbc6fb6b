"""From raw documents to packed training sequences, in five stages.

Each stage works on all rows its predecessor kept, written as Parquet and read again.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pourscale.llm import langid, mixing, nearcopies, packing, secrets, simhash
from pourscale.llm.common import prepare, read, text_digest, unused, written
from pourscale.llm.queries import piece_rows


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification doesn't reject. It learns from all rows with a language."""
    prepare(spark)
    found = unused(docs, "language")
    model = langid.fit(docs)
    return docs.withColumn(found, langid.identify(spark, model)("text")).where(~F.col(f"{found}.rejected")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word Jaccard similarity of 0.8 or more."""
    prepare(spark)
    return simhash.keep_one(docs, nearcopies.near_copies)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, found secrets and what is linked to them masked."""
    prepare(spark)
    return secrets.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in whole documents: a part taken counts from one half on.

    Rows with equal ids and texts are one document here that is taken as often as all of them.
    """
    digest = unused(docs, "text_key")
    keyed = docs.withColumn(digest, text_digest())
    taken, _ = mixing.mix(keyed, ["doc_id", digest])
    times = F.floor(F.try_divide("taken", "mix_size") + 0.5).cast("int")
    own, key, copies = unused(keyed, "mix_id"), unused(keyed, "mix_key"), unused(keyed, "mix_copies")
    taken = taken.select(F.col("doc_id").alias(own), F.col(digest).alias(key), times.alias(copies)).where(F.col(copies) > 0)
    taken = written(taken.groupBy(own, key).agg(F.sum(copies).cast("int").alias(copies), F.count(F.lit(1)).alias("rows")), "mix-taken")
    rows = keyed.join(taken, keyed["doc_id"].eqNullSafe(taken[own]) & (keyed[digest] == taken[key]))
    single = rows.where(taken["rows"] == 1).select(*docs.columns, copies)
    several = rows.where(taken["rows"] > 1).dropDuplicates(["doc_id", digest]).select(*docs.columns, copies)
    return single.unionByName(several).withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences. The stages before have filled the executors' heaps, so the encoder remembers less."""
    prepare(spark)
    return piece_rows(packing.pack(docs, memo=32 << 20))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("secret_scan", secret_scan), ("source_mix", source_mix), ("packed", packed)]

#: Language scores, fingerprints and token ids can't be told in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
