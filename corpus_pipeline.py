"""The corpus pipeline: quality, near duplicates, decontamination, mixing and sharding, each stage over all rows it gets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenql.llm.common import land, release
from lumenql.llm.decontaminate import clean
from lumenql.llm.jaccard_join import distinct_documents
from lumenql.llm.mixing import mix_documents
from lumenql.llm.quality import good_documents
from lumenql.llm.sharding import described, hilbert_shards

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with Jaccard 0.8 or more over 5-word shingles."""
    return distinct_documents(docs, 5, 4, 5).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, by weights 5, 2, 1 to 150% of all words, at most twice."""
    return mix_documents(docs).select(*COLUMNS)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with size, text_crc32, curve, shard and slot in 40 shards of a Hilbert curve."""
    return hilbert_shards(described(docs.select(*COLUMNS)), 40)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: SQL can't express the classifier, so the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = land(stage(spark, docs, sf_dir), name)
        if before is not None:  # nothing reads the rows of the stage before any more
            release(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir).withColumn("shard", F.col("shard").cast("int"))
