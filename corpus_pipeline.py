"""A training corpus in five stages: quality, near duplicates, benchmark passages, source weights, shards.

Each stage takes ``(spark, docs, sf_dir)`` and returns a frame; what it returns is written as Parquet into the
shared folder and read again as the next stage's ``docs``.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelworks import ship
from panelworks.llm import decontam, mixing, quality, sharding, simhash
from panelworks.llm.common import materialize

#: SQL can't express the classifier; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.fit(docs, labels), threshold=0.3)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, by five-word shingles at similarity 0.8 or more, the document of smallest id stays."""
    ship(spark)
    return simhash.keep_one(docs, shingle=5, similarity=0.8)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain an item of the benchmark go."""
    ship(spark)
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated, or left out, so that sources meet their target weights."""
    ship(spark)
    return mixing.repeat_documents(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of each row."""
    ship(spark)
    return sharding.shard(docs, shards=40).drop("key")


STAGES = [
    ("quality classifier", good_quality),
    ("SimHash near-dedup", one_of_near_duplicates),
    ("benchmark decontamination", without_benchmark),
    ("mixing", mixed),
    ("sharding", sharded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{i + 1}")
    return docs
