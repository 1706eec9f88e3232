"""From raw documents to balanced training shards: toxicity, near duplicates, benchmark leaks, source mix, shards.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept,
and returns documents; run() writes every stage as Parquet into the shared
folder and rereads it, so a lost executor repeats a stage's task and no more.
Nulls, empty and very long texts, repeated rows, empty tables and further
columns pass as the operators define; further columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pingframe.llm import decontam, mixing, sharding, simhash, toxicity
from pingframe.llm.common import shared_folder, table

#: Shards of the result.
SHARDS = 40


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8), that with the smallest id."""
    return simhash.keep_one_similar(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def balance(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and the place in it."""
    return sharding.balanced_shards(docs, SHARDS).select(*[c for c in docs.columns if c.lower() not in ("shard", "slot")], F.col("shard"), F.col("slot"))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_copies), ("decontamination", drop_leaks), ("mixing", mix_sources), ("sharding", balance)]

#: The classifier, the fingerprints and the edit distances are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
