"""A corpus from raw documents to shards: each stage is one of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenrank.llm import mixing, sharding, similar, tiling, toxicity
from lumenrank.llm.common import drop_shared, materialise, scratch


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic by a model of the labelled ones."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of texts that share 0.8 of their five-word shingles: SimHash pairs, then all it misses."""
    return similar.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return tiling.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target mixture takes them."""
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per document: its shard and its slot."""
    return sharding.sharded_documents(docs)


STAGES = [("toxicity", reject_toxic), ("near-dedup", deduplicate), ("decontamination", decontaminate), ("mix", mix), ("shard", shard)]

#: Toxicity, linking by similarity, tiling and pivotal rounding have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with scratch(spark) as kept:
            docs = materialise(stage(spark, docs, sf_dir), name)
            kept.append(docs)
        if before is not None:
            drop_shared(spark, before)
        before = docs
    return docs
