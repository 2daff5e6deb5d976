"""A training-data pipeline over `documents`: each stage applies one operator to what the one before it has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keyloom.llm import common, decontaminate, mixing, quality, sharding, simhash
from keyloom.llm.queries import MIX, leaf_path, tokens_in


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.importable(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    names = docs.columns
    return quality.judge(docs, quality.train(docs, labels)).filter("kept").select(*names)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.importable(spark)
    return simhash.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.importable(spark)
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.select(docs, MIX, leaf_path(), tokens_in()).drop("epoch")


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.importable(spark)
    return sharding.assign(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mix),
    ("sharding", shards),
]
#: SQL cannot express the trained and the iterative stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages' rows for sf_dir's documents, with a table written between stages."""
    docs = common.importable(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.written(docs, f"stage-{k}")
    return docs
