"""The corpus pipeline: five stages over documents, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import shared, stages


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.one_of_each_group(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.cut_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.sample_mixture(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("decontamination", decontamination), ("mixing", mixing)]
#: Learned scores, fingerprints and byte spans have no SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the last stage; what the stages before have written is removed when the next one has read it."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    at = shared.fresh(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        with shared.swept(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}-{name}")
        shared.remove(spark, *before)
        before = [f"{at}/{k}-{name}"]
        docs = spark.read.parquet(before[0])
    return docs
