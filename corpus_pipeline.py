"""Training-data pipeline: documents -> classified -> one of each near-duplicate group -> decontaminated -> private -> mixed.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame
that is written as Parquet and read again as the next one's docs. All but the last return the columns
of documents (and any extra columns docs has); the last adds size, source_size, target, repeats and taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import decontaminate, mixing, near_copies, pii, pu_classifier, simhash
from corpusmill.llm.common import passing, remove, stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return pu_classifier.accepted(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard similarity of 0.8 or more) stays, that with the smallest doc_id."""
    return simhash.deduplicated(spark, docs, near_copies.groups)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a region of a benchmark item go."""
    return decontaminate.clean(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in text becomes surrogates; n_chars follows the text."""
    return pii.with_surrogates(spark, docs, pii.session_key(spark)).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents the mix takes, with their repetitions."""
    return mixing.mixed_documents(spark, docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontaminated), ("pii", private), ("mixing", mixed)]

#: A trained classifier and keyed surrogates aren't SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        with passing(spark) as keep:  # what a stage stored on its way goes when its output is written
            docs = stored(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
            keep.append(docs.stored_at)
        if before:
            remove(spark, before)
        before = docs.stored_at
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
