"""The corpus pipeline: quality, near-duplicates, decontamination, mixture, shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gneissflow import scratch
from gneissflow.llm import bbit_minhash, hilbert_shard, mixing, spaced_seeds, subword_quality
from gneissflow.session import ensure_worker_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on this stage's labelled input, does not reject."""
    return subword_quality.keep_good(docs, ensure_worker_path(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of texts whose 5-word shingles are alike to 0.8 or more."""
    ensure_worker_path(spark)
    return bbit_minhash.keep_one(docs, 5, 80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return spaced_seeds.clean(docs, ensure_worker_path(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Four fifths of the tokens, in the target weights as far as there are documents."""
    return mixing.select_documents(docs, (4, 5))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with curve, shard and slot."""
    return hilbert_shard.assign(docs, 8)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("sharding", sharding),
]

#: No SQL: the classifier is trained; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again.

    What a stage wrote on its way, and its input once the next stage is done, is removed.
    """
    docs = ensure_worker_path(spark).read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        own = docs
        docs = scratch.settled(lambda: stage(spark, own, sf_dir), name)  # noqa: B023  called at once
        if before is not None:
            scratch.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
