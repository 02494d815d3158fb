"""Corpus pipeline: quality classifier, exact dedup, near dedup, source mix, packing. Each stage reads what the one before it kept.

Defined results: without usable labels the classifier rejects nothing; null and empty texts are equal texts, of which one row stays until
the mix, which takes no document without words; rows are told apart by doc_id and text, so that null and repeated doc_ids lose
none; very long texts are whole throughout and fill bins of their own; further columns, whatever their names, are kept up to the packing;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from genoweave.llm import exact_dedup, mixing, near_dup, packing, quality
from genoweave.llm.common import materialize


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_exact_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: five-word shingles, similarity 0.8."""
    return near_dup.drop_near_copies(docs, width=5, similarity=80)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources meet their target weights."""
    return mixing.apply_mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document lies in the bins."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", good_documents),
    ("exact dedup", without_exact_copies),
    ("near dedup", without_near_copies),
    ("source mix", mixed_sources),
    ("best-fit packing", packed),
]

#: The classifier's neighbours and the packing's search can't be stated in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{k}")
    return docs
