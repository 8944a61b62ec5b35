"""A training-data pipeline of five operators: toxic documents go, repeated lines go, one document
of each group of near copies stays, documents with benchmark passages go, and the rest is packed.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before kept. Ends of
stages are Parquet tables in the shared folder when `run` drives them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import common, decontam, linededup, packing, simhash
from quarry.llm import toxicity as toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learned from the labelled rows of docs; those predicted toxic go."""
    return toxic.reject_toxic(docs, common.table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.without_repeats(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, a similarity of 0.8 or more."""
    return simhash.drop_near_copies(docs, words=5, similarity=0.8)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, packing.tokenizer_text())


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", pack),
]

#: The first and the last stage can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.written(docs)
    return docs
