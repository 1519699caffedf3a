"""From raw documents to packed training sequences: five stages over whole tables.

Each stage reads what its predecessor kept, written as Parquet in the shared folder. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyframe.llm import latent_leaks, packing, repeats, rule_ensemble, simhash
from tallyframe.llm.common import scratch, tables
from tallyframe.llm.queries import tokenizer_path

ORACLE_SQL = None  # no stage can be expressed in SQL


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble does not reject."""
    return rule_ensemble.accepted(docs, tables(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: fingerprints 4 bits apart or five-word Jaccard of 0.8."""
    return simhash.one_of_each(docs, similarity=0.8)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of 200-byte strings that occur twice."""
    return repeats.without_repeats(docs, 200)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item leaks."""
    return latent_leaks.without_leaks(docs, tables(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in sequences of 2,048 tokens."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"), 2048)


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_strings),
    ("benchmark decontamination", decontaminate),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = scratch(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
