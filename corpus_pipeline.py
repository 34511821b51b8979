"""From raw documents to packed sequences: five stages, each one of the corpus operators over all that is left.

A stage takes ``(spark, docs, sf_dir)`` and returns the columns of ``documents``, the last one its pieces. Every
stage's rows are stored before the next one reads them, so a lost executor costs a part of one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from threadlens.llm import decontamination, packing, quality, simhash, suffix_dedup
from threadlens.llm.common import prepared, table
from threadlens.session import materialize


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.accepted(docs, table(prepared(spark), sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    prepared(spark)
    return simhash.representatives(docs)


def no_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that occur elsewhere, too."""
    prepared(spark)
    return suffix_dedup.without_repeats(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.without_leaks(docs, table(prepared(spark), sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences."""
    prepared(spark)
    return packing.pack(docs)


STAGES = [
    ("quality", good_quality),
    ("near duplicates", one_of_each),
    ("repeats", no_repeats),
    ("benchmark", no_benchmark),
    ("packing", packed),
]

# Classifier, tokenizer and suffix arrays are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepared(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
