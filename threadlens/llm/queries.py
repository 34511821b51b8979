"""The corpus operators as queries over the whole of the given tables, and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from threadlens.llm import (
    alignment, chunk_reuse, decontamination, filter_audit, order_minhash, packing, quality, simhash, suffix_dedup, token_files, token_rollup, toxicity, url_filter,
)
from threadlens.llm.common import prepared, table

QUERIES: dict = {}


def query(function):
    """Register a query under its function name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(prepared(spark), sf_dir)

    QUERIES[function.__name__] = run
    return run


@query
def op1_toxicity(spark, d):
    return toxicity.toxicity(table(spark, d, "documents"), table(spark, d, "labels"))


@query
def op2_suffix_array_dedup(spark, d):
    return suffix_dedup.repeat_digests(table(spark, d, "documents"))


@query
def op3_token_files(spark, d):
    return token_files.token_files(table(spark, d, "documents"))


@query
def op4_token_counts(spark, d):
    return token_rollup.maintained_counts(table(spark, d, "documents"))


@query
def op5_benchmark_decontamination(spark, d):
    found = decontamination.leaks(table(spark, d, "documents"), table(spark, d, "benchmark"))
    return found.drop("row_key")


@query
def op6_quality_classifier(spark, d):
    return quality.quality(table(spark, d, "documents"), table(spark, d, "labels"))


@query
def op7_best_fit_packing(spark, d):
    return packing.pack(table(spark, d, "documents"))


@query
def op8_simhash_near_dedup(spark, d):
    return simhash.near_duplicates(table(spark, d, "documents"))


@query
def op9_order_minhash(spark, d):
    return order_minhash.edited_fingerprints(table(spark, d, "documents"))


@query
def op10_url_filter(spark, d):
    return url_filter.judge(table(spark, d, "pages"), url_filter.labelled_pages(table(spark, d, "labels")))


@query
def op11_pair_bitmaps(spark, d):
    return alignment.alignment(table(spark, d, "documents"))


@query
def op12_chunk_reuse(spark, d):
    return chunk_reuse.encoding_digests(table(spark, d, "documents"))


@query
def op13_filter_interactions(spark, d):
    return filter_audit.filter_interactions(table(spark, d, "documents"), table(spark, d, "labels"))
