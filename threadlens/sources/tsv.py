"""Tab-separated text tables: edges, thread roots, ancestry, tagged corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.functions.text import one_line, title_tag, tokenize
from threadlens.schema import EDGE


def edge_lines(edges: DataFrame) -> DataFrame:
    return edges.select(F.concat_ws("\t", "id", "parent").alias("value"))


def write_edges(edges: DataFrame, path: str) -> None:
    edge_lines(edges).write.mode("errorifexists").text(path)


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EDGE).option("sep", "\t").csv(path)


def root_lines(threads: DataFrame) -> DataFrame:
    """``id<TAB>root``; a root has an empty second field."""
    root = F.coalesce(F.col("root").cast("string"), F.lit(""))
    return threads.select(F.concat(F.col("id").cast("string"), F.lit("\t"), root).alias("value"))


def ancestry_lines(threads: DataFrame) -> DataFrame:
    """``id<TAB>root,...,grandparent,parent``; a root has an empty second field."""
    path = F.array_join(F.transform("path", lambda x: x.cast("string")), ",")
    return threads.select(F.concat(F.col("id").cast("string"), F.lit("\t"), path).alias("value"))


def write_roots(threads: DataFrame, path: str) -> None:
    root_lines(threads).write.mode("errorifexists").text(path)


def write_ancestry(threads: DataFrame, path: str) -> None:
    ancestry_lines(threads).write.mode("errorifexists").text(path)


def read_ancestry(spark: SparkSession, path: str) -> DataFrame:
    fields = F.split("value", "\t")
    text = F.get(fields, F.lit(1))
    hops = F.when(text == "", F.array()).otherwise(F.split(text, ","))
    return spark.read.text(path).select(
        F.get(fields, F.lit(0)).cast("bigint").alias("id"), hops.cast("array<bigint>").alias("path")
    )


def corpus_lines(submissions: DataFrame) -> DataFrame:
    return submissions.select(
        F.concat(one_line(F.col("title")), F.lit("\t"), title_tag(F.col("id"))).alias("value")
    )


def write_corpus(submissions: DataFrame, path: str) -> None:
    corpus_lines(submissions).write.mode("errorifexists").text(path)


def parse_corpus(lines: DataFrame, lower: bool = True) -> DataFrame:
    """``(tag, id, words)`` from the lines of a tagged corpus."""
    fields = F.split("value", "\t")
    tag = F.get(fields, F.lit(1))
    return lines.select(
        tag.alias("tag"),
        F.regexp_extract(tag, r"^TITLE_(-?[0-9]+)$", 1).try_cast("bigint").alias("id"),
        tokenize(F.get(fields, F.lit(0)), lower).alias("words"),
    )


def read_corpus(spark: SparkSession, path: str, lower: bool = True) -> DataFrame:
    # Titles may hold other line breaks (carriage return); only the newline ends a record.
    return parse_corpus(spark.read.option("lineSep", "\n").text(path), lower)
