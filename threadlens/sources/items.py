"""Raw and typed items: multi-line CSV, parquet, temporary views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from threadlens.schema import RAW_ITEM


def read_raw_csv(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """Read dump shards whose quoted fields may span lines.

    A multi-line file cannot be split, so the dump should come in many shards; every shard is
    parsed as a stream by its own task.
    """
    return (
        spark.read.schema(RAW_ITEM)
        .option("multiLine", True)
        .option("escape", '"')
        .option("header", header)
        .csv(path)
    )


def write_raw_csv(df: DataFrame, path: str, header: bool = False) -> None:
    (
        df.select(*RAW_ITEM.names)
        .write.mode("errorifexists")
        .option("escape", '"')
        .option("header", header)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def read_items(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_items(df: DataFrame, path: str) -> None:
    """Write parquet; an existing target is an error, never overwritten."""
    df.write.mode("errorifexists").parquet(path)


def register_view(df: DataFrame, name: str) -> DataFrame:
    df.createOrReplaceTempView(name)
    return df
