"""What the corpus operators share: tables, task functions over Arrow batches, folds, doc-column order."""

from __future__ import annotations

import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows may carry whole documents of some 100 KB, so few of them make a batch.
BATCH_ROWS = "256"


def prepared(spark: SparkSession) -> SparkSession:
    """Small Arrow batches: a batch is the unit of memory in every task function of this folder."""
    from threadlens.session import prepare

    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: Column, n: int) -> Column:
    """crc32 of the key as text modulo ``n``; a null key falls in fold 0."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % n, F.lit(0))


def texts(df: DataFrame) -> Column:
    """The text column; null counts as empty."""
    return F.coalesce(df["text"].cast("string"), F.lit(""))


def named(df: DataFrame, column: str) -> Column:
    """A column by its name as it is, dots and all."""
    return df["`" + column.replace("`", "``") + "`"]


def ship(spark: SparkSession, value: object) -> Broadcast:
    """Broadcast an object with its class, as executors need not have this package; read it with ``shipped``."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def shipped(broadcast: Broadcast) -> object:
    return cloudpickle.loads(broadcast.value)


def labelled_sample(labels: DataFrame, label: str, kept: Column, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """``(doc_id, label)`` of at most ``per_class`` labelled rows of each class, those with the smallest hashes,
    and how many rows of each class there are in all. ``kept`` says which ids may be learned from.

    Ids with contradicting labels count as the smaller one. The sample's size is bounded by the parameter.
    """
    rows = labels.where(kept & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).cast("int").alias("label"))
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    some = [rows.where(F.col("label") == c).orderBy(*order).limit(per_class) for c in (0, 1)]
    return some[0].union(some[1]), {c: counts.get(c, 0) for c in (0, 1)}


def texts_of(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """``(doc_id, label, text)`` of a bounded sample: its ids go to where the texts lie. Repeated rows count once."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), texts(docs).alias("text"))
    return rows.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
