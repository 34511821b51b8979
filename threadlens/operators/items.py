"""Typed items and the selections every job starts from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.functions.clean import empty_as_null, epoch_to_timestamp, opt_bool, opt_int, opt_long


def typed_items(raw: DataFrame) -> DataFrame:
    """Parse the 13 text columns; only rows without a usable id are dropped.

    One projection and one filter, no shuffle; all expressions are native, so a reader of few
    columns scans few columns.
    """
    c = F.col
    return raw.select(
        empty_as_null(c("author")).alias("author"),
        opt_int(c("score")).alias("score"),
        epoch_to_timestamp(opt_long(c("time"))).alias("timestamp"),
        empty_as_null(c("title")).alias("title"),
        empty_as_null(c("type")).alias("type"),
        empty_as_null(c("url")).alias("url"),
        empty_as_null(c("text")).alias("text"),
        opt_long(c("parent")).alias("parent"),
        opt_bool(c("deleted")).alias("deleted"),
        opt_bool(c("dead")).alias("dead"),
        opt_int(c("descendants")).alias("descendants"),
        opt_long(c("id")).alias("id"),
        opt_int(c("ranking")).alias("ranking"),
    ).where(c("id").isNotNull())


def scored_stories(items: DataFrame) -> DataFrame:
    return items.where("type = 'story' AND score IS NOT NULL AND title IS NOT NULL")


def submission_corpus(items: DataFrame) -> DataFrame:
    """Stories with a title and an id; a score is not required."""
    return items.where("type = 'story' AND title IS NOT NULL AND id IS NOT NULL").select("id", "title")


def comments(items: DataFrame) -> DataFrame:
    return items.where("type = 'comment' AND text IS NOT NULL").select("id", "text")
