"""Lenient parsing of text fields: blank or malformed values become NULL, the row is kept."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Fixed patterns: padding is every character up to U+0020, a number is a signed run of digits.
NOT_BLANK = r"[^\x00-\x20]"
WHOLE_NUMBER = r"^[\x00-\x20]*[+-]?[0-9]+[\x00-\x20]*\z"
EPOCH_RANGE = (-62135596800, 253402300799)


def empty_as_null(c: Column) -> Column:
    """The value unchanged (not trimmed), or NULL when it holds nothing but padding."""
    return F.when(c.rlike(NOT_BLANK), c)


def opt_int(c: Column) -> Column:
    return F.when(c.rlike(WHOLE_NUMBER), c.try_cast("int"))


def opt_long(c: Column) -> Column:
    return F.when(c.rlike(WHOLE_NUMBER), c.try_cast("bigint"))


def opt_bool(c: Column) -> Column:
    """``true`` / ``false`` in any case, without padding; everything else is NULL."""
    low = F.lower(c)
    return F.when(low == "true", F.lit(True)).when(low == "false", F.lit(False))


def epoch_to_timestamp(seconds: Column) -> Column:
    """UTC timestamp; NULL outside the years 1 to 9999, where the type ends."""
    return F.when(seconds.between(*EPOCH_RANGE), F.timestamp_seconds(seconds))


def epoch_to_text(seconds: Column, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.from_unixtime(seconds, fmt)


def register_sql_functions(spark: SparkSession) -> None:
    """Make the four parsers callable from SQL; Catalyst inlines their bodies."""
    blank = NOT_BLANK.replace("\\", "\\\\")
    number = WHOLE_NUMBER.replace("\\", "\\\\")
    bodies = {
        "emptyAsNull": ("STRING", f"CASE WHEN s RLIKE '{blank}' THEN s END"),
        "optInt": ("INT", f"CASE WHEN s RLIKE '{number}' THEN try_cast(s AS INT) END"),
        "optLong": ("BIGINT", f"CASE WHEN s RLIKE '{number}' THEN try_cast(s AS BIGINT) END"),
        "optBool": ("BOOLEAN", "CASE lower(s) WHEN 'true' THEN true WHEN 'false' THEN false END"),
    }
    for name, (kind, body) in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(s STRING) RETURNS {kind} RETURN {body}")
