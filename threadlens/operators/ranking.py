"""Exact positions in a total order, without sorting in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.session import materialize

# Up to this many rows a plain sort with limit is cheaper than a distributed one.
SMALL_LIMIT = 10_000

# Layout of monotonically_increasing_id.
PLACE_BITS = 33


def with_position(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Number all rows 0, 1, 2, ... by ``order``, which must be total.

    One range-partitioned sort. Each row is stored with its partition and its place in it; the
    position is that place plus the sizes of the partitions before it.
    """
    place = F.monotonically_increasing_id()  # partition number above PLACE_BITS, place below
    stored = materialize(df.orderBy(*order).withColumn("_place", place), "sorted")
    part = F.shiftright("_place", PLACE_BITS).cast("int")
    # One row a partition reaches the driver and goes back to the tasks.
    sizes = sorted((r["_part"], r["count"]) for r in stored.groupBy(part.alias("_part")).count().collect())
    starts, total = [], 0
    for number, size in sizes:
        starts.append((number, total))
        total += size
    offsets = df.sparkSession.createDataFrame(starts, "_part int, _start long")
    return (
        stored.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_start") + F.col("_place").bitwiseAND((1 << PLACE_BITS) - 1))
        .drop("_part", "_place", "_start")
    )


def first_rows(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """Exactly the first ``n`` rows by ``order``."""
    if n <= SMALL_LIMIT:
        return df.orderBy(*order).limit(n)
    return with_position(df, order, "_position").where(F.col("_position") < n).drop("_position")
