"""Samples and splits that depend on the key alone: reruns and other partitionings agree."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.operators.ranking import first_rows

HASH_RANGE = 2**32


def key_digest(keys: list[str], use: str, seed: int) -> Column:
    """``use`` keeps a split independent of a sample that was drawn before it."""
    return F.md5(F.concat_ws(":", *[F.col(k).cast("string") for k in keys], F.lit(use), F.lit(str(seed))))


def key_fraction(keys: list[str], use: str, seed: int) -> Column:
    """A uniform number in [0, 1) from the key."""
    return F.conv(F.substring(key_digest(keys, use, seed), 1, 8), 16, 10).cast("bigint") / F.lit(float(HASH_RANGE))


def hash_split(df: DataFrame, keys: list[str], fraction: float = 0.7, seed: int = 1) -> DataFrame:
    """Add ``is_train``: a stable split, no shuffle."""
    return df.withColumn("is_train", key_fraction(keys, "split", seed) < fraction)


def train_test(df: DataFrame, keys: list[str], fraction: float = 0.7, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    flagged = hash_split(df, keys, fraction, seed)
    return flagged.where("is_train").drop("is_train"), flagged.where("NOT is_train").drop("is_train")


def class_sample(
    df: DataFrame, keys: list[str], label: str = "label", target: int | None = None, seed: int = 1
) -> DataFrame:
    """Keep each of the classes 0 and 1 with probability target / class size, at most 1.

    Without a target the smaller class sets it. The class sizes are one aggregation of two rows.
    """
    df = df.where(F.col(label).isin(0.0, 1.0))
    sizes = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    if not sizes:
        return df
    wanted = min(sizes.values()) if target is None else target
    keep = F.lit(False)
    for value, size in sorted(sizes.items()):
        keep = keep | ((F.col(label) == value) & (key_fraction(keys, "class", seed) < min(1.0, wanted / size)))
    return df.where(keep)


def fixed_sample(df: DataFrame, keys: list[str], n: int, seed: int = 1) -> DataFrame:
    """Exactly ``n`` rows (or all): the ones whose unique key has the smallest digest.

    A digest threshold a little above n / count leaves few rows to sort; should it leave fewer than
    ``n``, everything is sorted.
    """
    order = [key_digest(keys, "fixed", seed), *[F.col(k) for k in keys]]
    total = df.count()
    if n >= total:
        return df
    likely = (n + 6 * sqrt(n) + 36) / total
    if likely < 0.5:
        near = df.where(key_fraction(keys, "fixed", seed) < likely)
        if near.count() >= n:
            df = near
    return first_rows(df, order, n)
