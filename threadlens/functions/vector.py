"""Expressions on ``array<float>`` vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Constants of the generator behind seeded vectors.
MODULUS, STEP, FACTOR, ADDEND = 1 << 32, 2_654_435_769, 1_664_525, 1_013_904_223


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def dot_distance(a: Column, b: Column, normalize: bool = False) -> Column:
    """1 - a.b, as is; ``normalize`` gives the true cosine distance."""
    product = dot(a, b)
    if normalize:
        product = product / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))
    return 1 - product


def similarity(distance: Column) -> Column:
    return 1 - distance


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def concat_vectors(a: Column, b: Column) -> Column:
    return F.concat(a, b)


def seeded_vector(key: Column, dim: int, seed: int = 0) -> Column:
    """A small vector (u - 0.5) / dim, its uniform values from a hash of the key.

    One digest a key; place i takes its first 32 bits through a multiply-and-add modulo 2^32, all in whole
    numbers that every engine computes alike, and keeps the upper 24 bits, as the lower ones repeat.
    """
    start = F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("bigint")
    places = F.sequence(F.lit(1).cast("bigint"), F.lit(dim).cast("bigint"))

    def value(mixed: Column) -> Column:
        mixed = (mixed.bitwiseXOR(F.shiftright(mixed, 15)) * FACTOR) % MODULUS
        return ((F.shiftright(mixed, 8).cast("double") / float(1 << 24) - 0.5) / dim).cast("float")

    # What is used more than once is an argument of a lambda function: a plain expression would be computed at every use,
    # the digest twice a place.
    def places_of(first: Column) -> Column:
        return F.transform(F.transform(places, lambda i: ((first + i * STEP) % MODULUS * FACTOR + ADDEND) % MODULUS), value)

    return F.element_at(F.transform(F.array(start), places_of), 1)


def mean_columns(vec: Column, weight: Column, count: Column, dim: int) -> list[Column]:
    """Aggregates for the weighted mean of vectors, one plain double per position.

    They run as partial and final hash aggregation without unfolding the vectors into rows.
    """
    return [F.sum(weight * vec[i].cast("double")) / F.nullif(count, F.lit(0)) for i in range(dim)]
