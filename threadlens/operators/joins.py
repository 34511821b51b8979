"""Joins of vectors with attributes, always by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.functions.vector import concat_vectors, seeded_vector
from threadlens.session import materialize


def join_vectors(items: DataFrame, vectors: DataFrame, key: str = "id") -> DataFrame:
    """Inner join; a key on one side only is left out."""
    return items.join(vectors.select(key, "vec"), key)


def concat_by_id(first: DataFrame, second: DataFrame, key: str = "id") -> DataFrame:
    """Two vector tables side by side as one wider vector; the first table's other columns stay."""
    other = second.select(key, F.col("vec").alias("_other"))
    return first.join(other, key).withColumn("vec", concat_vectors(F.col("vec"), F.col("_other"))).drop("_other")


def join_by_tag(items: DataFrame, tagged: DataFrame) -> DataFrame:
    """Join on the tag of a paragraph vector."""
    return items.join(tagged.select("tag", "vec"), "tag")


def missing_tags(items: DataFrame, tagged: DataFrame) -> DataFrame:
    """Items whose tag has no vector, for a strict check."""
    return items.join(tagged.select("tag"), "tag", "left_anti")


def overlay_pretrained(vocabulary: DataFrame, pretrained: DataFrame, dim: int, seed: int = 0) -> DataFrame:
    """Pretrained vectors on the own vocabulary; other words start from a small seeded vector."""
    known = pretrained.select("word", F.col("vec").alias("_known"))
    vec = F.coalesce("_known", seeded_vector(F.col("word"), dim, seed))
    return (
        vocabulary.join(known, "word", "left")
        .withColumn("vec", vec)
        .withColumn("pretrained", F.col("_known").isNotNull())
        .drop("_known")
    )


def attach_titles(results: DataFrame, titles: DataFrame) -> DataFrame:
    """Titles for the ids of a result; an unknown id keeps its row.

    The title table is first cut down to the ids found, so that a small result shuffles nothing of it.
    """
    results = materialize(results, "results")
    wanted = results.select("id").distinct()
    known = titles.select("id", "title").join(wanted, "id", "left_semi")
    return results.join(known, "id", "left")
