"""Arithmetic with word vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.functions.vector import mean_columns


def request_terms(requests: DataFrame, cased: bool = False) -> DataFrame:
    """``(request_id, word, sign)`` from requests with arrays ``positive`` and ``negative``; ``cased`` words stay as they are."""

    def signed(name: str, sign: int) -> Column:
        given = F.coalesce(name, F.array().cast("array<string>"))
        return F.transform(given, lambda w: F.struct((w if cased else F.lower(w)).alias("word"), F.lit(sign).alias("sign")))

    return requests.select("request_id", F.inline(F.concat(signed("positive", 1), signed("negative", -1))))


def term_weights(terms: DataFrame) -> DataFrame:
    """``(request_id, word, weight, uses, positive)``: repeated words of a request become one row, from which all else
    follows, so that the terms are read once."""
    return terms.groupBy("request_id", "word").agg(
        F.sum("sign").alias("weight"), F.count("*").alias("uses"), F.max(F.col("sign") > 0).alias("positive")
    )


def analogy_from_weights(weights: DataFrame, words: DataFrame, dim: int) -> DataFrame:
    """``(request_id, known, positive, vec)``: (sum of positive - sum of negative) / number of known words.

    Unknown words are ignored; a request without a known word gets NULL; ``positive`` says whether any word was asked for.
    """
    found = weights.join(words.select("word", "vec"), "word", "left")
    uses = F.when(F.col("vec").isNotNull(), F.col("uses"))
    totals = found.groupBy("request_id").agg(
        F.coalesce(F.sum(uses), F.lit(0)).alias("known"), F.max("positive").alias("positive"),
        *[c.alias(f"_v{i}") for i, c in enumerate(mean_columns(F.col("vec"), F.col("weight"), F.sum(uses), dim))],
    )
    vec = F.when(F.col("known") > 0, F.array(*[F.col(f"_v{i}") for i in range(dim)]))
    return totals.select("request_id", "known", "positive", vec.alias("vec"))


def analogy_vectors(terms: DataFrame, words: DataFrame, dim: int) -> DataFrame:
    """``(request_id, known, vec)`` of signed terms."""
    return analogy_from_weights(term_weights(terms), words, dim).drop("positive")


def add_word_vectors(documents: DataFrame, terms: DataFrame, words: DataFrame, dim: int) -> DataFrame:
    """Document vectors ``(request_id, vec)`` plus the positive and minus the negative word vectors."""
    totals = term_weights(terms).join(words.select("word", "vec"), "word").groupBy("request_id").agg(
        *[F.sum(F.col("weight") * F.col("vec")[i].cast("double")).alias(f"_v{i}") for i in range(dim)]
    )
    shifted = F.array(*[F.col("vec")[i] + F.coalesce(F.col(f"_v{i}"), F.lit(0.0)) for i in range(dim)])
    return documents.join(totals, "request_id", "left").withColumn("vec", shifted).drop(
        *[f"_v{i}" for i in range(dim)]
    )
