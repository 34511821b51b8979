"""Sentences, vocabulary and document frequencies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.functions.text import html_to_text, paragraphs, short_words, tokenize
from threadlens.operators.frequent import candidates
from threadlens.operators.items import comments, submission_corpus
from threadlens.operators.ranking import with_position

# Words of a block that learns on its own copy of vectors, and blocks beyond which blocks grow with the corpus.
LEAST_BLOCK_WORDS = 20_000
MOST_BLOCK_WORDS = 500_000
MANY_BLOCKS = 32
LEAST_WAVE = 32  # blocks that learn at once, more where there are more cores


def title_sentences(items: DataFrame, lower: bool = True) -> DataFrame:
    """``(id, pos, words)``, one sentence a story."""
    return submission_corpus(items).select(
        "id", F.lit(0).alias("pos"), tokenize(F.col("title"), lower).alias("words")
    )


def comment_sentences(items: DataFrame, lower: bool = True) -> DataFrame:
    """``(id, pos, words)``, one sentence a paragraph; empty ones are dropped."""
    rows = F.transform(
        paragraphs(html_to_text(F.col("text"))),
        lambda line, pos: F.struct(pos.alias("pos"), short_words(tokenize(line, lower)).alias("words")),
    )
    found = comments(items).transform(each(rows, "row", "id"))
    return found.select("id", "row.pos", "row.words").where(F.size("words") > 0)


def sentences(items: DataFrame, lower: bool = True) -> DataFrame:
    """Titles and comment paragraphs together; repeated sentences are kept."""
    return title_sentences(items, lower).unionByName(comment_sentences(items, lower))


def each(values: Column, name: str, *keep: str | Column) -> Callable[[DataFrame], DataFrame]:
    """One row an array element, for ``transform``.

    The outer form spares the filter on the array's size that Spark would infer, which would
    compute the whole array a second time.
    """
    return lambda df: df.select(*keep, F.explode_outer(values).alias(name)).where(F.col(name).isNotNull())


def word_counts(df: DataFrame, words: str = "words") -> DataFrame:
    """``(word, n)``; partial aggregation reduces frequent words before the shuffle."""
    return df.transform(each(F.col(words), "word")).groupBy("word").agg(F.count("*").alias("n"))


def counts_of(df: DataFrame, known: DataFrame, words: str = "words") -> DataFrame:
    """``(word, n)`` of some words, few enough to broadcast."""
    rows = df.transform(each(F.col(words), "word"))
    return rows.join(F.broadcast(known), "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))


def vocabulary(
    df: DataFrame, words: str = "words", size: int | None = None, min_count: int = 1
) -> DataFrame:
    """``(word_id, word, n)``, most frequent first, ties in word order; all words, or exactly the first ``size``.

    With ``size`` only words that can be among them are shuffled, if summaries of bounded size can tell which; the words
    are then read twice.
    """
    known = None if size is None else candidates(df, words, size)
    counts = (word_counts(df, words) if known is None else counts_of(df, known, words)).where(F.col("n") >= min_count)
    ranked = with_position(counts, [F.desc("n"), F.col("word")], "word_id").select("word_id", "word", "n")
    return ranked if size is None else ranked.where(F.col("word_id") < size)


def block_count(df: DataFrame, words: str = "words", most: int = MOST_BLOCK_WORDS) -> int:
    """Into how many blocks texts are dealt that learn on a copy of their words' vectors; it follows from the number of
    words alone.

    A large block repeats less: each holds its distinct words once, and those grow slower than the block. So blocks grow
    with the corpus, up to ``most`` words, which bounds what a task holds.
    """
    total = df.agg(F.sum(F.greatest(F.size(words), F.lit(0)))).first()[0] or 0
    size = min(most, max(LEAST_BLOCK_WORDS, -(-total // MANY_BLOCKS)))
    return max(1, -(-total // size))


def wave_count(spark: SparkSession, blocks: int, at_once: int | None = None) -> int:
    """Into how many waves blocks are dealt that learn one wave after the other, all from the same vectors.

    What is on its way between blocks and vectors is that of one wave then, so it grows with the cluster and not with
    the corpus. Moves are summed over all waves, so results don't depend on the number but for the rounding of sums.
    """
    at_once = at_once or max(LEAST_WAVE, 4 * spark.sparkContext.defaultParallelism)
    return -(-blocks // at_once)


def document_frequencies(df: DataFrame, words: str = "words") -> DataFrame:
    return (
        df.transform(each(F.array_distinct(words), "word"))
        .groupBy("word")
        .agg(F.count("*").alias("df"))
    )


def idf_table(df: DataFrame, words: str = "words") -> DataFrame:
    """``(word, df, idf)`` with idf = log((N + 1) / (df + 1)); rows are documents."""
    total = df.count()
    return document_frequencies(df, words).withColumn("idf", F.log((F.lit(float(total)) + 1) / (F.col("df") + 1)))
