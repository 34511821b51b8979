"""Filter interaction audit: what each of five filters removes in each order of applying them.

A document fails
    A  with under 50 words,
    B  if under 65 of 100 words are distinct,
    C  if over 5 of 100 characters are capitals A to Z,
    D  if it holds one of # $ % & * |,
    E  if its text is the text of a smaller doc_id anywhere in the table, removed or not.

A and B are decided by row sums and numbers of nonzeros of the sparse document-term matrix (``document_terms``). A to D
depend on the text alone, so they are decided once a distinct text and meet all its copies after those have been
counted: by text, part and label, a row each, with the least doc_id and how often it occurs. So a text that a third of
all rows share is a few rows before anything meets it by its text, and no group is ever gathered.

All 120 orders follow from the number of documents of each part, failing set and label: at most 128 rows a part.

Defined results: a null text is empty, a null source is the part ''; a null doc_id has no label, is smaller than no id
and has no smaller one; repeated rows count each, as do rows that share a doc_id; repeated labels count if one of them says so;
an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlens.llm.common import prepared
from threadlens.llm.document_terms import digest, document_terms, row_statistics

FILTERS = "ABCDE"
LEAST_WORDS = 50
LEAST_DISTINCT_PERCENT = 65
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def _said(labels: DataFrame) -> DataFrame:
    """One row a doc_id: whether a label calls it good, and toxic."""
    yes = [F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic_"))]
    return labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*yes)


def failing_sets(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, mask, good, toxic, n)``: documents of each part by the set of filters they fail and by label."""
    _, shards = document_terms(docs)
    words = row_statistics(shards)
    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["source"].cast("string"), F.lit("")).alias("part"), digest(docs).alias("digest")
    )
    rows = rows.groupBy("digest", "part", "doc_id").agg(F.count("*").alias("n"))
    rows = rows.join(_said(labels), "doc_id", "left").select(
        "digest", "part", "doc_id", "n", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic_", F.lit(False)).alias("toxic")
    )
    has_id = F.col("doc_id").isNotNull()
    groups = rows.groupBy("digest", "part", "good", "toxic").agg(
        F.sum("n").alias("n"), F.sum(F.when(~has_id, F.col("n")).otherwise(0)).alias("without_id"),
        F.min(F.when(has_id, F.struct("doc_id", "n"))).alias("low"),
    )
    least = groups.groupBy("digest").agg(F.min("low.doc_id").alias("least"))
    first = F.col("without_id") + F.when(F.col("low.doc_id") == F.col("least"), F.col("low.n")).otherwise(0)
    fails = {
        "A": F.col("words") < LEAST_WORDS, "B": 100 * F.col("distinct") < LEAST_DISTINCT_PERCENT * F.col("words"),
        "C": F.col("capitals"), "D": F.col("marks"),
    }
    mask = sum((F.when(fails[c], F.lit(bit(c))).otherwise(0) for c in fails), F.lit(0))
    both = F.explode(F.array(
        F.struct(mask.alias("mask"), first.alias("n")), F.struct((mask + bit("E")).alias("mask"), (F.col("n") - first).alias("n"))
    ))
    sets = groups.join(least, "digest").join(words, "digest").select("part", "good", "toxic", both.alias("set"))
    return sets.groupBy("part", "set.mask", "good", "toxic").agg(F.sum("set.n").alias("n")).where("n > 0")


def _earlier(order: Column, step: Column) -> Column:
    before = F.substring(order, F.lit(1), step - 1)
    return sum((F.when(F.contains(before, F.lit(c)), F.lit(bit(c))).otherwise(0) for c in FILTERS), F.lit(0))


def interactions(sets: DataFrame) -> DataFrame:
    """Counts of every step of every order, from the documents of each failing set."""
    orders = ["".join(p) for p in permutations(FILTERS)]
    steps = sets.withColumn("filter_order", F.explode(F.array(*map(F.lit, orders))))
    steps = steps.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    own = sum((F.when(letter == c, F.lit(bit(c))).otherwise(0) for c in FILTERS), F.lit(0))
    steps = steps.select("part", "filter_order", "step", "mask", "good", "toxic", "n", letter.alias("letter"), own.alias("own"), _earlier(F.col("filter_order"), F.col("step")).alias("earlier"))
    failed = F.col("mask").bitwiseAND(F.col("own")) != 0
    gone = F.col("mask").bitwiseAND(F.col("earlier")) != 0
    what = {
        "kept": ~failed & ~gone, "removed": failed & ~gone, "redundant": failed & gone, "unique_fails": F.col("mask") == F.col("own"),
        "good_lost": failed & ~gone & F.col("good"), "toxic_lost": failed & ~gone & F.col("toxic"),
    }
    counted = steps.groupBy("part", "filter_order", "step", "letter").agg(*[F.sum(F.when(what[c], F.col("n")).otherwise(0)).alias(c) for c in COUNTS])
    everywhere = Window.partitionBy("part", "letter")  # 120 rows: one of each order
    return counted.select("part", "filter_order", F.col("step").cast("int").alias("step"), *COUNTS, F.sum("removed").over(everywhere).alias("shapley"))


def filter_interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)``."""
    prepared(docs.sparkSession)
    return interactions(failing_sets(docs, labels))
