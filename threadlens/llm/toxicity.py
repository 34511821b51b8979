"""Toxicity by nearest labelled examples: exact TF-IDF cosine, block-max inverted index, weighted votes.

Terms are lower-cased words and their beginnings of STEMS letters, as inflected words share those. Of
all such strings of the examples those are terms whose presence goes with the label (in at least LEAST_ROWS examples, and
chi-square over LEAST_CHI, which chance reaches once in 20 million strings): without that choice
the cosine of two long texts is all chance matches of common words. The bar is the same for every number of examples,
and there is no limit to the number of terms. Their document frequencies are counted
over all documents.

Index. Examples are put in an order that keeps alike ones together, and cut into blocks. For each term
there are its postings and, for each block, its largest weight. A text's upper bound for a block is the
product of its weights with those maxima; blocks are visited in falling order of the bound until no
block left can beat the K-th best cosine found; after ONE_BY_ONE of them, those left that still can are
visited together. The result is exact, ties go to the earlier example.

Vote. Every neighbour votes with its cosine; the share for toxic is calibrated by a monotone map fitted
on the examples themselves, each left out of its own neighbours, with the classes weighted to their share
among all labelled rows. A text without any term gets the rate of such examples. The neighbours are the
evidence.

The index holds at most ``per_class`` labelled rows of each class (a documented bound) and their
terms, which bounds what is broadcast. Scoring is one pass without a shuffle.

Defined results: null is the empty text; without any labelled row every score is 0; repeated rows are
scored alike; a null id is held out (its fold is 0); an empty table gives no rows. Only the text is read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.llm.common import fold, labelled_sample, prepared, ship, shipped, texts, texts_of

PER_CLASS = 4_000  # labelled rows of each class in the index
STEMS = (4, 5, 6)
LEAST_CHI = 30.0
LEAST_ROWS = 5
NEIGHBOURS = 15
BLOCK = 64  # examples
ONE_BY_ONE = 4  # blocks
THRESHOLD = 0.5
FOLDS, HELD_OUT = 5, 0
KEPT_ANSWERS = 50_000  # answers a task remembers, by the text's counts of terms

words = re.compile(r"\w+").findall


def strings(text: str) -> dict[str, int]:
    """Words and beginnings of words, with their counts; a beginning ends in a hyphen."""
    out: dict[str, int] = {}
    for word, count in Counter(words(text.lower())).items():
        out[word] = count
        for k in STEMS:
            if len(word) > k:
                stem = word[:k] + "-"
                out[stem] = out.get(stem, 0) + count
    return out


def choose_terms(rows: list[tuple[int, set[str]]]) -> list[str]:
    """The strings whose presence goes with the label, strongest first."""
    n, ones = len(rows), sum(y for y, _ in rows)
    seen, toxic = Counter(), Counter()
    for y, own in rows:
        seen.update(own)
        if y:
            toxic.update(own)
    found = []
    for word, df in seen.items():
        if df < LEAST_ROWS:
            continue
        a, b = toxic[word], df - toxic[word]
        c, d = ones - a, n - ones - b
        below = (a + b) * (c + d) * (a + c) * (b + d)
        chi = n * (a * d - b * c) ** 2 / below if below else 0.0
        if chi >= LEAST_CHI:
            found.append((-chi, word))
    return [word for _, word in sorted(found)]


class Index:
    """Block-max inverted index over unit vectors of the examples."""

    def __init__(self, terms: list[str], idf: np.ndarray, ids: list[int], labels: list[int], counts: list[dict[str, int]]):
        self.number = {t: i for i, t in enumerate(terms)}
        self.idf = idf
        vectors = [self.vector(c) for c in counts]
        alike = sorted(range(len(ids)), key=lambda e: ([t for t, _ in sorted(vectors[e], key=lambda x: -x[1])], ids[e]))
        self.ids = np.array([ids[e] for e in alike], dtype=np.int64)
        self.labels = np.array([labels[e] for e in alike], dtype=np.int64)
        self.vectors = [vectors[e] for e in alike]
        self.blocks = max(1, -(-len(alike) // BLOCK))
        postings: list[list[tuple[int, float]]] = [[] for _ in terms]
        for place, vector in enumerate(self.vectors):
            for t, weight in vector:
                postings[t].append((place, weight))
        self.places = [np.array([p for p, _ in own], dtype=np.int64) for own in postings]
        self.weights = [np.array([w for _, w in own]) for own in postings]
        # For each term the blocks it occurs in, where their postings begin, and the largest weight of each.
        self.own, self.most, self.begins = [], [], []
        for places, weights in zip(self.places, self.weights):
            own, begins = np.unique(places // BLOCK, return_index=True)
            self.own.append(own)
            self.begins.append(np.append(begins, len(places)))
            self.most.append(np.maximum.reduceat(weights, begins) if len(own) else np.empty(0))

    def vector(self, counts: dict[str, int]) -> list[tuple[int, float]]:
        """Unit vector of TF-IDF weights, as (term, weight) in order of terms."""
        found = sorted((self.number[w], (1 + log(c))) for w, c in counts.items() if w in self.number)
        weights = [tf * float(self.idf[t]) for t, tf in found]
        length = sum(w * w for w in weights) ** 0.5
        return [(t, w / length) for (t, _), w in zip(found, weights)] if length else []

    def nearest(self, vector: list[tuple[int, float]], k: int = NEIGHBOURS, but: int = -1) -> list[tuple[float, int]]:
        """The ``k`` largest positive cosines as (cosine, place); ``but`` is left out."""
        if not vector:
            return []
        bound = np.zeros(self.blocks)
        for t, w in vector:
            bound[self.own[t]] += w * self.most[t]
        order = np.argsort(-bound, kind="stable")
        best: list[tuple[float, int]] = []

        def better(left: np.ndarray) -> np.ndarray:
            """The blocks that can still hold one of the best."""
            return left[(bound[left] > 0) & (bound[left] >= -best[-1][0] - 1e-12 if len(best) == k else True)]

        def add(cosines: np.ndarray, first: int) -> None:
            nonlocal best
            if 0 <= but - first < len(cosines):
                cosines[but - first] = 0
            cosines = np.round(cosines, 12)
            hits = np.flatnonzero(cosines > 0)
            if len(hits) > k:
                hits = hits[cosines[hits] >= np.partition(cosines[hits], -k)[-k]]
                hits = hits[np.argsort(-cosines[hits], kind="stable")[:k]]
            best = sorted(best + [(-float(cosines[h]), first + int(h)) for h in hits])[:k]

        for block in order[:ONE_BY_ONE]:
            if not len(better(np.array([block]))):
                return [(-c, place) for c, place in best]
            cosines = np.zeros(BLOCK)
            for t, w in vector:
                at = int(np.searchsorted(self.own[t], block))
                if at < len(self.own[t]) and self.own[t][at] == block:
                    low, high = self.begins[t][at], self.begins[t][at + 1]
                    cosines[self.places[t][low:high] - block * BLOCK] += w * self.weights[t][low:high]
            add(cosines, int(block) * BLOCK)
        left = better(order[ONE_BY_ONE:])
        if len(left):
            cosines = np.zeros(self.blocks * BLOCK)
            for t, w in vector:
                cosines[self.places[t]] += w * self.weights[t]
            kept = np.zeros(self.blocks, dtype=bool)
            kept[left] = True
            add(np.where(np.repeat(kept, BLOCK), cosines, 0.0), 0)
        return [(-c, place) for c, place in best]

    def vote(self, near: list[tuple[float, int]]) -> float:
        total = sum(c for c, _ in near)
        return sum(c for c, p in near if self.labels[p]) / total if total else -1.0

    def calibrate(self, class_weights: dict[int, float]) -> None:
        """Monotone map from votes to the rate of toxic rows, and the rate of rows without a neighbour."""
        votes, ones, sums = [], [], []
        alone = [1e-9, 0.0]
        for place, vector in enumerate(self.vectors):
            weight, y = class_weights[int(self.labels[place])], int(self.labels[place])
            vote = self.vote(self.nearest(vector, but=place))
            if vote < 0:
                alone[0] += weight
                alone[1] += weight * y
            else:
                votes.append(vote), ones.append(weight * y), sums.append(weight)
        self.alone = alone[1] / alone[0]
        # Pool adjacent violators over the votes in order.
        pools: list[list[float]] = []
        for i in np.argsort(votes, kind="stable").tolist():
            if pools and pools[-1][0] == votes[i]:
                pools[-1][1] += ones[i]
                pools[-1][2] += sums[i]
            else:
                pools.append([votes[i], ones[i], sums[i]])
            while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
                last = pools.pop()
                pools[-1][1] += last[1]
                pools[-1][2] += last[2]
        self.steps = np.array([p[0] for p in pools] or [0.0])
        self.rates = np.array([p[1] / p[2] for p in pools] or [self.alone])

    def answer(self, counts: dict[str, int]) -> tuple[float, list[tuple[float, int]]]:
        near = self.nearest(self.vector(counts))
        vote = self.vote(near)
        if vote < 0:
            return self.alone, near
        return float(np.interp(vote, self.steps, self.rates)), near


def _term_counts(text: str, terms: dict[str, int]) -> dict[str, int]:
    return {s: c for s, c in strings(text).items() if s in terms}


def document_frequencies(docs: DataFrame, terms: list[str]) -> tuple[int, np.ndarray]:
    """Number of documents, and of those with each term, over all of them: a row a term from each task."""
    spark = docs.sparkSession
    number = spark.sparkContext.broadcast({t: i for i, t in enumerate(terms)})

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = number.value, np.zeros(len(number.value) + 1, dtype=np.int64)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen[-1] += 1
                for term in known.keys() & strings(text).keys():
                    seen[known[term]] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(seen))), pa.array(seen)], names=["term", "n"])

    rows = docs.select(texts(docs).alias("text")).mapInArrow(task, "term long, n long")
    counts = dict(rows.groupBy("term").agg(F.sum("n")).collect())
    return counts.get(len(terms), 0), np.array([counts.get(i, 0) for i in range(len(terms))])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Index | None:
    """Index and calibration from labelled rows outside the held-out fold; None if there are none."""
    sample, counts = labelled_sample(labels, "toxic", fold(F.col("doc_id"), FOLDS) != HELD_OUT, per_class)
    if not sum(counts.values()):
        return None
    examples = texts_of(docs, sample)

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(strings(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(found, pa.list_(pa.string()))], names=["label", "strings"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(y, set(own)) for b in batches for y, own in zip(b.column("label").to_pylist(), b.column("strings").to_pylist())]
        yield pa.RecordBatch.from_arrays([pa.array([choose_terms(rows)], pa.list_(pa.string()))], names=["terms"])

    # The bounded sample meets in one task; its terms, then its counts of those terms, reach the driver.
    chosen = examples.mapInArrow(distinct, "label int, strings array<string>").repartition(1).mapInArrow(choose, "terms array<string>").collect()
    terms = chosen[0][0] if chosen else []
    n, seen = document_frequencies(docs, terms)
    idf = np.log((1 + n) / (1 + seen)) + 1 if terms else np.empty(0)
    number = {t: i for i, t in enumerate(terms)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [list(_term_counts(t, number).items()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(found, pa.map_(pa.string(), pa.int64()))], names=["doc_id", "label", "counts"])

    rows = sorted(examples.mapInArrow(count, "doc_id long, label int, counts map<string,long>").collect())
    if not rows:
        return None
    index = Index(terms, idf, [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows])
    taken = Counter(r[1] for r in rows)
    index.calibrate({c: counts[c] / max(taken[c], 1) for c in (0, 1)})
    return index


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """``(doc_id, held_out, score, predicted, evidence)``; evidence is the nearest examples, best first."""
    spark = prepared(docs.sparkSession)
    index = ship(spark, fit(docs, labels, per_class))
    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), (fold(docs["doc_id"], FOLDS) == HELD_OUT).alias("held_out"), texts(docs).alias("text")
    )
    near = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, answers = shipped(index), {}
        for batch in batches:
            scores, evidence = [], []
            for text in batch.column("text").to_pylist():
                counts = _term_counts(text, own.number) if own else {}
                key = tuple(sorted(counts.items()))
                if key not in answers:
                    if len(answers) >= KEPT_ANSWERS:
                        answers.clear()
                    score, found = own.answer(counts) if own else (0.0, [])
                    answers[key] = score, [{"doc_id": int(own.ids[p]), "cosine": c, "toxic": int(own.labels[p])} for c, p in found]
                score, found = answers[key]
                scores.append(score), evidence.append(found)
            predicted = pa.array([int(s >= THRESHOLD) for s in scores], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), predicted, pa.array(evidence, near)],
                names=["doc_id", "held_out", "score", "predicted", "evidence"],
            )

    schema = "doc_id long, held_out boolean, score double, predicted int, evidence array<struct<doc_id:long,cosine:double,toxic:int>>"
    return rows.mapInArrow(task, schema)
