"""Quality classifier: a factorisation machine on hashed words, structure statistics and length.

Features of a text: its words, hashed to ``WORDS`` places with weights log(1 + count) scaled to length
one; and its statistics, each cut at quantiles of the training sample into BINS ranges, one feature a
range. The score of features x is

    w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)

so all pairs of features interact through vectors of FACTORS numbers in time linear in the features.

Training takes at most ``per_class`` labelled rows of each class (a documented bound), weighted so that
the classes keep their share among all labelled rows. The sample's features, not its texts, meet in one
task, and the model is one row of fixed size. Scoring is one pass over the documents, without a shuffle.

Defined results: null is the empty text and is scored like any other; without any labelled row every
score is one half; repeated rows are scored alike; a null id is not held out; an empty table gives no
rows. Only the text is read: label, language, source and id never enter a score.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from math import log, log1p, sqrt
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.llm.common import fold, labelled_sample, prepared, ship, shipped, texts, texts_of

WORDS = 1 << 14  # places of hashed words
FACTORS = 8
BINS = 8
PER_CLASS = 4_000  # labelled rows of each class to learn from
EPOCHS = 6
BATCH = 64
RATE = 0.1
DECAY = 1e-4
THRESHOLD = 0.7
FOLDS, HELD_OUT = 4, 2

UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGIT = b"0123456789"
STOPS = b".,;:'\""
SPACE = b" \t\n\r\x0b\x0c"


def statistics(text: str) -> tuple[list[float], Counter]:
    """Structure statistics of a text and the counts of its words."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    counts = Counter(words)
    size, n = max(len(raw), 1), max(len(words), 1)

    def share(chars: bytes) -> float:
        return (len(raw) - len(raw.translate(None, chars))) / size

    upper, lower, digit, stop, space = map(share, (UPPER, LOWER, DIGIT, STOPS, SPACE))
    other = sum(map(share, (b"!?", b"|", b"#$%&*+<=>@\\^_~", b"()[]{}/-")))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeated = sum(c for c in counts.values() if c > 1)
    most = max(counts.values(), default=0)
    same = sum(a == b for a, b in zip(words, words[1:]))
    capital = sum(1 for w in counts if w[:1].isupper())
    return [
        log1p(len(text)), log1p(len(words)), log1p(len(lines)), len(words) / max(len(lines), 1),
        sum(map(len, words)) / n, max(map(len, counts), default=0),
        upper, lower, digit, stop, space, other, share(b"!?"), share(b"|"), share(b"#$%&*+<=>@\\^_~"), share(b"()[]{}/-"),
        upper / max(upper + lower, 1e-9), len(counts) / n, repeated / n, most / n, same / n, capital / max(len(counts), 1),
        1 - len(set(lines)) / max(len(lines), 1),
        sum(1 for x in lines if x.rstrip()[-1:] in b".!?\"") / max(len(lines), 1),
    ], counts


def hashed_words(counts: Counter) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights; words that share a place add up, the weights' squares add up to one."""
    places: Counter = Counter()
    for word, count in counts.items():
        places[zlib.crc32(word.lower()) % WORDS] += log(1 + count)
    index = np.fromiter(places.keys(), dtype=np.int64, count=len(places))
    value = np.fromiter(places.values(), dtype=np.float64, count=len(places))
    return index, value / max(sqrt(float((value * value).sum())), 1e-9)


class Model(NamedTuple):
    cuts: np.ndarray  # statistics x (BINS - 1)
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def features(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        stats, counts = statistics(text)
        index, value = hashed_words(counts)
        bins = (np.array(stats)[:, None] > self.cuts).sum(axis=1)
        own = WORDS + np.arange(len(stats)) * BINS + bins
        return np.concatenate([index, own]), np.concatenate([value, np.full(len(own), 1 / sqrt(len(own)))])

    def score(self, text: str) -> float:
        index, x = self.features(text)
        v = self.factors[index] * x[:, None]
        sums = v.sum(axis=0)
        z = self.bias + self.linear[index] @ x + 0.5 * float((sums * sums).sum() - (v * v).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def train(stats: np.ndarray, words: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, weights: np.ndarray, seed: int = 7) -> Model:
    """AdaGrad on weighted logistic loss, mini-batches in a seeded order."""
    inner = np.linspace(0, 1, BINS + 1)[1:-1]
    cuts = np.quantile(stats, inner, axis=0).T
    size = WORDS + stats.shape[1] * BINS
    rng = np.random.default_rng(seed)
    share = np.clip((weights * labels).sum() / weights.sum(), 0.01, 0.99)
    bias, linear, factors = log(share / (1 - share)), np.zeros(size), rng.normal(0, 0.05, (size, FACTORS))
    slack_b, slack_w, slack_v = 1e-8, np.full(size, 1e-8), np.full((size, FACTORS), 1e-8)
    model = Model(cuts, bias, linear, factors)
    own = WORDS + np.arange(stats.shape[1]) * BINS + (stats[:, :, None] > cuts[None]).sum(axis=2)
    rows = [(np.concatenate([i, o]), np.concatenate([x, np.full(len(o), 1 / sqrt(len(o)))])) for (i, x), o in zip(words, own)]
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for low in range(0, len(order), BATCH):
            some = order[low : low + BATCH]
            index = np.concatenate([rows[r][0] for r in some])
            x = np.concatenate([rows[r][1] for r in some])
            sizes = np.array([len(rows[r][0]) for r in some])
            starts = np.cumsum(sizes) - sizes
            row = np.repeat(np.arange(len(some)), sizes)
            v = factors[index]
            vx = v * x[:, None]
            sums = np.add.reduceat(vx, starts)
            z = bias + np.add.reduceat(linear[index] * x, starts) + 0.5 * ((sums * sums).sum(axis=1) - np.add.reduceat((vx * vx).sum(axis=1), starts))
            error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels[some]) * weights[some]
            slope = error[row] * x
            places, back = np.unique(index, return_inverse=True)
            grad_w = np.bincount(back, slope, len(places)) / len(some) + DECAY * linear[places]
            grad_v = slope[:, None] * (sums[row] - vx)
            grad_v = np.stack([np.bincount(back, grad_v[:, f], len(places)) for f in range(FACTORS)], axis=1) / len(some) + DECAY * factors[places]
            slack_w[places] += grad_w**2
            slack_v[places] += grad_v**2
            slack_b += error.mean() ** 2
            linear[places] -= RATE * grad_w / np.sqrt(slack_w[places])
            factors[places] -= RATE * grad_v / np.sqrt(slack_v[places])
            bias -= RATE * error.mean() / sqrt(slack_b)
    return model._replace(bias=bias)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model | None:
    """Learn from labelled rows outside the held-out fold; None if there are none."""
    sample, counts = labelled_sample(labels, "quality", fold(F.col("doc_id"), FOLDS) != HELD_OUT, per_class)
    if not sum(counts.values()):
        return None

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats, index, value = [], [], []
            for text in batch.column("text").to_pylist():
                own, words = statistics(text)
                i, x = hashed_words(words)
                stats.append(own), index.append(i.astype(np.int32)), value.append(x.astype(np.float32))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("label"), pa.array(stats, pa.list_(pa.float64())),
                pa.array(index, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32())),
            ], names=["doc_id", "label", "stats", "index", "value"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "label", "stats")), batch.column("index"), batch.column("value"))]
        if not rows:
            return
        rows.sort(key=lambda r: r[0])
        y = np.array([r[1] for r in rows], dtype=np.float64)
        seen = {c: max(int((y == c).sum()), 1) for c in (0, 1)}
        weights = np.where(y == 1, counts[1] / seen[1], counts[0] / seen[0])
        words = [(r[3].values.to_numpy().astype(np.int64), r[4].values.to_numpy().astype(np.float64)) for r in rows]
        model = train(np.array([r[2] for r in rows]), words, y, weights / weights.mean())
        parts = [model.cuts, np.array([model.bias]), model.linear, model.factors]
        yield pa.RecordBatch.from_arrays([pa.array([p.astype("<f8").tobytes()]) for p in parts], names=["cuts", "bias", "linear", "factors"])

    features = texts_of(docs, sample).mapInArrow(featurise, "doc_id long, label int, stats array<double>, index array<int>, value array<float>")
    found = features.repartition(1).mapInArrow(learn, "cuts binary, bias binary, linear binary, factors binary").collect()
    if not found:
        return None
    cuts, bias, linear, factors = (np.frombuffer(x, "<f8") for x in found[0])
    return Model(cuts.reshape(-1, BINS - 1), float(bias[0]), linear, factors.reshape(-1, FACTORS))


def score_column(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Column:
    """The score of each text as a column of ``docs``; fits the model."""
    prepared(docs.sparkSession)
    return _scores(docs, fit(docs, labels, per_class))


def _scores(docs: DataFrame, fitted: Model | None) -> Column:
    model = ship(docs.sparkSession, fitted)

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shipped(model)
        for batch in batches:
            yield batch.map(lambda text: own.score(text) if own else 0.5)

    return scores(texts(docs))


def quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, a row a document."""
    scored = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), (fold(docs["doc_id"], FOLDS) == HELD_OUT).alias("held_out"),
        score_column(docs, labels, per_class).alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """``docs`` without the rows that the classifier rejects; all columns stay. Without a model it rejects none."""
    prepared(docs.sparkSession)
    model = fit(docs, labels, per_class)
    return docs if model is None else docs.where(_scores(docs, model) >= THRESHOLD)
