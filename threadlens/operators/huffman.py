"""Huffman codes of a vocabulary, from the histogram of its counts.

Words that occur equally often are alike to the tree, so it is built over weights, not words: all nodes of a weight are
paired at once, in order, and an odd one is joined with the first node of the next weight. A weight is left behind for
good, as what is made of it is heavier. So there is one step a distinct weight, and distinct counts number at most the root
of twice the corpus: that histogram alone reaches the driver, never a word.

Nodes of a weight are ordered: words by their number, then inner nodes as they were made. A word climbs from its place
among the words of its count to the root; the steps, which are few, travel to the tasks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Steps(NamedTuple):
    """One entry a weight, by weight."""

    weight: np.ndarray
    taken: np.ndarray  # 1 if the first node joins the odd one of the weight before
    pairs: np.ndarray
    node: np.ndarray  # number of the first inner node made: that join if there is one, then the pairs
    joined: np.ndarray  # (step, place) of the join among the nodes of its weight, -1 without
    joined_at: np.ndarray
    paired: np.ndarray  # the same for the first pair
    paired_at: np.ndarray


def huffman_steps(histogram: list[tuple[int, int]]) -> Steps:
    """``histogram`` is (count, number of words that occur so often)."""
    sizes = {weight: number for weight, number in histogram}
    waiting = sorted(sizes)
    heapq.heapify(waiting)
    rows, odd, node = [], None, 0

    def made(weight: int, number: int) -> int:
        """Room for new nodes; their first place among the nodes of that weight."""
        if weight not in sizes:
            sizes[weight] = 0
            heapq.heappush(waiting, weight)
        sizes[weight] += number
        return sizes[weight] - number

    while waiting:
        weight = heapq.heappop(waiting)
        taken = odd is not None
        pairs, rest = divmod(sizes[weight] - taken, 2)
        join = (odd + weight, made(odd + weight, 1)) if taken else (-1, -1)
        pair = (2 * weight, made(2 * weight, pairs)) if pairs else (-1, -1)
        rows.append((weight, int(taken), pairs, node, *join, *pair))
        node += taken + pairs
        odd = weight if rest else None
    columns = np.array(rows, dtype=np.int64).reshape(-1, 8).T
    at = {w: i for i, w in enumerate(columns[0].tolist())} | {-1: -1}
    columns[4], columns[6] = [at[w] for w in columns[4].tolist()], [at[w] for w in columns[6].tolist()]
    return Steps(*columns)


def climb(steps: Steps, counts: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Depths, and the bits and inner nodes from leaf to root as rows, padded with -1."""
    step, place = np.searchsorted(steps.weight, counts), places.copy()
    last = len(steps.weight) - 1
    bits, nodes = [], []
    alive = np.ones(len(step), bool)
    while True:
        taken = steps.taken[step]
        in_pair = (place >= taken) & (place < taken + 2 * steps.pairs[step])
        first = (place == 0) & (taken == 1)
        # An odd node joins the next step's first; the odd node of the last step is the root.
        odd = ~in_pair & ~first
        alive &= ~(odd & (step == last))
        if not alive.any():
            break
        up = np.where(odd, np.minimum(step + 1, last), step)
        pair = np.where(in_pair, (place - taken) // 2, 0)
        bit = np.where(in_pair, (place - taken) % 2, np.where(first, 1, 0))
        node = np.where(in_pair, steps.node[up] + steps.taken[up] + pair, steps.node[up])
        bits.append(np.where(alive, bit, -1))
        nodes.append(np.where(alive, node, -1))
        step, place = (
            np.where(alive, np.where(in_pair, steps.paired[up], steps.joined[up]), step),
            np.where(alive, np.where(in_pair, steps.paired_at[up] + pair, steps.joined_at[up]), place),
        )
    if not bits:
        return np.zeros(len(step), np.int64), np.empty((len(step), 0), np.int64), np.empty((len(step), 0), np.int64)
    bits, nodes = np.stack(bits, 1), np.stack(nodes, 1)
    return (bits >= 0).sum(1), bits, nodes


def huffman_codes(words: DataFrame) -> DataFrame:
    """Adds ``code`` (0 and 1 as text) and ``path`` (inner nodes), both from the root, to ``(word_id, word, n)``.

    ``word_id`` numbers the words by falling ``n`` without gaps. The only word of a vocabulary has an empty code.
    """
    histogram = sorted((r["n"], r["words"], r["first"]) for r in words.groupBy("n").agg(F.count("*").alias("words"), F.min("word_id").alias("first")).collect())
    steps = huffman_steps([(n, size) for n, size, _ in histogram])
    shared = words.sparkSession.sparkContext.broadcast((tuple(steps), [h[0] for h in histogram], [h[2] for h in histogram]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps, counts, firsts = Steps(*shared.value[0]), np.array(shared.value[1]), np.array(shared.value[2])
        for batch in batches:
            n, word_id = batch.column("n").to_numpy(), batch.column("word_id").to_numpy()
            depth, bits, nodes = climb(steps, n, word_id - firsts[np.searchsorted(counts, n)])
            codes = ["".join(map(str, row[:d][::-1])) for row, d in zip(bits.tolist(), depth.tolist())]
            paths = [row[:d][::-1] for row, d in zip(nodes.tolist(), depth.tolist())]
            columns = [batch.column(c) for c in ("word_id", "word", "n")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(codes, pa.string()), pa.array(paths, pa.list_(pa.int64()))], names=["word_id", "word", "n", "code", "path"])

    return words.select("word_id", "word", "n").mapInArrow(task, "word_id long, word string, n long, code string, path array<long>")
