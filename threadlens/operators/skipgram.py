"""Word vectors: skip-grams with hierarchical softmax over a Huffman tree, trained in fixed blocks of sentences.

There are two matrices, as rows of one table: a vector a word and a vector an inner node of the tree. A block of
sentences gets, by a join, the rows of the words it holds and of the nodes on their paths, trains on that copy, and
sends back how far each row moved; a row moves on by the sum over its blocks, scaled by the root of their number, as
blocks that start from the same row say partly the same. Blocks learn in waves, so that the copies and moves of few blocks
are on disk at once. Sums are partial aggregation by row. Neither the driver nor a
task holds the vocabulary: the driver sees the histogram of counts alone.

A sentence's block is a hash of its keys and the number of blocks follows from the number of words, so the vectors
depend neither on the cluster nor on how the input is partitioned.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.operators.corpus import block_count, each, vocabulary, wave_count
from threadlens.operators.huffman import huffman_codes
from threadlens.operators.similarity import matrix, row_arrays, vector_array
from threadlens.session import drop_part, drop_stored, free_shuffles, materialize

# Fixed values of the embedding jobs.
DIMENSION = 100
EPOCHS = 1
WINDOW = 5
ALPHA = (0.025, 0.0001)

MOST_BLOCK_WORDS = 200_000  # a word brings its vector, its path and the vectors of the nodes on it
# A step and two rounds of mixing by odd numbers.
STEP = np.uint64(0x9E3779B97F4A7C15)
MIX = [(np.uint64(32), np.uint64(0xD6E8FEB86659FD93))] * 2


def start_vectors(words: list[str], dim: int, seed: int) -> np.ndarray:
    """Small random vectors, each from its word alone: a digest of the word, stepped and mixed modulo 2^64."""
    digests = [hashlib.blake2b(f"{seed}:{w}".encode(), digest_size=8).digest() for w in words]
    x = np.frombuffer(b"".join(digests), "<u8")[:, None] + np.arange(1, dim + 1, dtype=np.uint64) * STEP
    for shift, factor in MIX:
        x = (x ^ (x >> shift)) * factor
    return (((x >> np.uint64(40)) / 2.0**24 - 0.5) / dim).astype(np.float32)


def _first_rows(words: DataFrame, dim: int, seed: int) -> DataFrame:
    """``(key, vec)``: words by their number, inner nodes as -1, -2, ... at zero."""

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = start_vectors(batch.column("word").to_pylist(), dim, seed)
            yield pa.RecordBatch.from_arrays([batch.column("word_id"), vector_array(vec)], names=["key", "vec"])

    own = words.select("word_id", "word").mapInArrow(start, "key long, vec array<float>")
    # A tree over V words has V - 1 inner nodes, numbered from 0.
    nodes = words.where("word_id > 0").select((-F.col("word_id")).alias("key"), F.array_repeat(F.lit(0.0).cast("float"), dim).alias("vec"))
    return own.union(nodes)


class BlockModel:
    """The rows of a block: word vectors, node vectors, and each word's path as nodes and signs (+1 for bit 0)."""

    def __init__(self, words: np.ndarray, nodes: np.ndarray, paths: list[np.ndarray], signs: list[np.ndarray]):
        self.words, self.nodes, self.paths, self.signs = words, nodes, paths, signs

    def learn(self, ids: np.ndarray, window: int, alpha: float, rng: np.random.Generator) -> None:
        """One sentence: the vectors of the words around each word, up to ``window`` on both sides and fewer by chance,
        are asked for its path. Words around it and nodes move together."""
        reach = rng.integers(1, window + 1, len(ids)).tolist()
        for at, word in enumerate(ids.tolist()):
            low = max(0, at - reach[at])
            around = np.concatenate([ids[low:at], ids[at + 1 : at + 1 + reach[at]]])
            path = self.paths[word]
            if not len(around) or not len(path):
                continue
            vectors, nodes, signs = self.words[around], self.nodes[path], self.signs[word]
            # d/dx log s(sign x) = sign s(-sign x)
            step = alpha * signs / (1.0 + np.exp(np.clip(signs * (vectors @ nodes.T), -30, 30)))
            self.nodes[path] += step.T @ vectors
            moves = step @ nodes
            if len(set(around.tolist())) == len(around):
                self.words[around] += moves
            else:  # a word that stands there twice
                np.add.at(self.words, around, moves)


def _needed(sentences: DataFrame, words: DataFrame) -> DataFrame:
    """``(block, key, word, code, path)``: the words of every block with their paths, and the nodes on those."""
    distinct = sentences.transform(each(F.col("words"), "word", "block")).distinct()
    own = materialize(distinct.join(words.select("word_id", "word", "code", "path"), "word").select("block", F.col("word_id").alias("key"), "word", "code", "path"), "needed")
    nothing = [F.lit(None).cast("string").alias("word"), F.lit(None).cast("string").alias("code"), F.lit(None).cast("array<long>").alias("path")]
    nodes = own.select("block", F.explode("path").alias("node")).distinct().select("block", (-F.col("node") - 1).alias("key"), *nothing)
    return materialize(nodes, "needed", onto=own)


def _run_epoch(sentences: DataFrame, vectors: DataFrame, keys: list[str], dim: int, window: int, alpha: float, epoch: int, seed: int) -> DataFrame:
    """``(key, vec)``: how far every block moved its rows."""

    def train(block: tuple, held: pa.Table, known: pa.Table) -> pa.Table:
        known = known.sort_by("key")
        names = known["key"].to_numpy()
        first = int(np.searchsorted(names, 0))  # nodes have the negative keys
        started = matrix(known["vec"], dim, np.float32)
        rows = started.copy()
        own = known.slice(first)
        paths = [np.searchsorted(names, -1 - p) for p in row_arrays(own["path"])]
        signs = [1 - 2 * (np.frombuffer(c.encode(), np.uint8) - np.float32(48)) for c in own["code"].to_pylist()]
        model = BlockModel(rows[first:], rows[:first], paths, signs)
        number = {w: i for i, w in enumerate(own["word"].to_pylist())}
        held = held.sort_by([(k, "ascending") for k in keys])
        for name, words in zip(zip(*(held[k].to_pylist() for k in keys)), held["words"].to_pylist()):
            at = np.array([number[w] for w in words or () if w in number], np.int64)
            model.learn(at, window, alpha, np.random.default_rng([seed, epoch, zlib.crc32(repr(name).encode())]))
        touched = np.flatnonzero((rows != started).any(axis=1))
        rows = rows[touched]
        rows -= started[touched]
        return pa.table([pa.array(names[touched]), vector_array(rows)], names=["key", "vec"])

    # Blocks are few bytes and much work: they get a number of tasks of their own, which results don't depend on.
    tasks = 4 * sentences.sparkSession.sparkContext.defaultParallelism
    left, right = (df.repartition(tasks, "block").groupBy("block") for df in (sentences, vectors))
    return left.cogroup(right).applyInArrow(train, "key long, vec array<float>")


def _sums(updates: DataFrame, dim: int) -> DataFrame:
    """``(key, n, _s0, ...)``: the number of blocks that moved a row, and their moves added up; ``updates`` of a whole wave have
    their own ``n``."""
    blocks = F.sum("n") if "n" in updates.columns else F.count("*")
    # Most rows lie in few blocks, so their moves travel as they are: partial sums would be doubles, twice as wide.
    return updates.repartition("key").groupBy("key").agg(blocks.alias("n"), *[F.sum(F.col("vec")[i].cast("double")).alias(f"_s{i}") for i in range(dim)])


def _moved(rows: DataFrame, updates: DataFrame, dim: int) -> DataFrame:
    """Rows moved by the sums over their blocks, scaled by the root of the number of blocks."""
    step = F.array(*[F.col(f"_s{i}") / F.sqrt("n") for i in range(dim)]).alias("_step")
    joined = rows.join(_sums(updates, dim).select("key", step), "key", "left")
    vec = F.when(F.col("_step").isNull(), F.col("vec")).otherwise(F.zip_with("vec", "_step", lambda v, d: (v + d).cast("float")))
    return joined.select("key", vec.alias("vec"), "slice")


def train_word_vectors(
    sentences: DataFrame,
    keys: list[str],
    dim: int = DIMENSION,
    size: int | None = None,
    min_count: int = 1,
    epochs: int = EPOCHS,
    window: int = WINDOW,
    alpha: tuple[float, float] = ALPHA,
    seed: int = 1,
    block_sentences: int | None = None,
    wave_blocks: int | None = None,
) -> DataFrame:
    """``(word_id, word, n, vec)`` from ``words``; ``keys`` name the columns that tell sentences apart.

    Blocks hold ``block_sentences`` on average if given, else follow from the number of words. With ``size`` exactly so
    many most frequent words are known. Null and empty sentences teach nothing; without any
    word the table is empty. ``wave_blocks`` blocks learn at once, and the rows move in as many slices as there are waves;
    each is dropped when it is done.
    """
    texts = materialize(sentences.select(*keys, "words"), "sentences")
    blocks = block_count(texts, most=MOST_BLOCK_WORDS) if block_sentences is None else max(1, -(-texts.count() // block_sentences))
    sentences = texts.withColumn("block", F.pmod(F.xxhash64(*keys), F.lit(blocks)).cast("int"))
    words = materialize(huffman_codes(materialize(vocabulary(sentences, size=size, min_count=min_count), "vocabulary")), "codes")
    waves = wave_count(sentences.sparkSession, blocks, wave_blocks)
    needed = _needed(sentences, words)
    part_of = F.pmod(F.col("key"), F.lit(waves)).cast("int").alias("slice")
    rows = materialize(_first_rows(words, dim, seed).select("key", "vec", part_of), "rows", partition_by="slice")
    free_shuffles(rows.sparkSession)
    for epoch in range(epochs):
        rate = max(alpha[1], alpha[0] * (1 - epoch / epochs))
        moves = moved = None
        for wave in range(waves):
            held, asked = (df.where(F.col("block") % waves == wave) for df in (sentences, needed))
            # Read once, so moves go from the blocks straight into the shuffle.
            updates = _run_epoch(held, asked.join(rows.drop("slice"), "key"), keys, dim, window, rate, epoch, seed)
            if waves > 1:
                sums = _sums(updates, dim).select("key", "n", F.array(*[f"_s{i}" for i in range(dim)]).cast("array<float>").alias("vec"), part_of)
                moves = materialize(sums, "moves", partition_by="slice", onto=moves)
                del updates, sums
                free_shuffles(rows.sparkSession)
        for part in range(waves):
            of = F.col("slice") == part
            moved = materialize(_moved(rows.where(of), updates if moves is None else moves.where(of).drop("slice"), dim), "rows", partition_by="slice", onto=moved)
            drop_part(rows, f"slice={part}")
            if moves is not None:
                drop_part(moves, f"slice={part}")
            updates = None
            free_shuffles(rows.sparkSession)
        drop_stored(rows, *[moves] if moves is not None else [])
        rows = moved
    drop_stored(needed, texts)
    rows = rows.drop("slice")
    return words.select("word_id", "word", "n").join(rows.withColumnRenamed("key", "word_id"), "word_id")
