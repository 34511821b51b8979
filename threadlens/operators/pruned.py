"""Exact nearest neighbours over blocks of the index that can be skipped.

The index is sorted by hash bucket and length of the vectors and cut into blocks of equal size, each with its centroid c
and radius r. No row of a block has a product with a request x over x.c + |x| r. A request first visits the blocks of
the largest bounds that hold k rows together; its k-th best distance then tells which other blocks may hold a nearer
one, and only these are visited. The result is the one of the full search.

The table of blocks is broadcast: blocks grow with the index, so it never exceeds SUMMARY_BYTES. Neighbouring blocks
form regions. A request travels once to each region with blocks to visit, with their numbers, and gets its k best of them;
the index moves once a visit, by region, and a region is copied only if more than REQUEST_BLOCK requests ask for it,
once for each so many of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlens.operators.ranking import with_position
from threadlens.operators.similarity import (
    DEFAULT_K, DOCUMENT_BITS, INDEX_BLOCK, MATRIX_CELLS, REQUEST_BLOCK, _Best, _best_of, hyperplanes, matrix, vector_array, with_bucket,
)
from threadlens.session import materialize

BLOCK = 256  # rows
SUMMARY_BYTES = 64 << 20
EMITTED = 4_096  # rows of an Arrow batch of requests at their regions
SLACK = 2e-9  # distances are rounded to nine digits


class Blocks:
    """The index by block, and what bounds the products of each block; at most SUMMARY_BYTES reach the driver."""

    def __init__(self, index: DataFrame, rows: int = BLOCK, summary_bytes: int = SUMMARY_BYTES):
        index = index.where("vec IS NOT NULL").select("id", "vec")
        n, dim = index.agg(F.count("*"), F.max(F.size("vec"))).first()
        self.dim = dim or 1
        rows = max(rows, -(-n * 8 * (self.dim + 3) // summary_bytes))
        length = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
        hashed = with_bucket(index, hyperplanes(DOCUMENT_BITS, self.dim)).withColumn("length", length)
        self.each = max(1, INDEX_BLOCK // rows)  # blocks of a region
        placed = with_position(hashed, [F.col("bucket"), F.col("length"), F.col("id")])
        self.rows = materialize(placed.select(F.floor(F.col("position") / rows).cast("long").alias("block"), "id", "vec"), "blocks")
        dim = self.dim

        def summary(block: pa.Table) -> pa.Table:
            own = matrix(block["vec"], dim)
            centre = own.mean(axis=0)
            radius = float(np.sqrt(((own - centre) ** 2).sum(axis=1).max()))
            columns = [block["block"].combine_chunks()[:1], vector_array(centre[None, :], pa.float64()), pa.array([radius]), pa.array([len(own)], pa.int64())]
            return pa.Table.from_arrays(columns, names=["block", "centre", "radius", "n"])

        table = self.rows.groupBy("block").applyInArrow(summary, "block long, centre array<double>, radius double, n long").toArrow()
        self.summary = (
            table["block"].to_numpy(), matrix(table["centre"], dim) if len(table) else np.empty((0, dim)),
            table["radius"].to_numpy(), table["n"].to_numpy(),
        )


def _bounds(requests: np.ndarray, summary: tuple[np.ndarray, ...]) -> Iterator[tuple[int, np.ndarray]]:
    """For each request its smallest possible distance to every block."""
    _, centres, radii, _ = summary
    step = max(1, MATRIX_CELLS // max(1, len(centres)))
    for at in range(0, len(requests), step):
        part = requests[at:at + step]
        least = 1.0 - part @ centres.T - np.sqrt((part**2).sum(axis=1))[:, None] * radii
        yield from enumerate(least, at)


def _first(least: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """The blocks of smallest possible distance that hold ``k`` rows together, or all."""
    order = np.argsort(least, kind="stable")
    return order[: int(np.searchsorted(np.cumsum(sizes[order]), k)) + 1]


def _asked(requests: DataFrame, blocks: Blocks, choose: Callable) -> DataFrame:
    """``(region, request_id, vec, blocks)``: requests at the regions of the blocks that ``choose`` names."""
    shared, dim, each = requests.sparkSession.sparkContext.broadcast(blocks.summary), blocks.dim, blocks.each
    names = ["region", "request_id", "vec", "blocks"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary = shared.value
        for batch in batches if len(summary[0]) else ():
            limits = batch.column("limit").to_numpy(zero_copy_only=False)
            for i, least in _bounds(matrix(batch.column("vec"), dim), summary):
                chosen = np.sort(summary[0][choose(least, summary[3], limits[i])])
                regions, begins = np.unique(chosen // each, return_index=True)
                ends = np.append(begins[1:], len(chosen))
                for at in range(0, len(regions), EMITTED):
                    own = regions[at:at + EMITTED]
                    numbers = pa.array([chosen[b:e] for b, e in zip(begins[at:at + EMITTED], ends[at:at + EMITTED])], pa.list_(pa.int64()))
                    rows = pa.array(np.full(len(own), i))
                    columns = [pa.array(own, pa.int64()), batch.column("request_id").take(rows), batch.column("vec").take(rows), numbers]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    fields = [T.StructField("region", T.LongType()), requests.schema["request_id"], requests.schema["vec"], T.StructField("blocks", T.ArrayType(T.LongType()))]
    return requests.mapInArrow(task, T.StructType(fields))


def _visit(asked: DataFrame, blocks: Blocks, k: int, schema: T.StructType) -> DataFrame:
    """The k best of every request within every region; a task holds a region and a bounded group of requests."""
    dim, key = blocks.dim, ["region", "part"]
    parts = asked.groupBy("region").agg(F.ceil(F.count("*") / REQUEST_BLOCK).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("request_id"), F.col("parts")).cast("int")
    left = asked.join(parts, "region").select("region", part.alias("part"), "request_id", "vec", "blocks")
    stored = blocks.rows.withColumn("region", F.floor(F.col("block") / blocks.each))
    right = stored.join(parts, "region").select("region", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "block", "id", "vec")

    def search(requests: pa.Table, stored: pa.Table) -> pa.Table:
        best = _Best(matrix(requests["vec"], dim) if len(requests) else np.empty((0, dim)), k)
        if len(requests) and len(stored):
            ids, rows, block = stored["id"].to_numpy(), matrix(stored["vec"], dim), stored["block"].to_numpy()
            lists = requests["blocks"].combine_chunks()
            wanted = lists.flatten().to_numpy()
            number = np.repeat(np.arange(len(requests)), lists.value_lengths().to_numpy())
            for one in np.unique(wanted):
                best.offer(number[wanted == one], ids[block == one], rows[block == one])
        return pa.Table.from_batches([best.batch(requests["request_id"].combine_chunks(), stored["id"].type)])

    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(search, schema)


class Search:
    """``found`` (request_id, rank, id, distance); ``first`` and ``more`` (region, request_id, vec, blocks) are the visits made."""

    def __init__(self, requests: DataFrame, blocks: Blocks, k: int = DEFAULT_K):
        schema = T.StructType([requests.schema["request_id"], blocks.rows.schema["id"], T.StructField("distance", T.DoubleType())])
        requests = materialize(requests.where("vec IS NOT NULL").select("request_id", "vec"), "requests")
        everything = F.lit(float("inf"))
        self.first = materialize(_asked(requests.withColumn("limit", everything), blocks, lambda least, sizes, _: _first(least, sizes, k)), "first-visits")
        near = materialize(_best_of(_visit(self.first, blocks, k, schema), k).drop("rank"), "first-found")
        # With less than k rows found there is no limit: all blocks were visited.
        limits = near.groupBy("request_id").agg(F.max("distance").alias("limit"))

        def others(least: np.ndarray, sizes: np.ndarray, limit: float) -> np.ndarray:
            near_enough = least <= limit + SLACK
            near_enough[_first(least, sizes, k)] = False
            return np.flatnonzero(near_enough)

        self.more = materialize(_asked(requests.join(limits, "request_id"), blocks, others), "more-visits")
        self.found = _best_of(near.union(_visit(self.more, blocks, k, schema)), k).select("request_id", "rank", "id", "distance")

    def visits(self) -> DataFrame:
        """``(request_id, visited)``: blocks a request was compared with."""
        return self.first.union(self.more).groupBy("request_id").agg(F.sum(F.size("blocks")).alias("visited"))


def nearest_pruned(requests: DataFrame, index: DataFrame, k: int = DEFAULT_K, **options) -> DataFrame:
    """``(request_id, rank, id, distance)`` of ``requests`` (request_id, vec) over the whole ``index`` (id, vec).

    Request ids are unique. Requests without a vector have no neighbours; ties go to the smaller id.
    """
    return Search(requests, Blocks(index, **options), k).found
