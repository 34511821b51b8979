"""Nearest neighbours: random-hyperplane buckets, exact search, index tables.

A search compares request vectors with the index rows of the same bucket. Distances are 1 - x.y on
doubles, rounded to nine digits so that equal vectors tie, and ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlens.functions.vector import similarity
from threadlens.session import materialize

# Fixed values of the two indexes: bits for documents and for words, seed of the planes.
DOCUMENT_BITS = 12
WORD_BITS = 5
PLANE_SEED = 123

DEFAULT_K = 10

# Requests are broadcast up to this many bytes of vector data; beyond it both sides are shuffled. Every Python worker
# takes about ten times as much for them (measured), whereas a shuffled block is bounded.
BROADCAST_BYTES = 8 << 20
# Rows of one shuffled block of the index and of the requests.
INDEX_BLOCK = 20_000
REQUEST_BLOCK = 4_000
# Cells of one distance matrix held at a time.
MATRIX_CELLS = 4_000_000


def hyperplanes(bits: int, dim: int, seed: int = PLANE_SEED) -> np.ndarray:
    """``bits`` normal vectors; the legacy generator gives the same numbers on every version."""
    return np.random.RandomState(seed).randn(bits, dim)


def matrix(column: pa.Array, dim: int, dtype=np.float64) -> np.ndarray:
    """An Arrow list column as rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(-1, dim)


def row_arrays(column: pa.Array) -> list[np.ndarray]:
    """The rows of an Arrow list column of numbers as views; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    values = column.flatten().to_numpy(zero_copy_only=False)  # without what lies under null rows
    return [values[end - n:end] for n, end in zip(lengths.tolist(), ends.tolist())]


def vector_array(rows: np.ndarray, kind=pa.float32()) -> pa.Array:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.reshape(-1), type=kind))


def with_bucket(df: DataFrame, planes: np.ndarray, vec: str = "vec") -> DataFrame:
    """Add ``bucket``: one sign bit a plane, 1 when the vector lies on its positive side.

    Rows with a NULL vector get a NULL bucket.
    """
    dim = planes.shape[1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(vec)
            codes, rows = np.unique(matrix(column, dim) @ planes.T > 0, axis=0, return_inverse=True)
            names = np.array(["".join("1" if bit else "0" for bit in code) for code in codes], dtype=object)
            text = np.full(len(column), None, dtype=object)
            text[column.is_valid().to_numpy(zero_copy_only=False)] = names[rows.reshape(-1)] if len(names) else []
            bucket = pa.array(text, pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, bucket], names=[*batch.schema.names, "bucket"])

    return df.mapInArrow(assign, T.StructType([*df.schema.fields, T.StructField("bucket", T.StringType())]))


def write_index(df: DataFrame, planes: np.ndarray, path: str, partitioned: bool) -> None:
    """Store bucketed vectors and the planes.

    Few buckets become folders; many stay a sorted column whose statistics prune row groups. The
    range partitioning includes the id, so a hot bucket spreads over several files.
    """
    spark = df.sparkSession
    indexed = df if "bucket" in df.columns else with_bucket(df, planes)
    indexed = indexed.repartitionByRange("bucket", "id").sortWithinPartitions("bucket", "id")
    writer = indexed.write.mode("errorifexists")
    (writer.partitionBy("bucket") if partitioned else writer).parquet(f"{path}/rows")
    config = [(i, [float(x) for x in plane]) for i, plane in enumerate(planes)]
    spark.createDataFrame(config, "bit int, plane array<double>").coalesce(1).write.parquet(f"{path}/planes")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, np.ndarray]:
    """The bucketed rows and the planes they were hashed with (a few rows, one for each bit)."""
    config = spark.read.parquet(f"{path}/planes").orderBy("bit").collect()
    found = spark.read.parquet(f"{path}/rows").schema
    # A folder name such as 00101 must stay text.
    schema = T.StructType([T.StructField("bucket", T.StringType()) if f.name == "bucket" else f for f in found])
    rows = spark.read.schema(schema).parquet(f"{path}/rows")
    return rows, np.array([r["plane"] for r in config])


class _Best:
    """The k best index rows of every request seen so far in a task."""

    def __init__(self, requests: np.ndarray, k: int):
        self.requests, self.k = requests, k
        self.found: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def offer(self, chosen: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Compare the requests numbered ``chosen`` with some index rows."""
        step = max(1, MATRIX_CELLS // max(1, len(rows)))
        for at in range(0, len(chosen), step):
            part = chosen[at:at + step]
            distances = np.round(1.0 - self.requests[part] @ rows.T, 9)
            for number, row in zip(part, distances):
                self._keep(int(number), ids, row)

    def _keep(self, number: int, ids: np.ndarray, distance: np.ndarray) -> None:
        if len(distance) > self.k:
            limit = np.partition(distance, self.k - 1)[self.k - 1]
            near = distance <= limit
            ids, distance = ids[near], distance[near]
        if number in self.found:
            old_ids, old_distance = self.found[number]
            ids, distance = np.concatenate([old_ids, ids]), np.concatenate([old_distance, distance])
        order = np.lexsort((ids, distance))[: self.k]
        self.found[number] = ids[order], distance[order]

    def batch(self, request_ids: pa.Array, id_type: pa.DataType) -> pa.RecordBatch:
        numbers = np.repeat(list(self.found), [len(i) for i, _ in self.found.values()]).astype(np.int64)
        ids = np.concatenate([i for i, _ in self.found.values()]) if self.found else np.array([])
        distance = np.concatenate([d for _, d in self.found.values()]) if self.found else np.array([])
        return pa.RecordBatch.from_arrays(
            [pc.take(request_ids, pa.array(numbers)), pa.array(ids, type=id_type), pa.array(distance, pa.float64())],
            names=["request_id", "id", "distance"],
        )


def _best_of(partial: DataFrame, k: int) -> DataFrame:
    """Merge the k best of every task; Spark limits each group before and after the shuffle."""
    order = Window.partitionBy("request_id").orderBy("distance", "id")
    return partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search_broadcast(requests: pa.Table, index: DataFrame, schema: T.StructType, k: int, dim: int) -> DataFrame:
    """Every task of the index scan meets all requests: the index is not shuffled."""
    shared = index.sparkSession.sparkContext.broadcast(requests)
    # At most 2^bits buckets; as a literal list the filter reaches the scan or its folders.
    wanted = sorted(b for b in pc.unique(requests["bucket"]).to_pylist() if b is not None)
    index = index.where(F.col("bucket").isin(wanted)).select("bucket", "id", "vec")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        best = _Best(matrix(table["vec"], dim), k)
        asked: dict[str, list[int]] = {}
        for number, bucket in enumerate(table["bucket"].to_pylist()):
            asked.setdefault(bucket, []).append(number)
        groups = {bucket: np.array(numbers) for bucket, numbers in asked.items()}
        id_type = None
        for batch in batches:
            id_type = batch.column("id").type
            rows = matrix(batch.column("vec"), dim)
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            buckets = batch.column("bucket").to_numpy(zero_copy_only=False)
            for bucket in set(buckets):
                here = buckets == bucket
                best.offer(groups[bucket], ids[here], rows[here])
        if id_type is not None:
            yield best.batch(table["request_id"].combine_chunks(), id_type)

    return index.mapInArrow(search, schema)


def _search_shuffled(requests: DataFrame, index: DataFrame, schema: T.StructType, k: int, dim: int) -> DataFrame:
    """Both sides are cut into blocks, so no task holds a whole bucket however hot it is.

    Every request block of a bucket meets every index block of the same bucket.
    """

    def blocks(df: DataFrame, size: int, name: str) -> DataFrame:
        return df.groupBy("bucket").agg(F.ceil(F.count("*") / size).cast("int").alias(name))

    sizes = blocks(requests, REQUEST_BLOCK, "request_blocks").join(blocks(index, INDEX_BLOCK, "index_blocks"), "bucket")

    # One row a bucket, and there are at most 2^bits of them.
    sizes = F.broadcast(sizes)

    def block_of(key: str, count: str):
        return F.pmod(F.xxhash64(key), F.col(count)).cast("int")

    left = requests.join(sizes, "bucket").select(
        "bucket", "request_id", "vec",
        block_of("request_id", "request_blocks").alias("request_block"),
        F.explode(F.sequence(F.lit(0), F.col("index_blocks") - 1)).alias("index_block"),
    )
    right = index.join(sizes, "bucket").select(
        "bucket", "id", "vec",
        block_of("id", "index_blocks").alias("index_block"),
        F.explode(F.sequence(F.lit(0), F.col("request_blocks") - 1)).alias("request_block"),
    )
    cell = ["bucket", "request_block", "index_block"]

    def search(asked: pa.Table, stored: pa.Table) -> pa.Table:
        id_type = stored["id"].type
        request_ids = asked["request_id"].combine_chunks()
        best = _Best(matrix(asked["vec"], dim) if len(asked) else np.empty((0, dim)), k)
        if len(asked) and len(stored):
            ids = stored["id"].to_numpy()
            best.offer(np.arange(len(asked)), ids, matrix(stored["vec"], dim))
        return pa.Table.from_batches([best.batch(request_ids, id_type)])

    return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(search, schema)


def nearest(
    requests: DataFrame, index: DataFrame, k: int = DEFAULT_K, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """``(request_id, rank, id, distance)``: the k index rows nearest to each request in its bucket.

    ``requests`` has ``(request_id, vec, bucket)`` and ``index`` ``(id, vec, bucket)``. Requests
    without a vector have no neighbours.
    """
    requests = materialize(requests.where("vec IS NOT NULL").select("request_id", "vec", "bucket"), "requests")
    index = index.where("vec IS NOT NULL").select("id", "vec", "bucket")
    schema = T.StructType([
        requests.schema["request_id"], index.schema["id"], T.StructField("distance", T.DoubleType()),
    ])
    size = requests.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dim")).first()
    n, dim = size["n"], size["dim"] or 1
    if 8 * n * dim <= broadcast_bytes:
        partial = _search_broadcast(requests.toArrow(), index, schema, k, dim)
    else:
        partial = _search_shuffled(requests, index, schema, k, dim)
    return _best_of(partial, k).select("request_id", "rank", "id", "distance")


def nearest_by_hash(
    requests: DataFrame, index: DataFrame, planes: np.ndarray, k: int = DEFAULT_K, **options
) -> DataFrame:
    """Neighbours within the request's bucket. An index that already has ``bucket`` is used as is."""
    if "bucket" not in index.columns:
        index = with_bucket(index.select("id", "vec"), planes)
    asked = requests.where("vec IS NOT NULL").select("request_id", "vec")
    return nearest(with_bucket(asked, planes), index, k, **options)


def nearest_exact(requests: DataFrame, index: DataFrame, k: int = DEFAULT_K, **options) -> DataFrame:
    """Neighbours over the whole index: everything lies in one bucket, cut into blocks."""
    everything = F.lit("").alias("bucket")
    return nearest(
        requests.select("request_id", "vec", everything), index.select("id", "vec", everything), k, **options
    )


def with_results(neighbours: DataFrame, index: DataFrame, columns: list[str]) -> DataFrame:
    """Similarity instead of distance, and columns of the index rows that were found.

    The result is stored first: when it is small, its known size lets Spark broadcast it instead
    of shuffling the index.
    """
    found = materialize(neighbours, "neighbours")
    return found.withColumn("sim", similarity(F.col("distance"))).join(index.select("id", *columns), "id")
