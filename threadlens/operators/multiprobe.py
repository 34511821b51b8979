"""Hashed nearest-neighbour search that probes several buckets.

A request is hashed like the index. Where it lies near a plane, its neighbours may lie on the other side: a bucket that
differs in some bits costs the sum of the squared distances to those planes. Buckets are probed in order of that cost,
ties in order of their bits, until ``probes`` of them are open. The sequence comes from a heap over sets of bits, sorted
by distance, that grow by the next bit or trade their last bit for it: it is made one by one, never all at once.

Buckets that hold nothing are no probes: the table of buckets, one row each and at most 2^bits, is counted first and
travels to the requests. Vectors are compared by the exact search, a request standing in each bucket it probes.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlens.operators.similarity import DEFAULT_K, matrix, nearest, with_bucket
from threadlens.session import materialize

# Share of the filled buckets that a request may open.
PROBE_SHARE = 0.1


def probing_sequence(distances: list[float]) -> Iterator[tuple[float, tuple[int, ...]]]:
    """``(cost, bits to flip)`` in order of cost; costs are sums of the squares of ``distances`` to the planes."""
    order = sorted(range(len(distances)), key=lambda i: (abs(distances[i]), i))
    squares = [distances[i] ** 2 for i in order]
    yield 0.0, ()
    heap = [(squares[0], (0,))] if order else []
    while heap:
        cost, places = heapq.heappop(heap)
        yield cost, tuple(sorted(order[p] for p in places))
        last = places[-1]
        if last + 1 < len(order):
            heapq.heappush(heap, (cost + squares[last + 1], (*places, last + 1)))
            heapq.heappush(heap, (cost - squares[last] + squares[last + 1], (*places[:-1], last + 1)))


def _cheapest(distances: np.ndarray, own: str, filled: dict[str, int], signs: np.ndarray, names: list[str], probes: int) -> list[str]:
    """The ``probes`` filled buckets of least cost. Many sets of bits over few buckets are cheaper to rank than to walk."""
    if len(names) <= 1 << min(len(distances), 20) and len(names) < 64 * probes:
        costs = np.round(((signs != signs_of(own)) * distances**2).sum(1), 12)
        return [names[i] for i in np.lexsort((np.arange(len(names)), costs))[:probes].tolist()]
    found = []
    for _, flips in probing_sequence(distances.tolist()):
        bucket = "".join("10"[int(b)] if i in flips else b for i, b in enumerate(own))
        if bucket in filled:
            found.append(bucket)
            if len(found) == min(probes, len(names)):
                break
    return found


def signs_of(bucket: str) -> np.ndarray:
    return np.frombuffer(bucket.encode(), np.uint8) == ord("1")


def probed(requests: DataFrame, buckets: DataFrame, planes: np.ndarray, probes: int) -> DataFrame:
    """``(request_id, vec, bucket)``: one row a bucket that a request probes.

    ``buckets`` is ``(bucket)``, the filled ones. Requests without a vector probe nothing.
    """
    names = sorted(r["bucket"] for r in buckets.collect())  # at most 2^bits
    shared = requests.sparkSession.sparkContext.broadcast((names, planes))
    dim = planes.shape[1]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, planes = shared.value
        filled = dict.fromkeys(names, 1)
        signs = np.stack([signs_of(n) for n in names]) if names else np.empty((0, len(planes)), bool)
        lengths = np.linalg.norm(planes, axis=1)
        for batch in batches:
            distances = matrix(batch.column("vec"), dim) @ planes.T
            chosen = []
            for row in distances:
                own = "".join("1" if x > 0 else "0" for x in row)
                chosen.append(_cheapest(row / lengths, own, filled, signs, names, probes))
            at = np.repeat(np.arange(len(chosen)), [len(c) for c in chosen])
            yield pa.RecordBatch.from_arrays(
                [batch.column("request_id").take(pa.array(at)), batch.column("vec").take(pa.array(at)), pa.array([b for c in chosen for b in c], pa.string())],
                names=["request_id", "vec", "bucket"],
            )

    rows = requests.where("vec IS NOT NULL").select("request_id", "vec")
    return rows.mapInArrow(task, T.StructType([*rows.schema.fields, T.StructField("bucket", T.StringType())]))


def nearest_by_probes(
    requests: DataFrame, index: DataFrame, planes: np.ndarray, k: int = DEFAULT_K, probes: int | None = None, share: float = PROBE_SHARE, **options
) -> DataFrame:
    """``(request_id, rank, id, distance)``: the k nearest index rows in the buckets that a request probes.

    Without ``probes`` a request opens ``share`` of the filled buckets, one at least. An index with ``bucket`` is
    used as it is, any other is hashed. With as many probes as buckets the search is exact.
    """
    if "bucket" not in index.columns:
        index = materialize(with_bucket(index.select("id", "vec"), planes), "hashed")
    index = index.where("vec IS NOT NULL")
    buckets = materialize(index.select("bucket").distinct(), "buckets")
    if probes is None:
        probes = max(1, int(buckets.count() * share))
    # A request stands in several buckets under one id, an index row in one: the search keeps the best of all.
    return nearest(probed(requests, buckets, planes, probes), index, k, **options)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """``(wanted, hits)``: neighbours of the exact search, and how many of them were found."""
    hits = found.select("request_id", "id", F.lit(1).alias("hit"))
    return exact.join(hits, ["request_id", "id"], "left").agg(F.count("*").alias("wanted"), F.count("hit").alias("hits"))
