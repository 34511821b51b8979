"""The search that skips blocks against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadlens.operators import pruned

DIM = 8
SCHEMA = "id long, vec array<double>"


def brute(requests, index, k):
    out = set()
    for name, x in requests:
        near = sorted((round(1 - float(np.dot(x, y)), 9), i) for i, y in index)[:k]
        out |= {(name, rank, i, d) for rank, (d, i) in enumerate(near, 1)}
    return out


def frames(spark, requests, index):
    asked = [(n, None if x is None else [float(v) for v in x]) for n, x in requests]
    return (
        spark.createDataFrame(asked, "request_id long, vec array<double>").repartition(3),
        spark.createDataFrame([(i, None if y is None else [float(v) for v in y]) for i, y in index], SCHEMA),
    )


def clustered(seed, n=900, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, DIM)) * 2
    return [(i, centres[i % 12] + rng.normal(size=DIM) * spread) for i in range(n)]


@pytest.mark.parametrize("k, rows", [(1, 16), (10, 16), (40, 16), (10, 10_000)])
def test_against_brute_force(spark, k, rows):
    index = clustered(k)
    index += [(5000 + n, index[3][1]) for n in range(30)]  # ties
    requests = [(i, x) for i, x in index if i % 20 == 0] + [(9000, np.zeros(DIM)), (9001, -10 * index[0][1])]
    asked, stored = frames(spark, [*requests, (9999, None)], [*index, (7777, None)])
    got = {(r.request_id, r.rank, r.id, r.distance) for r in pruned.nearest_pruned(asked, stored, k, rows=rows).collect()}
    assert got == brute(requests, index, k)


def test_blocks_are_skipped_and_bounded(spark, monkeypatch):
    index = clustered(1)
    requests = [(i, x) for i, x in index if i % 9 == 0]
    asked, stored = frames(spark, requests, index)
    blocks = pruned.Blocks(stored, rows=16)
    search = pruned.Search(asked, blocks, 5)
    assert {(r.request_id, r.rank, r.id, r.distance) for r in search.found.collect()} == brute(requests, index, 5)
    visited = sum(r.visited for r in search.visits().collect())
    assert visited < 0.5 * len(requests) * len(blocks.summary[0])
    pairs = [x.select("request_id", F.explode("blocks").alias("block")) for x in (search.first, search.more)]
    assert pairs[0].intersect(pairs[1]).count() == 0
    small = pruned.Blocks(stored, rows=16, summary_bytes=8 * (DIM + 3) * 20)
    assert len(small.summary[0]) <= 20
    monkeypatch.setattr(pruned, "INDEX_BLOCK", 100)  # several regions
    small = pruned.Blocks(stored, rows=16, summary_bytes=8 * (DIM + 3) * 20)
    monkeypatch.setattr(pruned, "REQUEST_BLOCK", 7)  # a hot block is met by several groups of requests
    got = pruned.Search(asked, small, 5).found.collect()
    assert {(r.request_id, r.rank, r.id, r.distance) for r in got} == brute(requests, index, 5)


def test_fewer_rows_than_asked_for_and_none(spark):
    index = clustered(2, n=4)
    asked, stored = frames(spark, index[:2], index)
    got = {(r.request_id, r.rank, r.id, r.distance) for r in pruned.nearest_pruned(asked, stored, 10, rows=2).collect()}
    assert got == brute(index[:2], index, 10)
    assert pruned.nearest_pruned(asked, stored.limit(0)).collect() == []
    assert pruned.nearest_pruned(asked.limit(0), stored).collect() == []
