"""Neighbour search against brute force, on both ways of running it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadlens.operators import similarity as sim

DIM = 8


@pytest.fixture(scope="module")
def data(spark):
    """400 vectors, a third of them copies of one."""
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(400, DIM)).astype(np.float32)
    rows[::3] = rows[0]
    index = spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in enumerate(rows)], "id long, vec array<float>")
    asked = rng.normal(size=(30, DIM))
    asked[0] = rows[0]
    requests = spark.createDataFrame([(f"r{i}", [float(x) for x in v]) for i, v in enumerate(asked)], "request_id string, vec array<double>")
    return rows.astype(np.float64), index, asked, requests


def brute(rows, asked, k, planes=None):
    def bits(m):
        return ["".join("1" if x > 0 else "0" for x in r) for r in m @ planes.T]

    found = {}
    left, right = (bits(asked), bits(rows)) if planes is not None else ([""] * len(asked), [""] * len(rows))
    for i, v in enumerate(asked):
        near = sorted((round(1 - float(v @ rows[j]), 9), j) for j in range(len(rows)) if right[j] == left[i])
        for rank, (d, j) in enumerate(near[:k], 1):
            found[f"r{i}", rank] = (j, round(d, 6))
    return found


def keyed(df):
    return {(r.request_id, r["rank"]): (r.id, round(r.distance, 6)) for r in df.collect()}


@pytest.mark.parametrize("budget", [sim.BROADCAST_BYTES, 0])
@pytest.mark.parametrize("partitions", [1, 9])
def test_exact_and_hashed(spark, data, monkeypatch, budget, partitions):
    monkeypatch.setattr(sim, "INDEX_BLOCK", 40)
    monkeypatch.setattr(sim, "REQUEST_BLOCK", 7)
    rows, index, asked, requests = data
    index = index.repartition(partitions)
    exact = keyed(sim.nearest_exact(requests, index, k=5, broadcast_bytes=budget))
    assert exact == brute(rows, asked, 5)
    planes = sim.hyperplanes(2, DIM)
    hashed = sim.nearest_by_hash(requests, index, planes, k=5, broadcast_bytes=budget)
    assert keyed(hashed) == brute(rows, asked, 5, planes)
    near = {(r.request_id, r.id) for r in sim.nearest_exact(requests, index, k=400, broadcast_bytes=budget).collect()}
    assert {(r.request_id, r.id) for r in hashed.collect()} <= near


def test_many_requests_are_not_broadcast(spark, monkeypatch):
    """20,000 requests of 64 places, 10 MB of vectors, meet the index in blocks."""
    whole = lambda *a, **b: pytest.fail("broadcast")
    monkeypatch.setattr(sim, "_search_broadcast", whole)
    vec = F.array(*[((F.col("id") * (i + 3)) % 97 / 97.0 - 0.5) for i in range(64)]).alias("vec")
    requests = spark.range(20_000).select(F.col("id").alias("request_id"), vec)
    found = sim.nearest_by_hash(requests, spark.range(40).select("id", vec), sim.hyperplanes(1, 64), k=1)
    assert 0 < found.count() <= 20_000


def test_ties_go_to_the_smaller_id(spark, data):
    _, index, _, requests = data
    found = keyed(sim.nearest_exact(requests.where("request_id = 'r0'"), index, k=20))
    copies = [found["r0", i][0] for i in range(1, 21) if found["r0", i][0] % 3 == 0]
    assert len(copies) > 5 and copies == list(range(0, 3 * len(copies), 3))


def test_missing_vectors_and_empty_requests(spark, data):
    _, index, _, requests = data
    planes = sim.hyperplanes(3, DIM)
    holes = index.selectExpr("id", "CASE WHEN id % 2 = 0 THEN vec END AS vec")
    found = sim.nearest_by_hash(requests, holes, planes, k=50)
    assert found.where("id % 2 = 1").count() == 0 and found.count() > 0
    assert sim.nearest_by_hash(requests.where("false"), index, planes).count() == 0
    none = requests.selectExpr("request_id", "CAST(NULL AS array<double>) AS vec")
    assert sim.nearest_by_hash(none, index, planes).count() == 0


@pytest.mark.parametrize("partitioned", [True, False])
def test_index_round_trip(spark, data, tmp_path, partitioned):
    rows, index, asked, requests = data
    planes = sim.hyperplanes(3, DIM)
    sim.write_index(index, planes, str(tmp_path / "ix"), partitioned)
    stored, again = sim.read_index(spark, str(tmp_path / "ix"))
    assert np.array_equal(planes, again)
    assert keyed(sim.nearest_by_hash(requests, stored, again, k=5)) == brute(rows, asked, 5, planes)


def test_planes_are_reproducible():
    assert np.array_equal(sim.hyperplanes(5, 4), sim.hyperplanes(5, 4))
    assert sim.hyperplanes(12, 100).shape == (12, 100)
