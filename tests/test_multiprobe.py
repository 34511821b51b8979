"""The probing sequence against all sets of bits, and the probed search against brute force."""

import itertools

import numpy as np
import pytest

from threadlens.operators import multiprobe, similarity

DIM, BITS = 8, 5


@pytest.mark.parametrize("bits", [0, 1, 4, 8])
def test_sequence_is_in_order_and_whole(bits):
    distances = np.random.default_rng(bits).normal(size=bits).tolist()
    found = list(multiprobe.probing_sequence(distances))
    wanted = [(sum(distances[i] ** 2 for i in s), s) for n in range(bits + 1) for s in itertools.combinations(range(bits), n)]
    assert np.allclose([c for c, _ in found], sorted(c for c, _ in wanted))
    assert sorted(s for _, s in found) == sorted(s for _, s in wanted)


def test_walk_and_ranking_agree():
    rng = np.random.default_rng(4)
    names = sorted({"".join(rng.choice(["0", "1"], 12)) for _ in range(600)})
    signs, filled = np.stack([multiprobe.signs_of(n) for n in names]), dict.fromkeys(names, 1)
    for _ in range(20):
        distances = rng.normal(size=12)
        own = "".join("1" if x > 0 else "0" for x in distances)
        ranked = multiprobe._cheapest(distances, own, filled, signs, names, 10)
        walked = multiprobe._cheapest(distances, own, filled, signs, names, 9)  # 600 > 64 * 9
        assert walked == ranked[:9]


@pytest.mark.parametrize("budget", [similarity.BROADCAST_BYTES, 0])
@pytest.mark.parametrize("probes", [1, 4, 1000])
def test_search(spark, budget, probes):
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(400, DIM)).astype(np.float32)
    rows[::3] = rows[0]  # a hot bucket
    asked = rng.normal(size=(20, DIM))
    index = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)] + [(999, None)], "id long, vec array<float>").repartition(5)
    requests = spark.createDataFrame([(f"r{i}", v.tolist()) for i, v in enumerate(asked)] + [("none", None)], "request_id string, vec array<double>")
    planes = similarity.hyperplanes(BITS, DIM)
    found = {(r.request_id, r["rank"]): r.id for r in multiprobe.nearest_by_probes(requests, index, planes, 5, probes, broadcast_bytes=budget).collect()}
    wide = rows.astype(np.float64)
    buckets = [tuple(x) for x in wide @ planes.T > 0]
    wanted = {}
    for n, v in enumerate(asked):
        distance = planes @ v / np.linalg.norm(planes, axis=1)
        cost = {b: sum(d * d for d, s in zip(distance, b) if (d > 0) != s) for b in set(buckets)}
        opened = set(sorted(cost, key=lambda b: (round(cost[b], 12), b))[:probes])
        near = sorted((round(1 - float(v @ wide[j]), 9), j) for j in range(400) if buckets[j] in opened)
        wanted |= {(f"r{n}", rank): j for rank, (_, j) in enumerate(near[:5], 1)}
    assert found == wanted
