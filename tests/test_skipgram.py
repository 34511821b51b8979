"""Huffman codes against a plain tree, and word vectors on text with known topics."""

import heapq
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from threadlens.operators import huffman, skipgram

DIM = 16


def coded(counts):
    """(code, path from the root) of words in order of falling counts."""
    steps = huffman.huffman_steps(sorted(Counter(counts).items()))
    first = {}
    for i, c in enumerate(counts):
        first.setdefault(c, i)
    depth, bits, nodes = huffman.climb(steps, np.array(counts), np.array([i - first[c] for i, c in enumerate(counts)]))
    return [("".join(map(str, b[:d][::-1])), n[:d][::-1]) for d, b, n in zip(depth.tolist(), bits.tolist(), nodes.tolist())]


def least_cost(counts):
    heap, cost = list(counts), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        cost += both
        heapq.heappush(heap, both)
    return cost


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(1, 4), st.integers(1, 10**6)), min_size=1, max_size=60))
def test_codes_are_a_best_prefix_code(counts):
    counts = sorted(counts, reverse=True)
    found = coded(counts)
    assert sum(c * len(code) for c, (code, _) in zip(counts, found)) == least_cost(counts)
    codes = sorted(code for code, _ in found)
    assert len(set(codes)) == len(codes) and not any(b.startswith(a) for a, b in zip(codes, codes[1:]) if a != b)
    below = {}  # a node is where its code so far leads, the same for all words under it
    for code, path in found:
        for place, node in enumerate(path):
            assert below.setdefault(code[:place], node) == node
    assert sorted(below.values()) == list(range(len(counts) - 1))


@pytest.fixture(scope="module")
def topics(spark):
    rng = random.Random(7)
    return [(i, [f"t{i % 3}w{rng.randrange(12)}" for _ in range(30)]) for i in range(300)] + [(900, None), (901, []), (902, ["alone"])]


def trained(spark, rows, partitions, **options):
    df = spark.createDataFrame(rows, "id long, words array<string>").repartition(partitions)
    return {r.word: np.array(r.vec) for r in skipgram.train_word_vectors(df, ["id"], dim=DIM, block_sentences=40, **options).collect()}


def test_word_vectors_find_topics_on_any_partitioning(spark, topics):
    one = trained(spark, topics, 1, epochs=3)
    other = trained(spark, topics, 9, epochs=3)
    assert len(one) == 37 and max(np.abs(one[w] - other[w]).max() for w in one) < 1e-5
    words = [w for w in one if w != "alone"]
    m = np.stack([one[w] for w in words])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    near = m @ m.T
    np.fill_diagonal(near, -9)
    assert all(words[i][:2] == words[j][:2] for i, j in enumerate(near.argmax(axis=1)))


def test_moves_are_shuffled_once_and_as_floats(spark, topics, monkeypatch):
    """Moves of the blocks are neither stored nor widened to partial sums before their one shuffle."""
    plans, moved = [], skipgram._moved

    def seen(rows, updates, dim):
        found = moved(rows, updates, dim)
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        return found

    monkeypatch.setattr(skipgram, "_moved", seen)
    trained(spark, topics, 2)
    plan = plans[0]
    trained_at, shuffled_at = plan.index("FlatMapCoGroupsInArrow"), plan.index("partial_sum")
    assert shuffled_at < plan.index("Exchange hashpartitioning(key", shuffled_at) < trained_at  # partial sums come after it


def test_waves_bound_what_is_on_its_way_and_give_the_same_vectors(spark, topics, monkeypatch):
    asked, run = [], skipgram._run_epoch

    def seen(sentences, vectors, *rest):
        asked.append(vectors.select("block").distinct().count())
        return run(sentences, vectors, *rest)

    monkeypatch.setattr(skipgram, "_run_epoch", seen)
    one, waves = (trained(spark, topics, 3, epochs=2, wave_blocks=n) for n in (100, 3))
    assert asked[:2] == [8, 8] and len(asked) == 2 + 2 * 3 and max(asked[2:]) == 3
    assert set(one) == set(waves) and max(np.abs(one[w] - waves[w]).max() for w in one) < 1e-5


def test_vocabulary_cap_and_no_words(spark):
    rows = [(1, ["a"] * 9 + ["b"] * 6 + ["d"] * 3 + ["c"] * 3), (2, [])]
    assert set(trained(spark, rows, 1, size=3)) == {"a", "b", "c"}
    assert set(trained(spark, rows, 1)) == {"a", "b", "c", "d"}
    assert trained(spark, [(1, []), (2, None)], 1) == {}
    assert set(trained(spark, [(1, ["only", "only"])], 1)) == {"only"}
