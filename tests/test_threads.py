"""Thread edges, paths, roots, cycles."""

import random

import pytest

from threadlens.operators.intervals import lies_below, thread_intervals
from threadlens.operators.threads import thread_ancestors, thread_edges, thread_roots

EDGES = "id long, parent long"


def by_id(nodes):
    return {r.id: r for r in nodes.collect()}


def expected(parents):
    """Brute force: every path by walking up."""
    out = {}
    for node in set(parents) | set(parents.values()):
        path, at = [], node
        while at in parents:
            at = parents[at]
            path.append(at)
            if len(path) > len(parents):
                path = None
                break
        out[node] = None if path is None else path[::-1]
    return out


def test_edges_need_a_present_parent(spark):
    items = spark.createDataFrame([(1, None), (2, 1), (3, 99), (4, 1), (1, None)], EDGES)
    assert sorted(map(tuple, thread_edges(items).collect())) == [(2, 1), (4, 1)]


def test_small_tree(spark):
    nodes = by_id(thread_ancestors(spark.createDataFrame([(2, 1), (3, 2), (4, 3), (5, 1)], EDGES)).nodes)
    assert {i: r.path for i, r in nodes.items()} == {1: [], 2: [1], 3: [1, 2], 4: [1, 2, 3], 5: [1]}
    assert {i: r.root for i, r in nodes.items()} == {1: None, 2: 1, 3: 1, 4: 1, 5: 1}


def test_no_edges(spark):
    found = thread_ancestors(spark.createDataFrame([], EDGES))
    assert found.nodes.count() == 0 and found.cyclic_ids.count() == 0


def test_cap_keeps_the_nearest(spark):
    chain = spark.range(1, 1500).selectExpr("id + 1 AS id", "id AS parent")
    whole = by_id(thread_ancestors(chain).nodes)
    assert whole[1500].path == list(range(1, 1500)) and whole[1500].root == 1
    found = thread_ancestors(chain, max_path=1000)
    nodes = by_id(found.nodes)
    assert found.cyclic_ids.count() == 0
    assert len(nodes) == 1500
    assert nodes[1500].path == list(range(500, 1500)) and nodes[1500].depth == 1499
    assert nodes[1500].root == 1 and nodes[1500].truncated and not nodes[1001].truncated
    assert nodes[1499].path[0] == 499
    assert nodes[900].path == list(range(1, 900))
    roots = by_id(thread_roots(chain).nodes)
    assert roots[1500].root == 1 and roots[1500].depth == 1499 and roots[1].root is None


@pytest.mark.parametrize("resolve", [thread_ancestors, thread_roots])
def test_cycles_are_set_apart(spark, resolve):
    edges = [(1, 2), (2, 1), (3, 3), (4, 1), (6, 5), (7, 6)] + [(i + 1, i) for i in range(100, 140)] + [(100, 1)]
    found = resolve(spark.createDataFrame(edges, EDGES))
    assert sorted(r.id for r in found.cyclic_ids.collect()) == [1, 2, 3, 4] + list(range(100, 141))
    assert sorted(by_id(found.nodes)) == [5, 6, 7]


def test_two_parents_and_unusable_ids(spark):
    edges = [(5, 9), (5, 3), (3, 1), (8, 0), (10, 8), (-4, 1), (11, -4)]
    nodes = by_id(thread_ancestors(spark.createDataFrame(edges, EDGES)).nodes)
    assert nodes[5].path == [1, 3]
    assert nodes[8].path == [] and nodes[10].path == [8]
    assert nodes[-4].path == [1] and nodes[11].path == []
    assert {0, 9, -4, 1} <= set(nodes)


@pytest.mark.parametrize("seed,partitions", [(1, 1), (2, 16)])
def test_random_forests_with_a_hot_parent(spark, seed, partitions):
    rng = random.Random(seed)
    parents = {i: 1 if i % 3 == 0 else rng.randrange(1, i) for i in range(2, 400)}
    parents.update({i: i - 1 for i in range(401, 470)})
    rows = spark.createDataFrame(list(parents.items()), EDGES).repartition(partitions)
    nodes = by_id(thread_ancestors(rows).nodes)
    want = expected(parents)
    assert {i: r.path for i, r in nodes.items()} == want
    for i, r in nodes.items():
        assert r.depth == len(r.path) and r.root == (r.path[0] if r.path else None)
        assert not r.path or r.path[-1] == parents[i]
    assert {i: r.root for i, r in by_id(thread_roots(rows).nodes).items()} == {i: p[0] if p else None for i, p in want.items()}


def walked(parents):
    """Brute force: (thread, enter, leave) of every node that a root leads to, by walking through all trees."""
    children = {}
    for child, parent in parents.items():
        children.setdefault(parent, []).append(child)
    out = {}
    for root in (set(parents.values()) - set(parents)):
        clock, open_nodes = 0, [(root, False)]
        while open_nodes:
            node, left = open_nodes.pop()
            if left:
                out[node] += (clock,)
            else:
                out[node] = (root, clock)
                open_nodes.append((node, True))
                open_nodes += [(c, False) for c in sorted(children.get(node, []), reverse=True)]
            clock += 1
    return out


@pytest.mark.parametrize("seed", range(3))
def test_intervals_against_a_walk(spark, seed):
    pick = random.Random(seed)
    parents = {n: pick.randint(1, n - 1) for n in range(2, 60)}  # one tree
    parents |= {n: 100 for n in range(101, 160)}  # a popular parent
    parents |= {n: n - 1 for n in range(201, 300)}  # a chain
    parents |= {400: 401, 401: 402, 402: 400, 403: 400, 404: 403}  # a cycle and what hangs off it
    parents |= {-7: 5, 0: 5, -8: 150}  # leaves whose ids are no parents
    rows = list(parents.items())
    pick.shuffle(rows)
    edges = spark.createDataFrame([*rows, *rows[:20], (101, 130), (None, 3), (8, None)], EDGES)
    found = thread_intervals(edges.repartition(1 + 2 * seed))
    wanted = walked(parents)
    nodes = by_id(found.nodes)
    assert {i: (r.thread, r.enter, r.leave) for i, r in nodes.items()} == wanted
    assert all(r.size == 1 + sum(w[0] == r.thread and r.enter < w[1] < r.leave for w in wanted.values()) for r in nodes.values())
    assert sorted(r.id for r in found.cyclic_ids.collect()) == [400, 401, 402, 403, 404]
    paths = expected(parents)
    pairs = [(pick.choice(list(paths)), pick.choice(list(paths))) for _ in range(300)] + [(59, 59), (999, 1), (5, 999), (-7, 5), (None, 1)]
    below = lies_below(spark.createDataFrame(pairs, "id long, ancestor long"), found.nodes).collect()
    assert len(below) == len(pairs)
    assert all(r.below == (r.ancestor in (paths.get(r.id) or [])) for r in below)


def test_intervals_of_no_edges_and_large_ids(spark):
    none = thread_intervals(spark.createDataFrame([], EDGES))
    assert none.nodes.count() == 0 and none.cyclic_ids.count() == 0
    with pytest.raises(Exception, match="within 2\\^60"):
        thread_intervals(spark.createDataFrame([(1 << 61, 3)], EDGES)).nodes.collect()
