"""Comment threads: edges, full ancestor paths, roots.

Paths are built by taking over the paths of known ancestors: after round r every node knows its
nearest 4^r ancestors, so a thread of depth d needs about log4(d) rounds.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.session import materialize

LOOKUPS_A_ROUND = 3


class Threads(NamedTuple):
    """``nodes`` holds every endpoint of an edge; ``cyclic_ids`` those without a root."""

    nodes: DataFrame
    cyclic_ids: DataFrame


def thread_edges(items: DataFrame) -> DataFrame:
    """``(id, parent)`` of every item whose parent is itself present.

    A semi join keeps repeated ids from multiplying edges, and ids are reduced to distinct ones
    before their shuffle. A popular parent is then large on one side only, which AQE splits.
    """
    children = items.where("parent IS NOT NULL").select("id", "parent")
    present = items.select(F.col("id").alias("parent")).distinct()
    return children.join(present, "parent", "left_semi").select("id", "parent")


def _links(edges: DataFrame, with_path: bool) -> DataFrame:
    """One row a child, its parent as the first hop.

    Ids of zero or less are not usable as ancestors. A child named by several edges takes its
    smallest parent, so that reruns agree.
    """
    links = edges.where("parent > 0 AND id IS NOT NULL").groupBy("id").agg(F.min("parent").alias("hop"))
    links = links.select("id", "hop", F.lit(1).cast("bigint").alias("depth"), F.lit(False).alias("done"))
    return links.withColumn("path", F.array("hop")) if with_path else links


def _lookup(known: DataFrame, with_path: bool) -> DataFrame:
    return known.where("id > 0").select(
        F.col("id").alias("next_id"),
        F.col("hop").alias("next_hop"),
        F.col("depth").alias("next_depth"),
        F.col("done").alias("next_done"),
        *([F.col("path").alias("next_path")] if with_path else []),
    )


def _advance(state: DataFrame, ahead: DataFrame, with_path: bool, max_path: int | None) -> DataFrame:
    """Every live row takes over the path of its hop; a hop without a row is a root.

    ``ahead`` has one row an id, so only the state side can be skewed (a popular hop), which AQE
    splits. Finished rows look up a number of their own that nothing has, to stay spread out.
    """
    key = F.when(F.col("done"), -F.abs("id")).otherwise(F.col("hop"))
    found = F.col("next_id").isNotNull()
    columns = [
        F.col("id"),
        F.coalesce("next_hop", "hop").alias("hop"),
        (F.col("depth") + F.coalesce("next_depth", F.lit(0))).alias("depth"),
        (F.col("done") | ~found | F.coalesce("next_done", F.lit(False))).alias("done"),
    ]
    if with_path:
        # The nearest ancestors are the last ones of the list.
        path = F.concat("next_path", "path")
        if max_path is not None:
            surplus = F.size("next_path") + F.size("path") - max_path
            path = F.when(surplus > 0, F.slice(path, surplus + 1, max_path)).otherwise(path)
        columns.append(F.when(found, path).otherwise(F.col("path")).alias("path"))
    return state.join(ahead, key == F.col("next_id"), "left").select(*columns)


def _resolve(links: DataFrame, with_path: bool, max_path: int | None) -> tuple[DataFrame, DataFrame]:
    """Follow all hops to the end; returns the finished rows and those that never finish.

    A round makes three lookups in the same table, which multiplies the known ancestors by four
    for one shuffle of that table. Each round is stored, so plans do not grow and lost executors
    cost one round at most.
    """
    live, finished = links, None
    while True:
        known = live if finished is None else finished.unionByName(live)
        ahead = _lookup(known, with_path)
        state = live
        for _ in range(LOOKUPS_A_ROUND):
            state = _advance(state, ahead, with_path, max_path)
        stored = materialize(state, "thread-round", partition_by="done")
        new, live = stored.where("done"), stored.where("NOT done")
        finished = new if finished is None else finished.unionByName(new)
        # The flag is a partition column: an empty side has no files to look into. Depths along a
        # thread have no gaps, so a round that finishes nobody leaves only cycles and the nodes
        # that hang off them.
        if live.isEmpty() or new.isEmpty():
            return finished, live


def _roots(edges: DataFrame, links: DataFrame) -> DataFrame:
    """Ids of the endpoints without a usable parent; every other endpoint is in ``links``."""
    ends = edges.select(F.col("parent").alias("id")).union(edges.where("parent <= 0").select("id"))
    return ends.where("id IS NOT NULL").distinct().join(links.select("id"), "id", "left_anti")


def thread_ancestors(edges: DataFrame, max_path: int | None = None) -> Threads:
    """``(id, root, depth, path)``, the path root first and the parent last.

    With ``max_path`` nodes keep that many nearest ancestors at most, and a column ``truncated`` says which ones lost
    some; root and depth are the true ones all the same.
    """
    links = materialize(_links(edges, True), "thread-links")
    finished, endless = _resolve(links, True, max_path)
    roots = _roots(edges, links).select(
        "id",
        F.lit(None).cast("bigint").alias("root"),
        F.lit(0).cast("bigint").alias("depth"),
        F.array().cast("array<bigint>").alias("path"),
    )
    nodes = finished.select("id", F.col("hop").alias("root"), "depth", "path").union(roots)
    if max_path is not None:
        nodes = nodes.withColumn("truncated", F.col("depth") > F.size("path"))
    return Threads(nodes, endless.select("id"))


def thread_roots(edges: DataFrame) -> Threads:
    """``(id, root, depth)`` without paths: the state stays four numbers wide at any depth."""
    links = materialize(_links(edges, False), "thread-links")
    finished, endless = _resolve(links, False, None)
    roots = _roots(edges, links).select(
        "id", F.lit(None).cast("bigint").alias("root"), F.lit(0).cast("bigint").alias("depth")
    )
    return Threads(finished.select("id", F.col("hop").alias("root"), "depth").union(roots), endless.select("id"))
