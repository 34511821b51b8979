"""Connected components of a graph given as edges, by contraction in rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.session import materialize

JUMPS = 2  # steps along the roots found in one round


def components(edges: DataFrame) -> DataFrame:
    """``(u, v)`` edges to ``(node, root)`` for every node that has one; equal roots, same component.

    Each round, every node points to the neighbour (or itself) whose hash is smallest, pointers are
    followed a few steps, and edges are moved to what their ends point to. Hashes make the order of
    names irrelevant, so a constant share of nodes goes each round, in chains and stars alike. A node
    with many edges only ever meets one aggregated row of its own: no group is collected.
    """
    left = materialize(edges.select("u", "v").where("u <> v").distinct(), "edges")
    roots = None
    while not left.isEmpty():
        both = left.union(left.select("v", "u"))
        own = F.struct(F.xxhash64("u").alias("h"), F.col("u").alias("id"))
        near = F.struct(F.xxhash64("v").alias("h"), F.col("v").alias("id"))
        least = both.groupBy("u").agg(F.least(F.first(own), F.min(near)).alias("m"))
        step = materialize(least.select(F.col("u").alias("node"), F.col("m.id").alias("root")), "least")
        for _ in range(JUMPS):
            further = step.select(F.col("node").alias("root"), F.col("root").alias("further"))
            step = step.join(further, "root", "left").select("node", F.coalesce("further", "root").alias("root"))
        step = materialize(step, "step")
        if roots is None:
            roots = step
        else:
            moved = step.select(F.col("node").alias("root"), F.col("root").alias("further"))
            roots = materialize(roots.join(moved, "root", "left").select("node", F.coalesce("further", "root").alias("root")), "roots")
        ends = left
        for end in ("u", "v"):
            ends = ends.join(step.select(F.col("node").alias(end), F.col("root").alias(f"new_{end}")), end, "left")
        ends = ends.select(F.coalesce("new_u", "u").alias("u"), F.coalesce("new_v", "v").alias("v"))
        pair = ends.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        left = materialize(pair.distinct(), "edges")
    return roots if roots is not None else left.select(F.col("u").alias("node"), F.col("v").alias("root"))
