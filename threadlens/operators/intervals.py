"""Threads as intervals: every node gets the numbers at which a walk through its thread enters and leaves it.

The walk visits a node, then its children by id, each with all below it. Its steps are a linked list of two elements a
node, and its numbers are found by list ranking: each element names the one before it, and following these links by
the rounds of ``threads`` gives the distance from the start, which is the number. State is four numbers a row at any
depth, and no link is popular: an element precedes one other at most, however many children a node has.

"Lies below" is then a comparison of numbers, and the size of a subtree a difference, without any path.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.operators.ranking import with_position
from threadlens.operators.threads import _links, _resolve, _roots
from threadlens.session import materialize

LARGEST_ID = 1 << 60


class Intervals(NamedTuple):
    """``nodes`` (id, thread, enter, leave, size); ``cyclic_ids`` holds those that no root leads to."""

    nodes: DataFrame
    cyclic_ids: DataFrame


def _entering(node: Column) -> Column:
    """The element of entering a node: positive and even, whatever the sign of the id."""
    number = F.when(node > 0, F.shiftleft(node, 2)).otherwise(2 - F.shiftleft(node, 2))
    return F.when(F.abs(node) >= LARGEST_ID, F.raise_error(F.lit("ids must be within 2^60")).cast("bigint")).otherwise(number)


def _leaving(node: Column) -> Column:
    return _entering(node) + 1


def _node(element: Column) -> Column:
    even = element - F.pmod(element, F.lit(2))
    return F.when(F.pmod(even, F.lit(4)) == 0, F.shiftright(even, 2)).otherwise(F.shiftright(2 - even, 2))


def _walk(links: DataFrame, roots: DataFrame) -> DataFrame:
    """``(id, hop)``: the element before each one; entering a root has none."""
    placed = with_position(links.select("id", "hop"), [F.col("hop"), F.col("id")], "place")
    before = placed.select(F.col("id").alias("sibling"), F.col("hop").alias("its_parent"), (F.col("place") + 1).alias("place"))
    parent, sibling = F.col("hop"), F.col("sibling")
    enters = placed.join(before, "place", "left").select(
        _entering(F.col("id")).alias("id"),
        F.when(F.col("its_parent") == parent, _leaving(sibling)).otherwise(_entering(parent)).alias("hop"),
    )
    last = links.groupBy(F.col("hop").alias("id")).agg(F.max("id").alias("child"))
    leaves = links.select("id").union(roots).join(last, "id", "left").select(
        _leaving(F.col("id")).alias("id"), F.coalesce(_leaving(F.col("child")), _entering(F.col("id"))).alias("hop")
    )
    return enters.union(leaves)


def thread_intervals(edges: DataFrame) -> Intervals:
    """``(id, thread, enter, leave, size)`` of every endpoint of ``edges`` (id, parent).

    ``thread`` is the root's id, also for the root itself. A walk enters its root at 0; ``size`` counts a node and all
    below it. A child of several edges takes its smallest parent, and only positive ids can be parents, as for paths.
    Ids must lie within 2^60.
    """
    links = materialize(_links(edges, False), "interval-links")
    roots = materialize(_roots(edges, links), "interval-roots")
    steps = _walk(links, roots).withColumns({"depth": F.lit(1).cast("bigint"), "done": F.lit(False)})
    finished, endless = _resolve(materialize(steps, "interval-walk"), False, None)
    starts = roots.select(_entering(F.col("id")).alias("id"), _entering(F.col("id")).alias("hop"), F.lit(0).cast("bigint").alias("depth"))
    ranked = finished.select("id", "hop", "depth").union(starts)
    entering = F.pmod("id", F.lit(2)) == 0
    numbers = ranked.groupBy(_node(F.col("id")).alias("id")).agg(
        _node(F.min("hop")).alias("thread"),
        F.min(F.when(entering, F.col("depth"))).alias("enter"),
        F.min(F.when(~entering, F.col("depth"))).alias("leave"),
    )
    cyclic = endless.where(entering).select(_node(F.col("id")).alias("id"))
    size = F.shiftright(F.col("leave") - F.col("enter") + 1, 1)
    return Intervals(numbers.withColumn("size", size), cyclic)


def lies_below(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``pairs`` (id, ancestor) with ``below``: whether ``ancestor`` is on the way from ``id`` to its root.

    A node does not lie below itself; ids without an interval lie below nothing. ``nodes`` has one row an id, so only
    the pairs can be skewed, which AQE splits.
    """
    own = nodes.select("id", "thread", "enter", "leave")
    other = nodes.select(
        F.col("id").alias("ancestor"), F.col("thread").alias("_thread"), F.col("enter").alias("_enter"), F.col("leave").alias("_leave")
    )
    inside = (F.col("thread") == F.col("_thread")) & (F.col("enter") > F.col("_enter")) & (F.col("leave") < F.col("_leave"))
    return (
        pairs.join(own, "id", "left").join(other, "ancestor", "left")
        .select("id", "ancestor", F.coalesce(inside, F.lit(False)).alias("below"))
    )
