"""Forests as tables of nodes, and prediction from such a table.

A node is a row ``(tree, node, feature, threshold, left, right, value)``: a vector goes left where its feature is at most
the threshold; a leaf has no children (-1) and a value, which is the tree's answer or, for two classes, its share of
class 1. Any engine that reads rows can predict with it, and a table need not come from training.

A model is a few rows a tree, bounded by 2^(depth + 1). It becomes literal arrays in one expression a tree, so prediction
is a projection: no join, no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.session import scratch_path

NODES = "tree int, node int, feature int, threshold double, left int, right int, value double"


def forest_nodes(model: PipelineModel) -> DataFrame:
    """The nodes of a trained forest, from Spark's own stored form of it."""
    forest = model.stages[-1]
    spark = SparkSession.getActiveSession()
    path = scratch_path(spark, "trees")
    forest.write().save(path)
    rows = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    stats = F.col("impurityStats")
    value = stats[1] / (stats[0] + stats[1]) if hasattr(forest, "numClasses") else F.col("prediction")
    leaf = F.col("leftChild") < 0
    return rows.select(
        F.col("treeID").alias("tree"), F.col("id").alias("node"), F.col("split.featureIndex").alias("feature"),
        F.when(~leaf, F.element_at("split.leftCategoriesOrThreshold", 1)).alias("threshold"),
        F.col("leftChild").alias("left"), F.col("rightChild").alias("right"), F.when(leaf, value).alias("value"),
    )


def _depth(rows: dict[int, tuple]) -> int:
    """Steps from the root, node 0, to the farthest leaf."""
    depth, level = 0, [0]
    while level := [child for n in level for child in rows[n][2:4] if child >= 0]:
        depth += 1
    return depth


def _answer(rows: dict[int, tuple], vec: Column) -> Column:
    """One tree: from the root, as many steps as it is deep; a leaf stays where it is."""
    order = sorted(rows)
    place = {n: i for i, n in enumerate(order)} | {-1: -1}
    leaf = [rows[n][2] < 0 for n in order]

    def literal(values: list) -> Column:
        return F.array(*map(F.lit, values))

    feature = literal([0 if end else rows[n][0] for n, end in zip(order, leaf)])
    threshold = literal([0.0 if end else float(rows[n][1]) for n, end in zip(order, leaf)])
    left, right = (literal([i if end else place[rows[n][side]] for i, (n, end) in enumerate(zip(order, leaf))]) for side in (2, 3))
    value = literal([float(rows[n][4]) if end else 0.0 for n, end in zip(order, leaf)])
    node = F.lit(place[0])
    if depth := _depth(rows):
        node = F.aggregate(
            F.sequence(F.lit(1), F.lit(depth)), F.lit(place[0]),
            lambda at, _: F.when(F.get(vec, F.get(feature, at)) <= F.get(threshold, at), F.get(left, at)).otherwise(F.get(right, at)),
        )
    return F.get(value, node)


def predict_by_nodes(nodes: DataFrame, vectors: DataFrame, classes: bool = False) -> DataFrame:
    """``(id, prediction)`` for ``(id, vec)``: the mean of the trees' values or, with ``classes``, 1 where that is over a half.

    An empty table predicts nothing: NULL, as does a NULL vector.
    """
    trees: dict[int, dict[int, tuple]] = {}
    for r in nodes.select("tree", "node", "feature", "threshold", "left", "right", "value").collect():
        trees.setdefault(r["tree"], {})[r["node"]] = (r["feature"], r["threshold"], r["left"], r["right"], r["value"])
    vec = F.col("vec").cast("array<double>")
    if not trees:
        return vectors.select("id", F.lit(None).cast("double").alias("prediction"))
    mean = sum((_answer(trees[t], vec) for t in sorted(trees)), F.lit(0.0)) / len(trees)
    answer = F.when(mean > 0.5, 1.0).otherwise(0.0) if classes else mean
    return vectors.select("id", F.when(F.col("vec").isNotNull(), answer).alias("prediction"))
