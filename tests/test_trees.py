"""Node tables against Spark's own predictions and a plain walk."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadlens.operators import forests, trees

DIM = 6


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(8)
    rows = rng.normal(size=(400, DIM)).astype(np.float32)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "id long, vec array<float>")
    return rows, vectors


@pytest.mark.parametrize("classes", [False, True])
def test_trained_forest(spark, data, classes):
    rows, vectors = data
    label = (F.col("vec")[0] + F.col("vec")[1] > 0).cast("double") if classes else F.col("vec")[0] * 2 - F.col("vec")[3]
    labelled = vectors.select("id", label.cast("double").alias("label"), "vec")
    forest = forests._vector_forest(labelled, forests.classifier() if classes else forests.regressor(), 1)
    nodes = trees.forest_nodes(forest.model)
    assert nodes.select("tree").distinct().count() == (3 if classes else 5)
    found = {r.id: r.prediction for r in trees.predict_by_nodes(nodes, vectors, classes).collect()}
    own = {r.id: r.prediction for r in forests.predict(forest.model, vectors).collect()}
    assert found.keys() == own.keys() and all(abs(found[i] - own[i]) < 1e-9 for i in own)


def test_uneven_tree_and_edges(spark, data):
    rows, vectors = data
    table = [
        (0, 0, 2, 0.1, 1, 2, None), (0, 1, None, None, -1, -1, 5.0), (0, 2, 4, -0.2, 7, 9, None), (0, 7, None, None, -1, -1, 6.0),
        (0, 9, 1, 0.0, 11, 12, None), (0, 11, None, None, -1, -1, 7.0), (0, 12, None, None, -1, -1, 8.0), (4, 0, None, None, -1, -1, 1.0),
    ]
    nodes = spark.createDataFrame(table, trees.NODES)
    found = {r.id: r.prediction for r in trees.predict_by_nodes(nodes, vectors.union(spark.createDataFrame([(999, None)], vectors.schema))).collect()}
    for i, v in enumerate(rows.astype(float)):
        one = 5.0 if v[2] <= 0.1 else 6.0 if v[4] <= -0.2 else 7.0 if v[1] <= 0 else 8.0
        assert found[i] == (one + 1.0) / 2
    assert found[999] is None
    empty = trees.predict_by_nodes(nodes.limit(0), vectors)
    assert empty.where("prediction IS NOT NULL").count() == 0 and empty.count() == 400
