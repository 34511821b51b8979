"""The changing vector index against a plain dictionary."""

import numpy as np
from pyspark.sql import functions as F

from threadlens.operators import similarity
from threadlens.operators.vector_index import VectorIndex

DIM = 6


def test_changes_and_compaction(spark, tmp_path):
    rng = np.random.default_rng(3)
    held = {i: rng.normal(size=DIM).astype(np.float32).tolist() for i in range(60)}

    def frame(rows):
        return spark.createDataFrame(list(rows.items()), "id long, vec array<float>")

    def check(index):
        rows = {r.id: (r.vec, r.bucket) for r in index.rows().collect()}
        assert rows.keys() == held.keys() and index.rows().count() == len(held)
        for i, vec in held.items():
            assert rows[i][0] == vec
            side = None if vec is None else "".join("1" if x > 0 else "0" for x in np.array(vec, np.float64) @ planes.T)
            assert rows[i][1] == side

    planes = similarity.hyperplanes(4, DIM)
    index = VectorIndex.create(frame(held), planes, str(tmp_path / "index"))
    check(index)
    new = {i: rng.normal(size=DIM).astype(np.float32).tolist() for i in (3, 4, 100, 101)}
    index.upsert("first", frame(new))
    held |= new
    check(index)
    index.delete("gone", spark.createDataFrame([(4,), (50,), (999,), (4,)], "id long"))
    for i in (4, 50):
        del held[i]
    index.upsert("first", frame({7: [0.0] * DIM}))  # the name counts once
    check(index)
    again = {4: [1.0] * DIM, 5: None}
    index.upsert("again", frame(again))
    held |= again
    check(index)
    before = index.rows()
    index.compact()
    check(VectorIndex.open(spark, str(tmp_path / "index")))
    assert before.count() == len(held)  # readers of the old base go on
    index.delete("later", spark.createDataFrame([(5,)], "id long"))
    del held[5]
    check(index)
    index.compact()
    check(index)
    asked = frame({0: held[0]}).withColumnRenamed("id", "request_id")
    best = similarity.nearest_by_hash(asked, index.rows().where(F.col("vec").isNotNull()), planes, k=1).first()
    assert best is not None
