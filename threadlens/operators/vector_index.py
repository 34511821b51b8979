"""A vector index that takes changes: a sorted base, and deltas of upserts and deletes beside it.

Every change is a table of its own, written whole before its commit row names it, so a lost writer leaves nothing behind
that readers see, and a change that is committed twice under one name counts once. Readers take the base and all
committed changes; of each id the newest version holds, found by partial aggregation, and deleted ids go. Compaction
writes that state as a new base, sorted by bucket and id, and names it in one commit row; readers of the old one are
not disturbed. Changes that compaction took in are skipped from then on.

Layout below the index's folder: ``planes``, ``data/<name>`` (rows of a base or a change) and ``commits``, a parquet folder
to which every commit appends one row (number, name, kind, taken): ``taken`` is the last change inside a base.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlens.operators.similarity import with_bucket
from threadlens.session import materialize

COMMIT = "number long, name string, kind string, taken long, folder string"


class VectorIndex:
    """``rows()`` is ``(id, vec, bucket)``, what the similarity searches take as their index.

    One writer at a time; readers at any time. Vectors of a change may be NULL: the id stays, without neighbours.
    """

    def __init__(self, spark: SparkSession, path: str, planes: np.ndarray):
        self.spark, self.path, self.planes = spark, path.rstrip("/"), planes

    @classmethod
    def create(cls, vectors: DataFrame, planes: np.ndarray, path: str) -> VectorIndex:
        """A new index on ``(id, vec)``; ids are unique."""
        index = cls(vectors.sparkSession, path, planes)
        config = [(i, [float(x) for x in plane]) for i, plane in enumerate(planes)]
        index.spark.createDataFrame(config, "bit int, plane array<double>").coalesce(1).write.parquet(f"{index.path}/planes")
        index._commit(0, "base", "base", 0, index._write(with_bucket(vectors.select("id", "vec"), planes), sort=True))
        return index

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> VectorIndex:
        rows = spark.read.parquet(f"{path.rstrip('/')}/planes").orderBy("bit").collect()
        return cls(spark, path, np.array([r["plane"] for r in rows]))

    def _write(self, rows: DataFrame, sort: bool = False) -> str:
        folder = uuid.uuid4().hex
        if sort:
            rows = rows.repartitionByRange("bucket", "id").sortWithinPartitions("bucket", "id")
        rows.write.parquet(f"{self.path}/data/{folder}")
        return folder

    def _commit(self, number: int, name: str, kind: str, taken: int, folder: str) -> None:
        row = [(number, name, kind, taken, folder)]
        self.spark.createDataFrame(row, COMMIT).coalesce(1).write.mode("append").parquet(f"{self.path}/commits")

    def commits(self) -> list:
        """One small row a change or compaction, in order; of a name that was committed twice the first counts."""
        found, names = [], set()
        rows = self.spark.read.schema(COMMIT).parquet(f"{self.path}/commits").collect()
        for r in sorted(rows, key=lambda r: (r["number"], r["folder"])):
            if (r["kind"], r["name"]) not in names:
                names.add((r["kind"], r["name"]))
                found.append(r)
        return found

    def _change(self, name: str, rows: DataFrame) -> None:
        done = self.commits()
        if any(r["kind"] == "change" and r["name"] == name for r in done):
            return
        number = 1 + max(r["number"] for r in done)
        self._commit(number, name, "change", 0, self._write(rows))

    def upsert(self, name: str, vectors: DataFrame) -> None:
        """New or other vectors for ``(id, vec)``; of an id that comes twice in one change the greater vector holds."""
        own = vectors.groupBy("id").agg(F.max("vec").alias("vec"))
        self._change(name, with_bucket(own, self.planes).withColumn("gone", F.lit(False)))

    def delete(self, name: str, ids: DataFrame) -> None:
        """Ids that leave the index; unknown ones change nothing."""
        nothing = [F.lit(None).cast("array<float>").alias("vec"), F.lit(None).cast("string").alias("bucket"), F.lit(True).alias("gone")]
        self._change(name, ids.select("id").distinct().select("id", *nothing))

    def _state(self) -> tuple[DataFrame, int]:
        done = self.commits()
        base = max((r for r in done if r["kind"] == "base"), key=lambda r: r["number"])
        rows = self.spark.read.parquet(f"{self.path}/data/{base['folder']}").select("id", "vec", "bucket")
        changes = [r for r in done if r["kind"] == "change" and r["number"] > base["taken"]]
        if not changes:
            return rows, base["taken"]
        versions = None
        for r in changes:
            part = self.spark.read.parquet(f"{self.path}/data/{r['folder']}").select("id", "vec", "bucket", "gone", F.lit(r["number"]).alias("version"))
            versions = part if versions is None else versions.union(part)
        newest = materialize(
            versions.groupBy("id").agg(F.max_by(F.struct("vec", "bucket", "gone"), "version").alias("last")).select("id", "last.*"), "newest"
        )
        # Changes are few beside the base: it is scanned, and only ids that changed leave it.
        kept = rows.join(newest.select("id"), "id", "left_anti")
        return kept.union(newest.where("NOT gone").select("id", "vec", "bucket")), changes[-1]["number"]

    def rows(self) -> DataFrame:
        return self._state()[0]

    def compact(self) -> None:
        """Take all committed changes into a new sorted base."""
        rows, taken = self._state()
        number = 1 + max(r["number"] for r in self.commits())
        self._commit(number, f"base-{number}", "base", taken, self._write(rows, sort=True))
