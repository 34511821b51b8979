"""Token counts by source, language and tokenizer version, maintained by signed deltas.

A store is a folder of committed batches. Each batch has

    ledger/batch=<id>   signed changes of single documents: (doc_id, source, lang, tokenizer, docs, tokens, bytes)
    rollup/batch=<id>   their sums by (source, lang, tokenizer)
    commits/batch=<id>  one row, written last

and only batches with a commit count. A batch that is sent again is left alone; one whose writer died
before the commit is written anew. What a document counted before is the sum of its ledger rows, so an
insert adds, a delete subtracts what is there, a revision does both, also when source or language moved,
and totals are a sum over small rollups, never a recount. Only changed texts are tokenized.

A document is its ``doc_id`` (null is an id, too). Of several changes of one id in a batch, one counts: a
delete first, else the greatest by text, source and language. Null texts are empty; deleting what is not
there changes nothing; empty batches commit; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.llm.common import prepared, texts
from threadlens.llm.tokens import encoder, tokenizer_path
from threadlens.session import scratch_path

# Tokenizer versions: a vocabulary file for the tokenizers library, or nothing for words between white space.
VERSIONS = {"byte_bpe_50k": "byte_bpe_50k.json", "words_1": ""}

LEDGER = "doc_id long, source string, lang string, tokenizer string, docs long, tokens long, bytes long"
SUMS = ("docs", "tokens", "bytes")


def count_tokens(rows: DataFrame, versions: Mapping[str, str] = VERSIONS) -> DataFrame:
    """``(doc_id, source, lang, text)`` to ledger rows that add, one for each tokenizer version."""
    files = {name: tokenizer_path(file) if file else "" for name, file in versions.items()}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = {}
        for batch in batches:
            own = batch.column("text").to_pylist()
            for name, file in files.items():
                if file and name not in encoders:
                    encoders[name] = encoder(file)
                counts = [len(ids) // 4 for ids in encoders[name].encode(own)] if file else [len(t.split()) for t in own]
                n = len(own)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id"), batch.column("source"), batch.column("lang"), pa.array([name] * n, pa.string()),
                    pa.array([1] * n, pa.int64()), pa.array(counts, pa.int64()), pa.array([len(t.encode()) for t in own], pa.int64()),
                ], names=["doc_id", "source", "lang", "tokenizer", *SUMS])

    return rows.select("doc_id", "source", "lang", "text").mapInArrow(task, LEDGER)


class TokenRollup:
    def __init__(self, spark: SparkSession, folder: str | None = None, versions: Mapping[str, str] = VERSIONS):
        self.spark, self.versions = prepared(spark), versions
        self.folder = folder or scratch_path(spark, "token-rollup")

    def _path(self, part: str, batch: str = "") -> str:
        return f"{self.folder}/{part}" + (f"/batch={batch}" if batch else "")

    def batches(self) -> list[str]:
        """Ids of the committed batches."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path("commits"))
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(path):
            return []
        done = [f.getPath() for f in files.listStatus(path)]
        marker = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(p.getName().removeprefix("batch=") for p in done if files.exists(marker(p, "_SUCCESS")))

    def _read(self, part: str, schema: str) -> DataFrame:
        paths = [self._path(part, b) for b in self.batches()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply ``(doc_id, action, text, source, lang)``, action ``upsert`` or ``delete``; False if the batch is known already."""
        if batch in self.batches():
            return False
        text = texts(changes)
        order = [F.col("action") == "delete", text, F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))]
        one = changes.groupBy(changes["doc_id"].cast("long").alias("doc_id")).agg(
            F.count(F.lit(1)).alias("n"), F.max_by(F.struct("action", text.alias("text"), "source", "lang"), F.struct(*order)).alias("change")
        ) if not self._distinct(changes) else changes.select(
            changes["doc_id"].cast("long").alias("doc_id"), F.struct("action", text.alias("text"), "source", "lang").alias("change")
        )
        added = count_tokens(one.where("change.action <> 'delete'").select("doc_id", "change.source", "change.lang", "change.text"), self.versions)
        ledger = self._read("ledger", LEDGER)
        ids = changes.select(changes["doc_id"].cast("long").alias("_id")).distinct()
        known = ledger.join(ids, ledger["doc_id"].eqNullSafe(ids["_id"]), "left_semi")
        known = known.groupBy("doc_id", "source", "lang", "tokenizer").agg(*[(-F.sum(c)).alias(c) for c in SUMS]).where("docs <> 0")
        # A version that is not in use any more keeps its rows until its documents go.
        added.union(known).write.mode("overwrite").parquet(self._path("ledger", batch))
        signed = self.spark.read.schema(LEDGER).parquet(self._path("ledger", batch))
        sums = signed.groupBy("source", "lang", "tokenizer").agg(*[F.sum(c).alias(c) for c in SUMS])
        sums.write.mode("overwrite").parquet(self._path("rollup", batch))
        done = self.spark.createDataFrame([(batch, signed.count())], "batch string, changes long")
        done.coalesce(1).write.mode("overwrite").parquet(self._path("commits", batch))
        return True

    @staticmethod
    def _distinct(changes: DataFrame) -> bool:
        """True if no id changes twice; found on the ids alone, so that texts need not be shuffled."""
        return changes.groupBy("doc_id").count().where("count > 1").isEmpty()

    def totals(self) -> DataFrame:
        """``(source, lang, tokenizer, docs, tokens, bytes)`` of what is there now."""
        rows = self._read("rollup", "source string, lang string, tokenizer string, docs long, tokens long, bytes long")
        return rows.groupBy("source", "lang", "tokenizer").agg(*[F.sum(c).alias(c) for c in SUMS]).where("docs <> 0")


def changes(docs: DataFrame, action: str = "upsert") -> DataFrame:
    return docs.select("doc_id", F.lit(action).alias("action"), "text", "source", "lang")


def maintained_counts(docs: DataFrame) -> DataFrame:
    """Totals after three batches: all documents come in; exact copies go, the smallest id stays; texts that
    repeat a line are revised to hold each line once. The last batch is sent twice, and counts once."""
    rollup = TokenRollup(docs.sparkSession)
    rollup.commit("load", changes(docs))
    text = F.xxhash64(texts(docs)).alias("h"), F.length(texts(docs)).alias("n")
    first = docs.groupBy(*text).agg(F.min("doc_id").alias("first"))
    ids = docs.select("doc_id", *text).join(first, ["h", "n"]).where("doc_id > first").select("doc_id").distinct()
    gone = ids.select("doc_id", F.lit("delete").alias("action"), *[F.lit(None).cast("string").alias(c) for c in ("text", "source", "lang")])
    rollup.commit("copies", gone)
    left = docs.join(ids, "doc_id", "left_anti")
    once = F.array_join(F.array_distinct(F.split("text", "\n")), "\n")
    revised = changes(left.withColumn("revised", once).where("revised <> text").withColumn("text", F.col("revised")))
    rollup.commit("lines", revised)
    rollup.commit("lines", revised)
    return rollup.totals()
