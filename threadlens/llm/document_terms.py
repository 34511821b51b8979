"""Sparse document-term matrix: a global dictionary of words and compressed sparse rows in shards.

Words are maximal runs without ASCII white space, as bytes. A row of the matrix is a text, named by its SHA-256; texts
are read and cut into words once.

1. Each task builds shards of about SHARD_TERMS nonzeros: row starts, columns and counts, with columns numbered inside
   the shard. The words of a shard leave it in buckets by their hash, one compressed record a bucket.
2. A bucket meets the words of all shards, a word at most once a shard however many rows hold it. Its distinct words in
   order are its part of the dictionary: a word's number is its bucket (upper 32 bits) and its place there, so numbers
   are global and the same after any lost task. A bucket answers each shard with its words' places.
3. Answers and shards meet by shard, and columns get their global numbers.

A row lies whole in one shard, so its sum and its number of nonzeros are those of the shard's row. The number of buckets
follows from the number of documents, so a bucket's words stay bounded.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.llm.common import prepared, texts
from threadlens.session import materialize

SHARD_TERMS = 1 << 20
BUCKET_DOCUMENTS = 4096  # documents a bucket of words
BETWEEN = b"\n"  # no word holds it

CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MARKS = b"#$%&*|"
CAPITALS_PERCENT = 5

ROWS = "rows array<struct<digest:binary,capitals:boolean,marks:boolean>>"
ROW_TYPE = pa.list_(pa.struct([("digest", pa.binary()), ("capitals", pa.bool_()), ("marks", pa.bool_())]))
LOCAL = {"shard": pa.int64(), "bucket": pa.int32(), "words": pa.binary(), "rows": ROW_TYPE, "indptr": pa.binary(), "columns": pa.binary(), "counts": pa.binary()}
LOCAL_SCHEMA = f"shard long, bucket int, words binary, {ROWS}, indptr binary, columns binary, counts binary"


def digest(docs: DataFrame) -> Column:
    """The name of a text: its SHA-256; null counts as empty."""
    return F.unhex(F.sha2(texts(docs).cast("binary"), 256))


def _records(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], kind) for c, kind in LOCAL.items()], names=list(LOCAL))


class _Shard:
    """Rows under construction; columns are numbered as their words come."""

    def __init__(self, number: int, buckets: int):
        self.number, self.buckets = number, buckets
        self.local: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.rows: list[dict] = []
        self.columns: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.held = 0

    def add(self, name: bytes, text: bytes, length: int) -> None:
        own = Counter(text.split())
        self.columns.append(np.fromiter(map(self.local.__getitem__, own), np.int64, len(own)))
        self.counts.append(np.fromiter(own.values(), "<u4", len(own)))
        capitals = 100 * (len(text) - len(text.translate(None, CAPITALS))) > CAPITALS_PERCENT * length
        self.rows.append({"digest": name, "capitals": capitals, "marks": len(text.translate(None, MARKS)) < len(text)})
        self.held += len(own)

    def records(self) -> pa.RecordBatch:
        """The shard (bucket -1) and its words by bucket. Columns are renumbered in the order in which buckets answer."""
        words = list(self.local)
        bucket = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % self.buckets
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(words), "<u4")
        place[order] = np.arange(len(words))
        named, starts = np.unique(bucket[order], return_index=True)
        ends, order = np.append(starts, len(words))[1:], order.tolist()
        out = [
            {"shard": self.number, "bucket": b, "words": zlib.compress(BETWEEN.join([words[i] for i in order[low:high]]), 1)}
            for b, low, high in zip(named.tolist(), starts.tolist(), ends.tolist())
        ]
        indptr = np.cumsum([0, *map(len, self.columns)]).astype("<u4")
        columns = place[np.concatenate(self.columns)]
        out.append({
            "shard": self.number, "bucket": -1, "rows": self.rows, "indptr": indptr.tobytes(), "columns": columns.tobytes(),
            "counts": np.concatenate(self.counts).tobytes(),
        })
        return _records(out)


def _local_shards(docs: DataFrame, buckets: int) -> DataFrame:
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        shard = _Shard(number, buckets)
        for batch in batches:
            column = batch.column("text")
            lengths = pc.utf8_length(column.cast(pa.string())).to_pylist()
            for row in zip(batch.column("digest").to_pylist(), column.to_pylist(), lengths):
                shard.add(*row)
                if shard.held >= SHARD_TERMS:
                    yield shard.records()
                    number += 1
                    shard = _Shard(number, buckets)
        if shard.rows:
            yield shard.records()

    named = docs.select(digest(docs).alias("digest"), texts(docs).cast("binary").alias("text"))
    return named.mapInArrow(build, LOCAL_SCHEMA)


def _numbered(words: DataFrame) -> DataFrame:
    """``(bucket, shard, places, dictionary)``: a bucket's answer to each shard, and its words in order (shard null)."""
    dealt = words.repartition("bucket").sortWithinPartitions("bucket", "shard")

    def answers(bucket: int, asked: list[tuple[int, bytes]]) -> pa.RecordBatch:
        distinct: set[bytes] = set()
        for _, blob in asked:
            distinct.update(zlib.decompress(blob).split(BETWEEN))
        ordered = sorted(distinct)
        number = dict(zip(ordered, range(len(ordered)))).__getitem__
        places = [np.array(list(map(number, zlib.decompress(blob).split(BETWEEN))), "<u4").tobytes() for _, blob in asked]
        shards = [s for s, _ in asked]
        return pa.RecordBatch.from_arrays(
            [pa.array([bucket] * (len(asked) + 1), pa.int32()), pa.array([*shards, None], pa.int64()), pa.array([*places, None], pa.binary()),
             pa.array([None] * len(asked) + [zlib.compress(BETWEEN.join(ordered), 1)], pa.binary())],
            names=["bucket", "shard", "places", "dictionary"],
        )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, last = [], None
        for batch in batches:
            for bucket, shard, blob in zip(*(batch.column(c).to_pylist() for c in ("bucket", "shard", "words"))):
                if bucket != last and asked:
                    yield answers(last, asked)
                    asked = []
                last = bucket
                asked.append((shard, blob))
        if asked:
            yield answers(last, asked)

    return dealt.mapInArrow(task, "bucket int, shard long, places binary, dictionary binary")


def _global_shards(shards: DataFrame, answers: DataFrame) -> DataFrame:
    """Shards whose columns have global numbers."""
    nothing = {"rows": F.lit(None).cast(ROWS[5:]), "indptr": F.lit(None).cast("binary"), "columns": F.lit(None).cast("binary"), "counts": F.lit(None).cast("binary")}
    given = answers.where("shard IS NOT NULL").select("shard", "bucket", "places", *[c.alias(n) for n, c in nothing.items()])
    # A shard's answers come before it, in order of buckets.
    own = shards.select("shard", F.lit(2**31 - 1).alias("bucket"), F.lit(None).cast("binary").alias("places"), *nothing)
    dealt = given.union(own).repartition("shard").sortWithinPartitions("shard", "bucket")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: list[np.ndarray] = []
        for batch in batches:
            whole = batch.column("rows").is_valid().to_pylist()
            for i, (shard, bucket, places) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("shard", "bucket", "places")))):
                if not whole[i]:
                    numbers.append(np.frombuffer(places, "<u4").astype("<i8") + (bucket << 32))
                    continue
                row = batch.slice(i, 1)
                local = np.frombuffer(row.column("columns")[0].as_py(), "<u4")
                terms = np.concatenate(numbers)[local] if numbers else local.astype("<i8")
                numbers = []
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard], pa.int64()), row.column("rows"), row.column("indptr"), pa.array([terms.tobytes()], pa.binary()), row.column("counts")],
                    names=["shard", "rows", "indptr", "terms", "counts"],
                )

    return dealt.mapInArrow(task, f"shard long, {ROWS}, indptr binary, terms binary, counts binary")


def document_terms(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The dictionary ``(bucket, dictionary)`` and the shards ``(shard, rows, indptr, terms, counts)`` of the matrix.

    ``terms`` are little-endian 64-bit numbers, ``indptr`` and ``counts`` unsigned 32-bit ones. Null texts are empty and
    have a row without nonzeros; repeated texts repeat their row; an empty table has neither shards nor words.
    """
    prepared(docs.sparkSession)
    buckets = max(1, -(-docs.count() // BUCKET_DOCUMENTS))
    local = materialize(_local_shards(docs, buckets), "local-shards")
    answers = materialize(_numbered(local.where("bucket >= 0").select("bucket", "shard", "words")), "words")
    words = answers.where("shard IS NULL").select("bucket", "dictionary")
    return words, _global_shards(local.where("bucket < 0"), answers)


def words_of(dictionary: bytes) -> list[bytes]:
    """The words of one bucket of the dictionary, by their places."""
    return zlib.decompress(dictionary).split(BETWEEN)


def row_statistics(shards: DataFrame) -> DataFrame:
    """``(digest, words, distinct, capitals, marks)``: row sums, nonzeros and flags of each distinct text."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, indptr, counts in zip(*batch.columns):
                at = np.frombuffer(indptr.as_py(), "<u4").astype(np.int64)
                total = np.concatenate([[0], np.cumsum(np.frombuffer(counts.as_py(), "<u4"), dtype=np.int64)])
                own = rows.values
                yield pa.RecordBatch.from_arrays(
                    [own.field("digest"), pa.array(total[at[1:]] - total[at[:-1]]), pa.array(np.diff(at)), own.field("capitals"), own.field("marks")],
                    names=["digest", "words", "distinct", "capitals", "marks"],
                )

    own = shards.select("rows", "indptr", "counts").mapInArrow(sums, "digest binary, words long, distinct long, capitals boolean, marks boolean")
    # Copies of a text have equal rows.
    return own.groupBy("digest").agg(*[F.max(c).alias(c) for c in ("words", "distinct", "capitals", "marks")])
