"""Best-fit packing planned on the histogram of lengths.

Documents become pieces of at most ``size`` tokens. The plan sees only how many pieces of each
length there are: lengths fall from long to short, and all pieces of a length go, as counts, to the
open sequences with the least room that still fits, then to new ones. That is best-fit decreasing,
run on at most ``size`` counters, whatever the number of documents. Pieces then take the planned
slots by their rank within their length.

Null texts are empty texts (the end id alone), repeated rows are repeated documents, an empty table
gives no rows; a null ``doc_id`` stays null and its documents are told apart by their text. Extra
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.llm.common import prepared, texts
from threadlens.llm.tokens import encoder, tokenizer_path
from threadlens.operators.ranking import with_position
from threadlens.session import materialize

SIZE = 2048
END_ID = 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, tie long"


def pieces(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """Encode and cut: all pieces but the first have ``size`` tokens."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), texts(docs).alias("text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = None
        end = np.uint32(end_id).astype("<u4").tobytes()
        for batch in batches:
            encode = encode or encoder(tokenizer).encode
            out: list[tuple] = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text").to_pylist())):
                ids += end
                n = len(ids) // 4
                tie = zlib.crc32(ids)
                cuts = [0, *range(n % size or min(size, n), n + 1, size)]
                for k, (low, high) in enumerate(zip(cuts, cuts[1:])):
                    out.append((doc_id, k, low, high - low, zlib.crc32(ids[4 * low : 4 * high]), tie))
            if out:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                arrays = [pa.array(c, kind) for c, kind in zip(zip(*out), kinds)]
                yield pa.RecordBatch.from_arrays(arrays, names=[f.split(" ")[0] for f in PIECES.split(", ")])

    return rows.mapInArrow(task, PIECES)


def plan(histogram: dict[int, int], size: int = SIZE) -> np.ndarray:
    """Rows ``(first, sequence, step, offset)``: from position ``first`` on (pieces in order of falling length)
    every piece goes to the next sequence, ``step`` pieces to one, the first of them at ``offset``.

    Best-fit decreasing on counts. Sequences with equal room are runs of consecutive numbers; the runs
    are split as they fill, so the plan has a few rows for each length and amount of room.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # amount of room -> runs (first sequence, how many)
    rows, position, opened = [], 0, 0
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        for free in sorted(f for f in room if f >= length):
            # Best fit: a sequence with the least room takes pieces until it has no room for another.
            while left and room.get(free):
                first, count = room[free].pop()
                each = free // length
                full = min(count, left // each)
                if full:
                    rows.append((position, first, each, size - free, length))
                    position, left = position + full * each, left - full * each
                    room.setdefault(free - each * length, []).append((first, full))
                if full < count:
                    if left:
                        rows.append((position, first + full, left, size - free, length))
                        room.setdefault(free - left * length, []).append((first + full, 1))
                        position, left, full = position + left, 0, full + 1
                    if full < count:
                        room[free].append((first + full, count - full))
                    break
        if left:
            each = size // length
            full = left // each
            if full:
                rows.append((position, opened, each, 0, length))
                room.setdefault(size - each * length, []).append((opened, full))
                position, left, opened = position + full * each, left - full * each, opened + full
            if left:
                rows.append((position, opened, left, 0, length))
                room.setdefault(size - left * length, []).append((opened, 1))
                position, left, opened = position + left, 0, opened + 1
    return np.array(rows, dtype=np.int64).reshape(-1, 5)


def pack(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``, a row a piece."""
    spark = prepared(docs.sparkSession)
    stored = materialize(pieces(docs, tokenizer or tokenizer_path(), size), "pieces")
    # At most ``size`` counts reach the driver.
    histogram = {r["length"]: r["count"] for r in stored.groupBy("length").count().collect()}
    slots = spark.sparkContext.broadcast(plan(histogram, size))
    ranked = with_position(stored, [F.desc("length"), F.asc("doc_id"), F.asc("tie"), F.asc("piece")])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, sequences, steps, offsets, lengths = slots.value.T
        for batch in batches:
            at = batch.column("position").to_numpy()
            row = np.searchsorted(firsts, at, side="right") - 1
            behind = at - firsts[row]
            sequence = sequences[row] + behind // steps[row]
            offset = offsets[row] + behind % steps[row] * lengths[row]
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], schema=placed)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    placed = pa.schema([(n, pa.int32() if n == "piece" else pa.int64()) for n in names])
    schema = ", ".join(f"{n} {'int' if n == 'piece' else 'long'}" for n in names)
    return ranked.drop("tie").mapInArrow(place, schema)
