"""Token ids in binary files of patched frame-of-reference blocks.

A file holds the ids of whole documents, one after the other. Its parts, all little-endian:

    magic                     8 bytes
    blocks                    BLOCK ids each, the last one shorter
    block index               where each block starts (uint64)
    document index            doc_id (int64), flag of a null doc_id (uint8), number of ids (uint64)
    trailer                   number of blocks and documents, place of the block index (uint64), magic

    block: minimum (uint32), ids (uint16), exceptions (uint16), width (uint8), 7 bytes unused,
           ids minus the minimum packed at that width in words of 64 bits,
           exceptions' places (uint16) and whole differences (uint32), padded to 8 bytes

The width is the bit length of a chosen percentile of a block's differences; wider differences are
exceptions. Any block can be read alone through the index.

Documents are range-partitioned by ``(doc_id, text)`` and sorted, and every task streams its range
into files of its own through ``pyarrow.fs`` (local or mounted paths, HDFS, S3, GCS). The manifest,
committed by Spark, names the files of the attempts that counted; a lost executor's files are simply
not in it. Null texts are empty texts, null ids come first, repeated rows are repeated documents, an
empty table gives an empty manifest, and extra columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.llm.common import prepared, texts
from threadlens.llm.tokens import encoder, tokenizer_path
from threadlens.session import materialize, scratch_path

MAGIC = b"PFORIDS1"
BLOCK = 1024
WORD = 64
HEADER = "<IHHB7x"
TRAILER = "<QQQ8s"

END_ID = 0
PERCENTILE = 90  # of a block's differences; decides its width
FLUSH_IDS = 1 << 20  # ids a task holds before it writes blocks, and reads at a time
FILE_IDS = 1 << 26  # a file that has this many ids is closed at the next document

MANIFEST = "part int, number int, path string, n_docs long, n_tokens long, n_blocks long, n_bytes long"
DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long"


# --- blocks ---------------------------------------------------------------------------------------


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of WORD numbers below ``2**width`` as rows of ``width`` words."""
    columns = np.ascontiguousarray(values.T.astype(np.uint64))
    out = np.zeros((width, len(values)), dtype=np.uint64)
    for j in range(WORD):
        k, shift = divmod(j * width, WORD)
        out[k] |= columns[j] << np.uint64(shift)
        if shift + width > WORD:
            out[k + 1] |= columns[j] >> np.uint64(WORD - shift)
    return np.ascontiguousarray(out.T)


def unpack(words: np.ndarray, width: int) -> np.ndarray:
    """The inverse of ``pack``."""
    columns = np.ascontiguousarray(words.T)
    out = np.empty((WORD, len(words)), dtype=np.uint32)
    mask = np.uint64((1 << width) - 1)
    for j in range(WORD):
        k, shift = divmod(j * width, WORD)
        value = columns[k] >> np.uint64(shift)
        if shift + width > WORD:
            value = value | (columns[k + 1] << np.uint64(WORD - shift))
        out[j] = value & mask
    return np.ascontiguousarray(out.T)


def bit_length(x: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(x.astype(np.float64) + 1)).astype(np.int64)


def encode_blocks(ids: np.ndarray, percentile: float = PERCENTILE) -> list[bytes]:
    """Blocks of ``BLOCK`` ids each; the last may be shorter."""
    if not len(ids):
        return []
    count = -(-len(ids) // BLOCK)
    sizes = np.full(count, BLOCK)
    sizes[-1] = len(ids) - BLOCK * (count - 1)
    whole = np.concatenate([ids, np.full(count * BLOCK - len(ids), ids[-1], dtype=ids.dtype)]).reshape(count, BLOCK)
    least = whole.min(axis=1)
    rest = (whole - least[:, None]).astype(np.uint32)
    rank = min(BLOCK - 1, int(BLOCK * percentile / 100))
    widths = bit_length(np.partition(rest, rank, axis=1)[:, rank])
    packed: list[bytes] = [b""] * count
    for width in np.unique(widths):
        rows = np.flatnonzero(widths == width)
        if width:
            low = rest[rows] & np.uint32((1 << int(width)) - 1)
            words = pack(low.reshape(-1, WORD), int(width)).reshape(len(rows), -1)
            for row, line in zip(rows, words):
                packed[row] = line[: -(-int(sizes[row]) // WORD) * int(width)].astype("<u8").tobytes()
    over = rest >> np.minimum(widths, 31).astype(np.uint32)[:, None] > 0
    over[widths >= 32] = False
    blocks = []
    for row in range(count):
        places = np.flatnonzero(over[row, : sizes[row]])
        tail = places.astype("<u2").tobytes() + rest[row, places].astype("<u4").tobytes()
        head = struct.pack(HEADER, int(least[row]), int(sizes[row]), len(places), int(widths[row]))
        blocks.append(head + packed[row] + tail + bytes(-len(tail) % 8))
    return blocks


def decode_blocks(data: bytes, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks that start at ``starts`` inside ``data``."""
    heads = [struct.unpack_from(HEADER, data, int(s)) for s in starts]
    out = [np.empty(0, dtype=np.uint32)] * len(heads)
    by_width: dict[int, list[int]] = {}
    for i, (_, _, _, width) in enumerate(heads):
        by_width.setdefault(width, []).append(i)
    for width, members in by_width.items():
        rows = [-(-heads[i][1] // WORD) for i in members]
        if width:
            lines = [
                np.frombuffer(data, "<u8", r * width, int(starts[i]) + struct.calcsize(HEADER)) for i, r in zip(members, rows)
            ]
            low = unpack(np.concatenate(lines).reshape(-1, width), width)
        else:
            low = np.zeros((sum(rows), WORD), dtype=np.uint32)
        at = 0
        for i, r in zip(members, rows):
            least, size, exceptions, _ = heads[i]
            ids = low[at : at + r].reshape(-1)[:size].copy()
            at += r
            if exceptions:
                place = int(starts[i]) + struct.calcsize(HEADER) + r * width * 8
                places = np.frombuffer(data, "<u2", exceptions, place)
                ids[places] = np.frombuffer(data, "<u4", exceptions, place + 2 * exceptions)
            out[i] = ids + np.uint32(least)
    return np.concatenate(out) if out else np.empty(0, dtype=np.uint32)


# --- files ----------------------------------------------------------------------------------------


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class FileWriter:
    """Streams documents into one file; only the ids of unfinished blocks are held."""

    def __init__(self, folder: str, name: str):
        files, place = _open(folder)
        files.create_dir(place, recursive=True)
        self.path = f"{folder}/{name}"
        self.out = files.open_output_stream(f"{place}/{name}")
        self.out.write(MAGIC)
        self.at, self.n_ids = len(MAGIC), 0
        self.starts: list[int] = []
        self.docs: list[tuple[int, int, int]] = []
        self.held: list[bytes] = []
        self.held_ids = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id or 0, doc_id is None, len(ids) // 4))
        self.held.append(ids)
        self.held_ids += len(ids) // 4
        self.n_ids += len(ids) // 4
        if self.held_ids >= FLUSH_IDS:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.held), "<u4")
        for low in range(0, len(ids), FLUSH_IDS):  # one very long document comes in parts, too
            part = ids[low : low + FLUSH_IDS]
            final = low + FLUSH_IDS >= len(ids)
            whole = part if last or not final else part[: len(part) // BLOCK * BLOCK]
            for block in encode_blocks(whole):
                self.starts.append(self.at)
                self.out.write(block)
                self.at += len(block)
            if final:
                rest = part[len(whole) :]
                self.held, self.held_ids = [rest.tobytes()], len(rest)
        if not len(ids):
            self.held, self.held_ids = [], 0

    def close(self) -> tuple:
        self._flush(True)
        index = np.array(self.starts, dtype="<u8").tobytes()
        docs = np.array([d for d, _, _ in self.docs], dtype="<i8").tobytes()
        nulls = np.array([n for _, n, _ in self.docs], dtype="u1").tobytes()
        sizes = np.array([n for _, _, n in self.docs], dtype="<u8").tobytes()
        tail = index + docs + nulls + sizes + struct.pack(TRAILER, len(self.starts), len(self.docs), self.at, MAGIC)
        self.out.write(tail)
        self.out.close()
        return self.path, len(self.docs), self.n_ids, len(self.starts), self.at + len(tail)


class FileReader:
    """Block and document index of one file, and its ids by ranges of blocks."""

    def __init__(self, path: str):
        files, place = _open(path)
        self.file = files.open_input_file(place)
        size = self.file.size()
        end = size - struct.calcsize(TRAILER)
        n_blocks, n_docs, at, magic = struct.unpack(TRAILER, self.file.read_at(size - end, end))
        if magic != MAGIC or self.file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"{path} holds no token ids")
        index = self.file.read_at(end - at, at)
        self.starts = np.append(np.frombuffer(index, "<u8", n_blocks), at).astype(np.int64)
        self.doc_ids = np.frombuffer(index, "<i8", n_docs, 8 * n_blocks)
        self.null_ids = np.frombuffer(index, "u1", n_docs, 8 * (n_blocks + n_docs)).astype(bool)
        self.sizes = np.frombuffer(index, "<u8", n_docs, 8 * (n_blocks + n_docs) + n_docs).astype(np.int64)

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids of the blocks ``first`` to ``last - 1``."""
        low, high = int(self.starts[first]), int(self.starts[last])
        return decode_blocks(self.file.read_at(high - low, low), self.starts[first:last] - low)

    def documents(self) -> Iterator[tuple[int, list[np.ndarray]]]:
        """``(number, parts)`` of each document: its ids, cut where a run of blocks ended."""
        number, parts, wanted = 0, [], int(self.sizes[0]) if len(self.sizes) else 0
        step = FLUSH_IDS // BLOCK
        for first in range(0, len(self.starts) - 1, step):
            run = self.ids(first, min(first + step, len(self.starts) - 1))
            while number < len(self.sizes) and (len(run) or not wanted):
                parts.append(run[:wanted])
                run, wanted = run[len(parts[-1]) :], wanted - len(parts[-1])
                if not wanted:
                    yield number, parts
                    number, parts = number + 1, []
                    wanted = int(self.sizes[number]) if number < len(self.sizes) else 0


# --- jobs -----------------------------------------------------------------------------------------


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Encode ``(doc_id, text)``, end every document with ``end_id`` and write files in ascending order of
    ``doc_id``. Returns the manifest, one row a file, stored in the shared folder."""
    prepared(docs.sparkSession)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), texts(docs).alias("text"))
    ordered = (
        rows.withColumn("hash", F.xxhash64("text")).repartitionByRange("doc_id", "hash")
        .sortWithinPartitions("doc_id", "hash", "text").select("doc_id", "text")
    )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, writer, encode = TaskContext.get().partitionId(), 0, None, None
        end, closed = np.uint32(end_id).astype("<u4").tobytes(), []
        for batch in batches:
            encode = encode or encoder(tokenizer).encode
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text").to_pylist())):
                if writer and writer.n_ids >= FILE_IDS:
                    closed.append((part, number, *writer.close()))
                    writer, number = None, number + 1
                writer = writer or FileWriter(folder, f"ids-{part:06d}-{number:04d}-{uuid.uuid4().hex}.pfor")
                writer.add(doc_id, ids + end)
        if writer:
            closed.append((part, number, *writer.close()))
        if closed:
            kinds = {"int": pa.int32(), "string": pa.string(), "long": pa.int64()}
            fields = [f.split(" ") for f in MANIFEST.split(", ")]
            columns = [pa.array(column, kinds[kind]) for column, (_, kind) in zip(zip(*closed), fields)]
            yield pa.RecordBatch.from_arrays(columns, names=[name for name, _ in fields])

    return materialize(ordered.mapInArrow(task, MANIFEST), "token-files")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, from the files alone: a task a file."""
    spark = manifest.sparkSession
    # One row a file reaches the driver: where each file's ids start.
    files, start = [], 0
    for row in sorted(manifest.collect(), key=lambda r: (r["part"], r["number"])):
        files.append((row["path"], start))
        start += row["n_tokens"]
    if not files:
        return spark.createDataFrame([], DOCUMENTS)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, begin in zip(batch.column("path").to_pylist(), batch.column("begin").to_pylist()):
                reader = FileReader(path)
                crcs = np.zeros(len(reader.sizes), dtype=np.int64)
                for number, parts in reader.documents():
                    crc = 0
                    for part in parts:
                        crc = zlib.crc32(part.astype("<u4"), crc)
                    crcs[number] = crc
                starts = begin + np.cumsum(reader.sizes) - reader.sizes
                columns = [pa.array(reader.doc_ids, mask=reader.null_ids), pa.array(starts), pa.array(reader.sizes), pa.array(crcs)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = spark.sparkContext.parallelize(files, len(files))
    return spark.createDataFrame(rows, "path string, begin long").mapInArrow(task, DOCUMENTS)


def token_files(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write, then read back: one row a document."""
    folder = scratch_path(docs.sparkSession, "ids")
    return read_token_files(write_token_files(docs, folder, tokenizer or tokenizer_path()))
