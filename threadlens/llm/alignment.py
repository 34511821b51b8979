"""Alignment of two tokenizers, counted by an inverted index of compressed document bitmaps.

A is a byte-level BPE of the tokenizers library on a space and the text, special strings taken as plain text; B is a
sentencepiece model, which adds that space itself. Byte offsets where tokens of both end cut a text into groups. In a
group every A token is linked with every B token. The count of an id pair is the number of documents that hold it linked.

Aligning. Neither tokenizer merges over certain white space (found from the vocabularies), so a text is cut into cells
there, and what a cell gives (ids, groups, pairs) is worked out once a task and looked up. A text with a cell that does
not give its bytes back is encoded whole, and has no tokens if that does not give its bytes back either.

Index. Each task numbers its documents in containers of at most CONTAINER documents or LINKED pairs. For every
pair and container there is a bitmap of the documents that hold the pair (plane 0) and, where a document holds it m
times, planes 1, 2, ... for the bits of m - 1. A bitmap is a sorted list of 16-bit places or, from DENSE places on,
8 KB of bits. Blocks of a container are OR-merged in the task that numbers it, so no pair's bitmap lies in one place: it is split by container,
and popcounts of the containers add up to the document counts, weighted planes to the link counts.

Scores. Postings meet the count of their pair and whether it is the highest of its A id, and are dealt by container,
where every posting adds its weight times the count to its documents. That returns one sum a document.

The index is written to the shared folder: it fixes the numbering, and lost executors cost no second pass.

Defined results: null and empty texts have no tokens: zeros and ''; so do texts with U+2581 or whatever else one of the
tokenizers does not give back. Rows are documents: repeated rows and repeated ids count each. An empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadlens.llm.common import prepared, texts
from threadlens.llm.tokens import SPACE, WORD, byte_letters, tokenizer_path
from threadlens.session import materialize

PLACE_BITS = 16
CONTAINER = 1 << PLACE_BITS  # documents
LINKED = 3_000_000  # pairs of documents and ids that a container takes up before it ends
BLOCK_CELLS = 1_000_000  # cells that are looked up before their pairs are counted
DENSE = CONTAINER // 16  # from here on bits are shorter than places
KEPT_CELLS, KEPT_PAIRS = 250_000, 4_000_000  # cells and their pairs that a task remembers before it begins anew
SCORED = 1_000_000  # places whose scores are added up at once

DOCUMENT = "doc_no long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
POSTING = "a int, b int, container long, plane int, n_docs long, places binary"


# --- one text ---------------------------------------------------------------------------------------


class Aligner:
    """Both tokenizers, and what the cells of texts give.

    Cells are numbered from 0; number 0 is the cell of a text without tokens. ``tokens`` has (A tokens, B tokens,
    groups, links) of each cell, ``groups`` its text for the digest with a semicolon at its end, ``pairs`` its linked
    pairs, flat, one for each link.
    """

    def __init__(self, a_path: str, b_path: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = SentencePieceProcessor(model_file=b_path)
        self.letters = byte_letters()
        byte_of = {letter: byte for byte, letter in self.letters.items()}
        names = {i: t for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        # Special strings are plain text here, so their own ids never occur.
        self.a_bytes = [bytes(byte_of[c] for c in names.get(i, "") if c in byte_of) for i in range(max(names) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.lengths = [np.array([len(x) for x in own]) for own in (self.a_bytes, self.b_bytes)]
        said = [np.array([str(i) for i in range(len(own))], dtype=object) for own in (self.a_bytes, self.b_bytes)]
        self.said = [(said[0] + ",", said[0] + "|"), (said[1] + ",", said[1] + ";")]
        self.space = pieces.index("▁")
        # White space that B may merge with what is before it does not begin a cell.
        inside = {" " if c == "▁" else c for p in pieces if len(p) > 1 and p.strip("▁") for c, before in zip(p[1:], p) if before != "▁" or c != "▁"}
        white = [c for c in map(chr, range(0x3001)) if re.fullmatch(f"[{SPACE}]", c)]
        stuck = "".join(re.escape(c) for c in white if c in inside)
        more = f"(?:[{stuck}][{SPACE}]*[^{SPACE}]*)*" if stuck else ""
        self.cut = re.compile(f"[{SPACE}]*[^{SPACE}]+{more}|[{SPACE}]+").findall
        self.word = re.compile(WORD).fullmatch
        self.merge = self.a.model.tokenize
        self.forget()

    def forget(self) -> None:
        """Drop all cells; numbers given out before are void."""
        self.known: dict[str, int] = {}
        self.tokens, self.groups = np.zeros((1, 4), np.int64), [""]
        self.pairs, self.sizes = np.empty(0, np.int64), np.zeros(1, np.int64)

    def _a(self, text: str) -> list[int]:
        if self.word(text):  # the library's pattern would leave this whole, so its merges alone are asked for
            return [t.id for t in self.merge(text.encode().decode("latin-1").translate(self.letters))]
        return self.a.encode(text, add_special_tokens=False).ids

    def _b(self, cells: list[str]) -> list[list[int]]:
        """B puts a space before all it encodes: it is the cell's own, or it goes."""
        out = self.b.encode([c[1:] if c[0] == " " else c for c in cells], num_threads=1)
        for n, cell in enumerate(cells):
            if cell == " ":
                out[n] = [self.space]
            elif cell[0] != " ":
                out[n] = out[n][1:] if out[n][:1] == [self.space] else []
        return out

    def _add(self, cells: list[str], a: list[list[int]], b: list[list[int]]) -> list[int]:
        """Numbers for new cells, -1 for those whose tokens don't give their bytes back."""
        numbers = [-1] * len(cells)
        whole = [
            n for n, (cell, x, y) in enumerate(zip(cells, a, b))
            if (own := cell.encode()) == b"".join([self.a_bytes[i] for i in x]) and own == b"".join([self.b_bytes[i] for i in y])
        ]
        if not whole:
            return numbers
        sides = [np.concatenate([np.array(side[n], np.int64) for n in whole]) for side in (a, b)]
        counts = [np.array([len(side[n]) for n in whole]) for side in (a, b)]
        # All cells as one text: where tokens of both end, a group ends, and so does every cell.
        ends = [np.cumsum(lengths[ids]) for lengths, ids in zip(self.lengths, sides)]
        cuts = np.intersect1d(*ends, assume_unique=True)
        group = [np.searchsorted(cuts, e) for e in ends]
        size = [np.bincount(g, minlength=len(cuts)) for g in group]
        cell = np.searchsorted(ends[0][np.cumsum(counts[0]) - 1], cuts)
        links = np.bincount(cell, size[0] * size[1], len(whole)).astype(np.int64)
        right = (np.cumsum(size[1]) - size[1])[group[0]]
        more = size[1][group[0]]
        pairs = np.repeat(sides[0], more) << 32 | sides[1][expanded(right, more)]
        texts = [
            np.where(np.append(g[1:] == g[:-1], False), inner[ids], last[ids]) for (inner, last), ids, g in zip(self.said, sides, group)
        ]
        order = np.argsort(np.concatenate([2 * group[0], 2 * group[1] + 1]), kind="stable")
        said = np.concatenate(texts)[order].tolist()
        stops = np.cumsum(counts[0] + counts[1]).tolist()
        first = len(self.groups)
        self.groups.extend("".join(said[low:high]) for low, high in zip([0, *stops], stops))
        own = np.stack([counts[0], counts[1], np.bincount(cell, minlength=len(whole)), links], 1)
        self.tokens = np.concatenate([self.tokens, own])
        self.pairs, self.sizes = np.concatenate([self.pairs, pairs]), np.concatenate([self.sizes, links])
        for k, n in enumerate(whole):
            numbers[n] = first + k
        return numbers

    def _learn(self, cells: list[str]) -> None:
        for cell, number in zip(cells, self._add(cells, list(map(self._a, cells)), self._b(cells))):
            self.known[cell] = number

    def cells(self, texts: list[str]) -> list[list[int]]:
        """Numbers of the cells of each text. What is new in them all is worked out at once."""
        cut = [self.cut(" " + text) if text else [] for text in texts]
        new = {c for own in cut for c in own if c not in self.known}
        if new:
            self._learn(sorted(new))
        out = [list(map(self.known.__getitem__, own)) or [0] for own in cut]
        for n, own in enumerate(out):
            if -1 in own:
                text = " " + texts[n]
                ids = self.a.encode(text, add_special_tokens=False).ids
                out[n] = [max(self._add([text], [ids], [self.b.encode(texts[n])])[0], 0)]
        return out


def aligner(a_path: str, b_path: str) -> Aligner:
    """For one task; the library's own threads stay off."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Aligner(a_path, b_path)


# --- bitmaps ----------------------------------------------------------------------------------------


def expanded(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places ``start, ..., start + size - 1`` of all runs, one run after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their values."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(values, first)


def to_places(bitmap: bytes) -> np.ndarray:
    if len(bitmap) < CONTAINER // 8:
        return np.frombuffer(bitmap, "<u2")
    return np.flatnonzero(np.unpackbits(np.frombuffer(bitmap, np.uint8), bitorder="little")).astype("<u2")


def to_bitmaps(groups: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Distinct groups, the popcounts of their bitmaps, and the bitmaps, from (group, place) in order.

    A (group, place) that comes several times counts once: this is the OR of all blocks.
    """
    if not len(groups):
        return groups, np.empty(0, np.int64), pa.array([], pa.binary())
    new = np.concatenate([[True], (groups[1:] != groups[:-1]) | (places[1:] != places[:-1])])
    groups, places = groups[new], np.ascontiguousarray(places[new], dtype="<u2")
    first = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
    counts = np.diff(np.append(first, len(groups)))
    names = groups[first]
    offsets = np.append(first, len(groups)) * 2
    lists = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(places)]).cast(pa.binary())
    dense = np.flatnonzero(counts >= DENSE)
    if len(dense):
        made = lists.to_pylist()
        for d in dense.tolist():
            bits = np.zeros(CONTAINER, np.uint8)
            bits[places[first[d] : first[d] + counts[d]]] = 1
            made[d] = np.packbits(bits, bitorder="little").tobytes()
        lists = pa.array(made, pa.binary())
    return names, counts, lists


class Container:
    """Documents of one container: their own figures, and blocks of (pair, place, times)."""

    def __init__(self, number: int, own: Aligner):
        self.number, self.aligner = number, own
        self.documents: list[tuple] = []
        self.cells: list[np.ndarray] = []
        self.held = 0
        self.blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.linked = 0

    def add(self, doc_id: int | None, cells: list[int]) -> None:
        said = "".join([self.aligner.groups[c] for c in cells])[:-1]
        self.documents.append((doc_id, hashlib.sha256(said.encode()).hexdigest() if said else ""))
        self.cells.append(np.array(cells, np.int64))
        self.held += len(cells)
        if self.held >= BLOCK_CELLS:
            self.count()

    def full(self) -> bool:
        return len(self.documents) >= CONTAINER or self.linked >= LINKED

    def count(self) -> None:
        """Turn the held cells into one block of pairs and the sums of their documents."""
        if not self.cells:
            return
        own, sizes = self.aligner, np.array([len(c) for c in self.cells])
        first = len(self.documents) - len(self.cells)
        cells = np.concatenate(self.cells)
        starts = np.cumsum(sizes) - sizes
        sums = np.add.reduceat(own.tokens[cells], starts)
        self.documents[first:] = [(*d, *s) for d, s in zip(self.documents[first:], sums.tolist())]
        bits = max(1, len(own.groups).bit_length())
        key, n = summed(np.repeat(np.arange(len(sizes)), sizes) << bits | cells, np.ones(len(cells), np.int64))
        cell, place = key & ((1 << bits) - 1), (key >> bits) + first
        more = own.sizes[cell]
        at = expanded((np.cumsum(own.sizes) - own.sizes)[cell], more)
        wide = np.repeat(np.arange(len(cell)), more)
        # Pairs have up to 49 bits, places 16: equal pairs get small numbers for one sort of both.
        distinct, small = np.unique(own.pairs[at], return_inverse=True)
        key, times = summed(small << PLACE_BITS | place[wide], n[wide])
        self.blocks.append((distinct[key >> PLACE_BITS], (key & (CONTAINER - 1)).astype(np.uint16), times.astype(np.int32)))
        self.linked += len(key)
        self.cells, self.held = [], 0

    def records(self) -> Iterator[pa.RecordBatch]:
        """One record with all documents, then a record a pair and plane."""
        self.count()
        base = self.number << PLACE_BITS
        doc_id, sha, n_a, n_b, n_groups, n_links = map(list, zip(*self.documents))
        columns = {
            "doc_no": pa.array(np.arange(base, base + len(sha))), "doc_id": pa.array(doc_id, pa.int64()), "n_a": pa.array(n_a, pa.int64()),
            "n_b": pa.array(n_b, pa.int64()), "n_groups": pa.array(n_groups, pa.int64()), "n_links": pa.array(n_links, pa.int64()), "groups_sha256": pa.array(sha),
        }
        rows = pa.StructArray.from_arrays(list(columns.values()), names=list(columns))
        yield _record(pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows), [pa.nulls(1, t) for t in POSTING_TYPES], rows.type)
        pairs, places, times = (np.concatenate(c) for c in zip(*self.blocks)) if self.blocks else [np.empty(0, np.int64)] * 3
        self.blocks = []
        order = np.lexsort((places, pairs))
        pairs, places, more = pairs[order], places[order], times[order] - 1
        plane, kept = 0, np.ones(len(pairs), bool)
        while kept.any():
            groups, counts, bitmaps = to_bitmaps(pairs[kept], places[kept])
            arrays = [
                pa.array((groups >> 32).astype(np.int32)), pa.array((groups & 0xFFFFFFFF).astype(np.int32)), pa.array(np.full(len(groups), self.number)),
                pa.array(np.full(len(groups), plane, np.int32)), pa.array(counts.astype(np.int64)), bitmaps,
            ]
            yield _record(pa.nulls(len(groups), pa.list_(rows.type)), arrays, rows.type)
            rest = more >> plane
            if not rest.any():
                return
            plane += 1
            kept = rest & 1 == 1
            while not kept.any():  # a bit that no document has
                plane += 1
                kept = (more >> (plane - 1)) & 1 == 1


POSTING_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
POSTING_NAMES = ["a", "b", "container", "plane", "n_docs", "places"]


def _record(documents: pa.Array, posting: list[pa.Array], row: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([documents.cast(pa.list_(row)), *posting], names=["documents", *POSTING_NAMES])


# --- whole table ------------------------------------------------------------------------------------


def pair_index(docs: DataFrame, a_name: str = "byte_bpe_50k.json", b_name: str = "piece_bpe_32k.model") -> tuple[DataFrame, DataFrame]:
    """The documents with their own figures, and the postings ``(a, b, container, plane, n_docs, places)``; both stored."""
    prepared(docs.sparkSession)
    a_path, b_path = tokenizer_path(a_name), tokenizer_path(b_name)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a_path, b_path)
        number = TaskContext.get().partitionId() << 24
        container = Container(number, own)
        for batch in batches:
            if len(own.groups) >= KEPT_CELLS or own.pairs.size >= KEPT_PAIRS:
                container.count()
                own.forget()
            texts_here = batch.column("text").to_pylist()
            for doc_id, cells in zip(batch.column("doc_id").to_pylist(), own.cells(texts_here)):
                container.add(doc_id, cells)
                if container.full():
                    yield from container.records()
                    number += 1
                    container = Container(number, own)
        if container.documents:
            yield from container.records()

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), texts(docs).alias("text"))
    stored = materialize(rows.mapInArrow(task, f"documents array<struct<{DOCUMENT}>>, {POSTING}"), "pair-index")
    documents = stored.where(F.col("documents").isNotNull()).select(F.explode("documents").alias("d")).select("d.*")
    return documents, stored.where(F.col("a").isNotNull()).select(*POSTING_NAMES)


def pair_counts(postings: DataFrame) -> DataFrame:
    """``(a, b, n_docs, n_links, best)`` of each pair: documents, links, and whether no other pair of its A id is in more documents."""
    weight = F.when(F.col("plane") == 0, F.lit(1).cast("long")).otherwise(F.expr("shiftleft(1L, plane - 1)"))
    counts = postings.groupBy("a", "b").agg(
        F.sum(F.when(F.col("plane") == 0, F.col("n_docs"))).alias("n_docs"), F.sum(F.col("n_docs") * weight).alias("n_links")
    )
    # An A id has at most as many pairs as B has ids.
    return counts.withColumn("best", F.col("n_docs") == F.max("n_docs").over(Window.partitionBy("a")))


def document_scores(postings: DataFrame, counts: DataFrame) -> DataFrame:
    """``(doc_no, n_best, count_sum)``: what the postings return to the documents that have any."""
    scored = postings.join(counts.select("a", "b", F.col("n_docs").alias("count"), "best"), ["a", "b"])
    dealt = scored.select("container", "plane", "places", "count", "best").repartition("container")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[np.ndarray]] = {}
        held: list[pa.RecordBatch] = []

        def add() -> None:
            rows = pa.Table.from_batches(held).combine_chunks()
            container, plane = rows["container"].to_numpy(), rows["plane"].to_numpy()
            times = np.where(plane == 0, 1, 1 << np.maximum(plane - 1, 0).astype(np.int64))
            count, best = rows["count"].to_numpy() * times, rows["best"].to_numpy() * times
            places = list(map(to_places, rows["places"].to_pylist()))
            sizes = np.array([len(p) for p in places])
            flat = np.concatenate(places)
            for number in np.unique(container).tolist():
                if number not in sums:
                    sums[number] = [np.zeros(CONTAINER, np.int64), np.zeros(CONTAINER, np.int64)]
                here = np.repeat(container == number, sizes)
                for total, value in zip(sums[number], (best, count)):
                    np.add.at(total, flat[here], np.repeat(value, sizes)[here])
            held.clear()

        waiting = 0
        for batch in batches:
            held.append(batch)
            waiting += sum(map(len, batch.column("places").to_pylist())) // 2
            if waiting >= SCORED:
                add()
                waiting = 0
        if held:
            add()
        for number, (best, count) in sums.items():
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array((number << PLACE_BITS) + some), pa.array(best[some]), pa.array(count[some])], names=["doc_no", "n_best", "count_sum"]
            )

    return dealt.mapInArrow(task, "doc_no long, n_best long, count_sum long")


def alignment(docs: DataFrame, a_name: str = "byte_bpe_50k.json", b_name: str = "piece_bpe_32k.model") -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)``, a row a document."""
    documents, postings = pair_index(docs, a_name, b_name)
    scores = document_scores(postings, materialize(pair_counts(postings), "pair-counts"))
    zero = F.lit(0).cast("long")
    return documents.join(scores, "doc_no", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256",
    )
