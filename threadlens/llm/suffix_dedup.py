"""Exact removal of repeated passages: every byte covered by a string of LENGTH bytes that also starts elsewhere.

Sharding. In every window of LENGTH bytes, the GRAM bytes with the smallest hash (the leftmost of equals)
are its anchor. Equal windows have equal anchors, so they meet if windows are dealt by anchor; consecutive
windows with one anchor are a context, shipped as one string of bytes. Only contexts whose anchor has
another, different context are shipped, each different one once: equal contexts repeat each other and are
recognised by a hash beside the anchor's, first within a batch, then over all rows, dealt by anchor and
sorted, which takes one row of memory.

Shards. Contexts of whole anchors, up to SHARD bytes, are put into one string with separators. Its suffix
array is built by induced sorting, and the permuted common prefixes tell for every window that no copy
has covered whether a neighbour in the array shares LENGTH bytes; a shared string never holds a
separator. Windows of an anchor with over CROWD different contexts are dealt once more, each by a hash of
128 bits of its own bytes, and counted, so no shard outgrows its bound.

Bytes. Covered ranges are gathered by document and joined with the texts, which are shuffled once.

Rows are told apart by a hash of id and text, and equal rows are repeats of each other. Null is the empty
text; texts shorter than LENGTH stay whole; a null id is an id like any other; an empty table gives no
rows; extra columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlens.llm.common import named, prepared, texts
from threadlens.llm.suffix_array import common_prefixes, suffix_array
from threadlens.session import materialize

LENGTH = 200  # bytes
GRAM = 32  # bytes of an anchor, a power of two
SHARD = 1 << 21  # bytes of contexts in one suffix array
CROWD = 20_000  # different contexts of one anchor
PIECE = 1 << 18  # bytes hashed at a time; longer texts go on with an overlap

FACTOR = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)


# --- anchors --------------------------------------------------------------------------------------


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from every place on."""
    h, width, factor = data.astype(np.uint64) + np.uint64(1), 1, FACTOR
    while width < GRAM:
        h = h[:-width] + factor * h[width:]
        factor, width = factor * factor, 2 * width
    h ^= h >> np.uint64(29)
    h *= MIX
    return h ^ (h >> np.uint64(32))


def _window_minima(values: np.ndarray, width: int) -> np.ndarray:
    reach = 1
    while 2 * reach <= width:
        values, reach = np.minimum(values[:-reach], values[reach:]), 2 * reach
    rest = width - reach
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def contexts(data: np.ndarray, owner: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(anchor, start, size)`` of every context in ``data``, several texts one behind the other; ``owner`` numbers
    the texts byte by byte, and no window crosses from one to the next."""
    if len(data) < length:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        hashes = _gram_hashes(data)
    packed = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    anchor = (_window_minima(packed, length - GRAM + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    whole = owner[: len(anchor)] == owner[length - 1 :]
    change = np.append(True, (anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1]) | (owner[1 : len(anchor)] != owner[: len(anchor) - 1]))
    starts = np.flatnonzero(change)
    ends = np.append(starts[1:], len(anchor))
    kept = whole[starts]
    starts, ends = starts[kept], ends[kept]
    return hashes[anchor[starts]].view(np.int64), starts, ends - starts - 1 + length


def _pieces(lines: list[bytes], length: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Short texts together, long ones in overlapping parts: ``(row, first byte, bytes)`` lists of about PIECE bytes."""
    rows, firsts, parts, held = [], [], [], 0
    for row, line in enumerate(lines):
        for low in range(0, max(len(line) - length + 1, 0), PIECE):
            part = line[low : low + PIECE + length - 1]
            rows.append(row), firsts.append(low), parts.append(part)
            held += len(part)
            if held >= PIECE:
                yield rows, firsts, parts
                rows, firsts, parts, held = [], [], [], 0
    if parts:
        yield rows, firsts, parts


def merged(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges joined where they touch or overlap."""
    if not len(low):
        return low, high
    order = np.argsort(low, kind="stable")
    low, reach = low[order], np.maximum.accumulate(high[order])
    first = np.append(True, low[1:] > reach[:-1])
    return low[first], reach[np.append(first[1:], True)]


def _scan(rows: DataFrame, length: int) -> DataFrame:
    """``(anchor, ctx, k, low, size, copied)``: contexts of all texts, and, with a null anchor, ranges that are covered
    already as their context is in the batch twice. Of such contexts the first one stays, marked as copied."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh64_intdigest
        for batch in batches:
            keys = batch.column("k").to_numpy()
            found: list[tuple] = []
            for row, first, parts in _pieces(batch.column("text").to_pylist(), length):
                joined, sizes = b"".join(parts), np.array([len(p) for p in parts])
                owner = np.repeat(np.arange(len(parts), dtype=np.int32), sizes)
                anchor, start, size = contexts(np.frombuffer(joined, np.uint8), owner, length)
                ctx = np.array([digest(joined[a:b]) for a, b in zip(start.tolist(), (start + size).tolist())], dtype=np.uint64).view(np.int64)
                own = owner[start]
                low = start - (np.cumsum(sizes) - sizes)[own] + np.array(first, dtype=np.int64)[own]
                found.append((anchor, ctx, np.array(row, dtype=np.int64)[own], low, size))
            if not found:
                continue
            anchor, ctx, row, low, size = (np.concatenate(c) for c in zip(*found))
            _, one, back, count = np.unique(ctx, return_index=True, return_inverse=True, return_counts=True)
            twice = count[back] > 1
            kept = np.zeros(len(ctx), dtype=bool)
            kept[one] = True
            covered: list[tuple] = []
            at = np.flatnonzero(twice)
            at = at[np.argsort(row[at], kind="stable")]
            for own in np.split(at, np.flatnonzero(np.diff(row[at])) + 1) if len(at) else []:
                a, b = merged(low[own], low[own] + size[own])
                covered.append((np.full(len(a), row[own[0]]), a, b - a))
            more = [np.concatenate(c) for c in zip(*covered)] if covered else [np.empty(0, np.int64)] * 3
            none = np.full(len(more[0]), True)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([anchor[kept], np.zeros(len(none), np.int64)]), mask=np.concatenate([np.zeros(kept.sum(), bool), none])),
                pa.array(np.concatenate([ctx[kept], np.zeros(len(none), np.int64)])),
                pa.array(keys[np.concatenate([row[kept], more[0]])]),
                pa.array(np.concatenate([low[kept], more[1]])), pa.array(np.concatenate([size[kept], more[2]])),
                pa.array(np.concatenate([twice[kept], none])),
            ], names=["anchor", "ctx", "k", "low", "size", "copied"])

    return rows.select("k", "text").mapInArrow(task, "anchor long, ctx long, k long, low long, size long, copied boolean")


def _compare(scanned: DataFrame) -> DataFrame:
    """Rows that are copied, or stand for their context where the anchor has several: ``(anchor, k, low, size, copied, stands)``.

    Rows come sorted by anchor and context; each is decided by its neighbours. A context's row that
    stands for it is the last one of an anchor's first context, and the first of every other.
    """
    dealt = scanned.where("anchor IS NOT NULL").repartition("anchor").sortWithinPartitions("anchor", "ctx", "k", "low")
    names = ["anchor", "ctx", "k", "low", "size", "copied"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None  # the last row, not decided yet
        equal_before, first_before = False, True  # it equals the row before; it is in its anchor's first context

        def decide(columns: list[np.ndarray], final: bool) -> tuple[pa.RecordBatch, bool, bool]:
            anchor, ctx, k, low, size, copied = columns
            n = len(anchor) if final else len(anchor) - 1
            new_anchor = np.append(False, anchor[1:] != anchor[:-1])
            equal = np.append(equal_before, ~new_anchor[1:] & (ctx[1:] == ctx[:-1]))
            # In the first context of the anchor: no change of context since the anchor began.
            place = np.arange(len(anchor))
            began = np.maximum.accumulate(np.where(new_anchor, place, -1))
            changed = np.maximum.accumulate(np.where(~equal & ~new_anchor & (place > 0), place, -1))
            first = np.where(began < 0, (changed < 0) & first_before, changed < began)
            next_equal = np.append(equal[1:], False)
            next_same = np.append(~new_anchor[1:], False)
            copied = copied | equal | next_equal
            stands = np.where(first, next_same & ~next_equal, ~equal)
            kept = np.flatnonzero((copied | stands)[:n])
            out = [pa.array(c[kept]) for c in (anchor, k, low, size, copied, stands)]
            batch = pa.RecordBatch.from_arrays(out, names=["anchor", "k", "low", "size", "copied", "stands"])
            return batch, bool(equal[-1]), bool(first[-1])

        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
            columns = [np.concatenate(c) for c in zip(held, columns)] if held else columns
            if not len(columns[0]):
                continue
            out, equal_last, first_last = decide(columns, False)
            equal_before, first_before = equal_last, first_last
            held = [c[-1:] for c in columns]
            yield out
        if held:
            yield decide(held, True)[0]

    return dealt.mapInArrow(task, "anchor long, k long, low long, size long, copied boolean, stands boolean")


# --- shards ---------------------------------------------------------------------------------------


def repeated_windows(parts: list[bytes], length: int) -> list[np.ndarray]:
    """For each context, which windows share their bytes with another window, by suffix array and common prefixes."""
    sizes = np.array([len(p) for p in parts])
    raw = np.frombuffer(b"\0".join(parts) + b"\0\0", np.uint8)
    text = raw.astype(np.int64) + 2
    starts = np.cumsum(sizes + 1) - sizes - 1
    text[starts + sizes] = 1
    text[-1] = 0
    order = suffix_array(text)
    before, common = common_prefixes(text, order)
    repeated = common >= length
    repeated[before[repeated]] = True  # the neighbour repeats, too
    return [repeated[s : s + n - length + 1] for s, n in zip(starts.tolist(), sizes.tolist())]


def _ranges(windows: np.ndarray, low: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(windows) + low
    return merged(at, at + length)


def _shards(shipped: DataFrame, length: int, shard: int) -> DataFrame:
    """``(k, low, size)`` covered in contexts without a copy."""
    dealt = shipped.repartition("anchor").sortWithinPartitions("anchor")

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        out = []
        for (k, low, copied, _), windows in zip(rows, repeated_windows([r[3] for r in rows], length)):
            if not copied and windows.any():
                a, b = _ranges(windows, low, length)
                out.append((np.full(len(a), k), a, b - a))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int64)] * 3
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["k", "low", "size"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, last = [], 0, None
        for batch in batches:
            for anchor, k, low, copied, data in zip(*(batch.column(c).to_pylist() for c in ("anchor", "k", "low", "copied", "data"))):
                if anchor != last and held >= shard:
                    yield solve(rows)
                    rows, held = [], 0
                rows.append((k, low, copied, data))
                held, last = held + len(data), anchor
        if rows:
            yield solve(rows)

    return dealt.mapInArrow(task, "k long, low long, size long")


def _crowded(shipped: DataFrame, length: int) -> DataFrame:
    """The same for contexts of crowded anchors: their windows are counted by a hash of 128 bits."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for k, low, data in zip(*(batch.column(c).to_pylist() for c in ("k", "low", "data"))):
                count = len(data) - length + 1
                hashes = b"".join(xxhash.xxh3_128_digest(data[i : i + length]) for i in range(count))
                both = np.frombuffer(hashes, "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(np.full(count, k)), pa.array(low + np.arange(count))], names=["h1", "h2", "k", "low"]
                )

    windows = shipped.mapInArrow(task, "h1 long, h2 long, k long, low long")
    several = windows.groupBy("h1", "h2").count().where("count > 1").select("h1", "h2")
    return windows.join(several, ["h1", "h2"], "left_semi").select("k", "low", F.lit(length).cast("long").alias("size"))


# --- whole job ------------------------------------------------------------------------------------


def _keyed(docs: DataFrame) -> DataFrame:
    """All columns, the text as bytes in ``text`` and the row's key in ``k``; other names are out of the way in ``row``."""
    text = texts(docs)
    return docs.select(F.struct(*[named(docs, c) for c in docs.columns if c != "text"]).alias("row"), text.cast("binary").alias("text"), F.xxhash64(docs["doc_id"].cast("long"), text).alias("k"))


def covered_ranges(docs: DataFrame, length: int = LENGTH, shard: int = SHARD, crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """The keyed rows dealt by key, and ``(k, ranges)`` of covered bytes for rows that have any."""
    keyed = _keyed(docs)
    scanned = materialize(_scan(keyed, length), "contexts")
    compared = materialize(_compare(scanned), "compared")
    stands = compared.where("stands")
    crowds = materialize(stands.groupBy("anchor").count().where(F.col("count") > crowd).select("anchor", F.lit(True).alias("crowded")), "crowds")
    wanted = stands.join(crowds, "anchor", "left").groupBy("k").agg(
        F.collect_list(F.struct("anchor", "low", "size", "copied", F.col("crowded").isNotNull().alias("crowded"))).alias("wanted")
    )
    dealt = keyed.repartition("k")

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, text, own in zip(*(batch.column(c).to_pylist() for c in ("k", "text", "wanted"))):
                seen = set()
                for w in own:  # equal rows have equal keys: a context is shipped once
                    if (w["low"], w["size"]) not in seen:
                        seen.add((w["low"], w["size"]))
                        out.append((w["anchor"], k, w["low"], w["copied"], w["crowded"], text[w["low"] : w["low"] + w["size"]]))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary()]
            names = ["anchor", "k", "low", "copied", "crowded", "data"]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(zip(*out), kinds)], names=names)

    # The texts are dealt once for both joins; the other side is the smaller and is hashed, so texts aren't sorted.
    distinct = dealt.join(wanted.hint("shuffle_hash"), "k").select("row", "text", "k", "wanted")
    shipped = distinct.mapInArrow(ship, "anchor long, k long, low long, copied boolean, crowded boolean, data binary")
    own = scanned.where("anchor IS NULL").select("k", "low", "size")
    ranges = own.union(compared.where("copied").select("k", "low", "size")).union(_shards(shipped.where("NOT crowded"), length, shard))
    if not crowds.isEmpty():
        ranges = ranges.union(_crowded(shipped.where("crowded"), length))
    return dealt, ranges.groupBy("k").agg(F.collect_list(F.struct("low", "size")).alias("ranges"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, shard: int = SHARD, crowd: int = CROWD) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_removed``, ``spans`` (removed runs as (low, size)) and ``kept``, the bytes left; the
    struct ``row`` has the other columns."""
    prepared(docs.sparkSession)
    dealt, ranges = covered_ranges(docs, length, shard, crowd)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, own in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist()):
                low = np.array([r["low"] for r in own or ()], dtype=np.int64)
                low, high = merged(low, low + np.array([r["size"] for r in own or ()], dtype=np.int64))
                kept = b"".join(text[a:b] for a, b in zip([0, *high.tolist()], [*low.tolist(), len(text)]))
                spans = [{"low": a, "size": b - a} for a, b in zip(low.tolist(), high.tolist())]
                out.append((len(text), len(text) - len(kept), spans, kept))
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("low", pa.int64()), ("size", pa.int64())])), pa.binary()]
            columns = [pa.array(list(c), kind) for c, kind in zip(zip(*out), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *columns], names=["row", "n_bytes", "n_removed", "spans", "kept"])

    joined = dealt.join(ranges.hint("shuffle_hash"), "k", "left").select("row", "text", "k", "ranges")
    found = T.StructType.fromDDL("n_bytes long, n_removed long, spans array<struct<low:long,size:long>>, kept binary")
    return joined.mapInArrow(cut, T.StructType([joined.schema["row"], *found.fields]))


def without_repeats(docs: DataFrame, length: int = LENGTH, shard: int = SHARD, crowd: int = CROWD) -> DataFrame:
    """``docs`` with the repeats cut out of ``text``; characters of which a part is gone go whole. A column ``n_chars`` is
    counted anew; all others stay. Texts may become empty; no row goes."""
    found = remove_repeats(docs, length, shard, crowd)

    @F.pandas_udf("string")
    def readable(kept: pd.Series) -> pd.Series:
        return kept.map(lambda b: b.decode("utf-8", "ignore"))

    found = found.select("row", readable("kept").alias("text"))
    columns = {c: F.col("row")[c] for c in docs.columns if c != "text"} | {"text": F.col("text")}
    if "n_chars" in columns:
        columns["n_chars"] = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return found.select(*[columns[c].alias(c) for c in docs.columns])


def repeat_digests(docs: DataFrame, length: int = LENGTH, shard: int = SHARD, crowd: int = CROWD) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)``, a row a document."""
    found = remove_repeats(docs, length, shard, crowd)
    return found.select(
        F.col("row.doc_id").cast("long").alias("doc_id"), "n_bytes", "n_removed",
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )
