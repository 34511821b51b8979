"""BPE encoding with content-defined chunks: what documents share is encoded once.

Cut. A rolling hash over the last 32 bytes of a text ends a chunk where its upper MASK_BITS bits are zero, so equal
passages have equal chunks wherever they lie; chunks have LEAST to MOST bytes.

Share. Chunks are known by a digest of 128 bits. Those that occur in several places are encoded once, from the place
that comes first, as the ids between their first and last white space; what is before and after belongs to words that
the cut may have parted.

Join. A document takes the ids of its shared chunks, and encodes all else: what lies between the last white space of
one and the first white space of the next. At each join of taken and new ids, the words on both sides are encoded again
as one string and must give the very ids that meet there; the string grows word by word until they do, and a text where
they never do is encoded whole.

Words are runs without ASCII white space. Their ids are looked up in a cache of bounded size, the rest is done by the
tokenizers library, as is decoding. Special strings are what the library makes of them.

Texts are dealt by their digest once, compressed, and each distinct text is encoded once; copies take its result. Equal
texts of one task are dealt once, so a text that a third of all rows share is a row a task. Chunks meet by their
digest in joins, which split a chunk that many documents hold.

Defined results: null is the empty text, with no ids and the digests of nothing; repeated rows and ids are kept; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.llm.common import prepared, texts
from threadlens.llm.tokens import _packed, byte_letters, tokenizer_path
from threadlens.session import materialize

TOKENIZER = "word_bpe_49k.json"
WINDOW = 32  # bytes, the width of the hash in bits
MASK_BITS = 9  # a cut in 512 bytes
LEAST, MOST = 128, 4096  # bytes of a chunk
GEAR = np.frombuffer(hashlib.shake_128(b"rolling hash").digest(1024), "<u4")
KEPT_WORDS, KEPT_LENGTH = 400_000, 48  # bounds of the words a task remembers: number, and bytes of one
# Latin-1 letters as UTF-8: no form of theirs is shorter, and lower case is a letter for a letter.
LETTERS = rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])"
PLAIN_WORD = re.compile(rb"(" + LETTERS + rb"*)([.,;:!?]*)")
LETTERS_DIGITS_MARKS = ["[\\p{L}]+", "[\\p{N}]", "[^\\s\\p{L}\\p{N}]+"]  # fixed values: how such a pattern ends
FILTER_BITS = 1 << 26  # 8 MB
SEEN_TEXTS = 1_000_000  # digests a task remembers, to pass equal texts on once


# --- cutting ----------------------------------------------------------------------------------------


def rolling(data: np.ndarray) -> np.ndarray:
    """At each byte the sum of ``GEAR[byte] << age`` over the last WINDOW bytes, modulo 2^32."""
    out = GEAR[data]
    width = 1
    while width < WINDOW and width < len(out):  # a window of twice the width is two windows
        wider = out.copy()
        wider[width:] += out[:-width] << np.uint32(width)
        out, width = wider, 2 * width
    return out


def cuts_of(parts: list[bytes]) -> list[list[int]]:
    """Where the chunks of each text begin, and its end. Texts side by side don't matter: no cut is in the first LEAST bytes."""
    data = np.frombuffer(b"".join(parts), np.uint8)
    marks = np.flatnonzero(rolling(data) >> np.uint32(32 - MASK_BITS) == 0) + 1
    ends = np.cumsum([len(p) for p in parts])
    out, low = [], 0
    for own, high in zip(np.split(marks, np.searchsorted(marks, ends[:-1], side="right")), ends.tolist()):
        cuts, last, size = [0], 0, high - low
        for mark in [*(own - low).tolist(), size]:
            while mark - last > MOST:
                last += MOST
                cuts.append(last)
            if mark - last >= LEAST and mark < size:
                last = mark
                cuts.append(last)
        out.append([*cuts, size] if size else [0])
        low = high
    return out


def white_ends(chunk: bytes) -> tuple[int, int]:
    """The places of the first and the last white space, (-1, -1) without any."""
    first = len(chunk.split(None, 1)[0]) if chunk[:1].strip() else 0
    last = len(chunk) - 1 - (len(chunk.rsplit(None, 1)[-1]) if chunk[-1:].strip() else 0)
    return (first, last) if first <= last else (-1, -1)


# --- encoding ---------------------------------------------------------------------------------------


def words_before(text: bytes, at: int, n: int) -> tuple[list[bytes], bool]:
    """The last ``n`` words before a place, and whether there are no more."""
    span = 64 * n
    while True:
        words = text[max(0, at - span) : at].split()
        if len(words) > n or span >= at:  # the first word may be a part of one, unless the text begins there
            return words[-n:], span >= at and len(words) <= n
        span *= 4


def words_after(text: bytes, at: int, n: int) -> tuple[list[bytes], bool]:
    span = 64 * n
    while True:
        words = text[at : at + span].split()
        if len(words) > n or at + span >= len(text):
            return words[:n], at + span >= len(text) and len(words) <= n
        span *= 4


def splits_marks(path: str) -> bool:
    """Whether a tokenizer lowers letters and always parts a run of letters from the marks after it."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    steps = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    parts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    pattern = (parts[0].get("pattern") or {}).get("Regex", "").split("|")
    return steps == ["NFC", "Replace", "Lowercase"] and pattern[-3:] == LETTERS_DIGITS_MARKS and all(p.startswith("'") for p in pattern[:-3])


@lru_cache(maxsize=4)
def _loaded(path: str):
    """The library's tokenizer and whether it splits marks: read once a Python worker, which runs many tasks."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    return library, splits_marks(path)


class WordEncoder(dict):
    """Ids of words as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        super().__init__()
        self.library, parted = _loaded(path)
        self.plain = PLAIN_WORD.fullmatch if parted else lambda word: None
        self.merge = self.library.model.tokenize
        self.letters = byte_letters()

    def together(self, text: bytes) -> bytes:
        """What the library makes of a text as a whole."""
        ids = self.library.encode(text.decode("utf-8"), add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def __missing__(self, word: bytes) -> bytes:
        plain = self.plain(word)
        if plain is None:
            ids = self.together(word)
        elif plain[2] and plain[1]:
            ids = self[plain[1]] + self[plain[2]]
        else:  # one piece of the library's pattern: its merges alone are asked for
            word_bytes = word.decode("utf-8").lower().encode("utf-8")
            ids = _packed([t.id for t in self.merge(word_bytes.decode("latin-1").translate(self.letters))])
        if len(word) <= KEPT_LENGTH:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = ids
        return ids

    def ids(self, text: bytes) -> bytes:
        """Word by word: no merge crosses white space."""
        return b"".join(map(self.__getitem__, text.split()))

    def agrees(self, text: bytes, at: int, ids: bytes, place: int) -> bool:
        """Whether the ids that meet at ``place`` are those of the words around ``at`` when encoded as one string.

        One word on each side to begin with, then twice as many, until they agree or the text ends.
        """
        n = 1
        while True:
            before, all_before = words_before(text, at, n)
            after, all_after = words_after(text, at, n)
            one, other = self.ids(b" ".join(before)), self.ids(b" ".join(after))
            if ids.endswith(one, 0, place) and ids.startswith(other, place) and self.together(b" ".join(before + after)) == one + other:
                return True
            if all_before and all_after:
                return False
            n *= 2

    def joined(self, text: bytes, taken: list[tuple[int, int, int, bytes]]) -> bytes:
        """Ids of a text that holds chunks at ``start`` with known ids between ``first`` and ``last`` in them."""
        out, joins, cursor = bytearray(), [], 0
        for start, first, last, ids in taken:
            if start + first < cursor:
                continue  # the same place twice
            out += self.ids(text[cursor : start + first])
            joins.append((start + first, len(out)))
            out += ids
            cursor = start + last + 1
            joins.append((cursor, len(out)))
        out += self.ids(text[cursor:])
        if all(self.agrees(text, at, out, place) for at, place in joins):
            return bytes(out)
        return self.together(text)


def word_encoder(path: str) -> WordEncoder:
    """For one task; the library's own threads stay off."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordEncoder(path)


# --- whole table ------------------------------------------------------------------------------------


def text_key(docs: DataFrame) -> Column:
    """The name of a text: 128 bits of its SHA-256."""
    return F.substring(F.unhex(F.sha2(texts(docs).cast("binary"), 256)), 1, 16)


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(text_key(docs).alias("text_key"), texts(docs).cast("binary").alias("text"))


class _Seen(set):
    """Passes a text on once a task; forgets when it has met SEEN_TEXTS."""

    def new(self, batch: pa.RecordBatch) -> dict[bytes, bytes]:
        own = {n: t for n, t in zip(batch.column("text_key").to_pylist(), batch.column("text").to_pylist()) if n not in self}
        if len(self) >= SEEN_TEXTS:
            self.clear()
        self.update(own)
        return own


def _chunked(own: dict[bytes, bytes]) -> Iterator[tuple[bytes, int, bytes, bytes]]:
    """``(text_key, start, digest, chunk)`` of the chunks of several texts."""
    parts = list(own.values())
    if any(parts):
        for name, text, cuts in zip(own, parts, cuts_of(parts)):
            for low, high in pairwise(cuts):
                chunk = text[low:high]
                yield name, low, hashlib.blake2b(chunk, digest_size=16).digest(), chunk


def _chunks(docs: DataFrame) -> DataFrame:
    """``(text_key, start, chunk)``: where chunks of which digest lie."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for batch in batches:
            rows = [(name, start, digest) for name, start, digest, _ in _chunked(seen.new(batch))]
            kinds = {"text_key": pa.binary(), "start": pa.int32(), "chunk": pa.binary()}
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [[]] * 3, kinds.values())], names=list(kinds))

    return _named(docs).mapInArrow(task, "text_key binary, start int, chunk binary")


def _owned(docs: DataFrame, owners: DataFrame) -> DataFrame:
    """``(chunk, text_key, data)`` of the chunks of ``owners`` (chunk, text_key).

    A bitmap of FILTER_BITS bits, the same size for any table, keeps nearly all other chunks where they are; a join
    drops the rest.
    """
    bit = F.pmod(F.crc32(F.concat("text_key", "chunk")), F.lit(FILTER_BITS)) + 1  # they are numbered from 1
    rows = owners.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
    bits = bytearray(FILTER_BITS // 8)
    for row in rows.collect():
        low = (row["bucket"] - 1) * len(row["bits"])
        bits[low : low + len(row["bits"])] = row["bits"]
    filled = docs.sparkSession.sparkContext.broadcast(bytes(bits))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, bits = _Seen(), filled.value
        for batch in batches:
            rows = []
            for name, _, digest, chunk in _chunked(seen.new(batch)):
                at = zlib.crc32(name + digest) % FILTER_BITS
                if bits[at >> 3] >> (at & 7) & 1:
                    rows.append((digest, name, chunk))
            kinds = {"chunk": pa.binary(), "text_key": pa.binary(), "data": pa.binary()}
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [[]] * 3, kinds.values())], names=list(kinds))

    found = _named(docs).mapInArrow(task, "chunk binary, text_key binary, data binary")
    return found.join(owners, ["chunk", "text_key"], "left_semi")


def _dealt(docs: DataFrame) -> DataFrame:
    """Compressed texts dealt by their names; equal texts of a task leave it once."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for batch in batches:
            own = seen.new(batch)
            packed = [zlib.compress(t, 1) for t in own.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.binary()), pa.array(packed, pa.binary())], names=["text_key", "packed"])

    return _named(docs).mapInArrow(task, "text_key binary, packed binary").repartition("text_key")


def encoded_texts(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``(text_key, ids)`` of each distinct text; ids are little-endian unsigned 32-bit numbers.

    Rows of one name may come more than once, with equal ids.
    """
    prepared(docs.sparkSession)
    path = tokenizer_path(tokenizer)
    chunks = materialize(_chunks(docs), "chunks")
    place = F.struct("text_key", "start")
    shared = chunks.groupBy("chunk").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last")
    shared = materialize(shared.select("chunk", "first.text_key"), "shared-chunks")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last = word_encoder(path), None
        for batch in batches:
            out = []
            for digest, chunk in zip(batch.column("chunk").to_pylist(), batch.column("data").to_pylist()):
                low, high = white_ends(chunk)
                if low >= 0 and digest != last:  # equal texts of several tasks
                    out.append((digest, low, high, own.ids(chunk[low : high + 1])))
                last = digest
            kinds = {"chunk": pa.binary(), "low": pa.int32(), "high": pa.int32(), "ids": pa.binary()}
            columns = zip(*out) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds.values())], names=list(kinds))

    owned = _owned(docs, shared).select("chunk", "data").repartition("chunk").sortWithinPartitions("chunk")
    known = materialize(owned.mapInArrow(encode, "chunk binary, low int, high int, ids binary"), "encoded-chunks")
    uses = chunks.join(known, "chunk")
    taken = uses.groupBy("text_key").agg(F.collect_set(F.struct("start", "low", "high", "ids")).alias("taken"))
    dealt = _dealt(docs)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = word_encoder(path)
        for batch in batches:
            ids = []
            for packed, parts in zip(batch.column("packed").to_pylist(), batch.column("taken").to_pylist()):
                places = sorted((p["start"], p["low"], p["high"], p["ids"]) for p in parts or ())
                ids.append(own.joined(zlib.decompress(packed), places))
            yield pa.RecordBatch.from_arrays([batch.column("text_key"), pa.array(ids, pa.binary())], names=["text_key", "ids"])

    # The ids of shared chunks are fewer than the texts and are hashed, so texts are not sorted.
    both = dealt.join(taken.hint("shuffle_hash"), "text_key", "left").select("text_key", "packed", "taken")
    return both.mapInArrow(join, "text_key binary, ids binary")


def decoder(path: str):
    """A function from ids to the library's text."""
    library = word_encoder(path).library

    def decode(ids: bytes) -> str:
        numbers = array("I", ids) if array("I").itemsize == 4 else array("L", ids)
        return library.decode(numbers.tolist(), skip_special_tokens=False)

    return decode


def decoded_texts(encoded: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``(text_key, ids, decoded)``: what the library makes of the ids."""
    path = tokenizer_path(tokenizer)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = decoder(path)
        for batch in batches:
            decoded = [decode(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("text_key"), batch.column("ids"), pa.array(decoded, pa.string())], names=["text_key", "ids", "decoded"])

    return encoded.mapInArrow(task, "text_key binary, ids binary, decoded string")


def encoding_digests(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``, a row a document."""
    found = decoded_texts(encoded_texts(docs, tokenizer), tokenizer).select(
        "text_key", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
    # Stored, so that the join's two sides come from shuffles alone and a text that many rows share is split.
    found = materialize(found.dropDuplicates(["text_key"]), "encoding-digests")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_key(docs).alias("text_key"))
    return rows.join(found, "text_key").select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
