"""Token ids of whole texts through the tokenizers library, with a cache of repeated chunks.

The byte-level tokenizer splits a text by a pattern before it merges bytes, and no merge crosses a
split. A run of non-space characters with at most one space before it, or a run of spaces, is
always a union of whole splits, so ids of such chunks can be looked up and put together. Any other
tokenizer file is encoded text by text.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache

# White space as the byte-level pattern sees it, some letters, and some marks that are neither letter, digit,
# space nor apostrophe: between such a letter and such a mark there is always a split.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
LETTER = "A-Za-z\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\xff"
MARK = ".,;:!?|*$%&#\"()/"
CHUNK = rf" ?(?:[{LETTER}]+(?=[{MARK}{SPACE}]|\Z)|[^{SPACE}]+)|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]"

# Letters with at most one space before them are one split of the pattern.
WORD = rf" ?[{LETTER}]+"


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: visible Latin-1 characters for themselves, the
    other bytes, in order, for the code points from 256 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + n) for n, b in enumerate(others)}


# Bounds of the chunk cache: entries, and characters of one entry.
CACHED_CHUNKS = 400_000
CACHED_LENGTH = 48


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public vocabulary file lies; every node has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _splits_bytewise(path: str) -> bool:
    """True for a byte-level BPE without normaliser, added prefix or dropout: chunks are independent."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    return (
        pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        and not spec.get("normalizer") and not model.get("dropout") and model.get("type") == "BPE"
    )


@lru_cache(maxsize=4)
def _loaded(path: str):
    """The library's tokenizer and whether its chunks are independent: read once a Python worker, which runs many tasks."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path), _splits_bytewise(path)


class _Chunks(dict):
    """Ids of chunks; one that is not known is encoded when it is asked for."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, chunk: str) -> bytes:
        ids = self.encode(chunk)
        if len(chunk) <= CACHED_LENGTH:
            if len(self) >= CACHED_CHUNKS:
                self.clear()
            self[chunk] = ids
        return ids


def _packed(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, no special tokens added.

    Strings of special tokens inside a text are what the library makes of them: such texts are
    encoded whole, since a special token may hold spaces.
    """

    def __init__(self, path: str):
        self.tokenizer, self.chunked = _loaded(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        self.split = re.compile(CHUNK).findall
        self.word = re.compile(WORD).fullmatch
        self.letters = byte_letters()
        self.space = self.letters[ord(" ")]
        self.merge = self.tokenizer.model.tokenize
        self.known = _Chunks(self._chunk)

    def _whole(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _chunk(self, chunk: str) -> bytes:
        # The library's pattern would leave letters whole, so its merges alone are asked for.
        if chunk.isascii():
            spaced = chunk[0] == " "
            word = chunk[1:] if spaced else chunk
            if not word.isalpha():
                return self._whole(chunk)
            return _packed([t.id for t in self.merge(self.space + word if spaced else word)])
        if not self.word(chunk):
            return self._whole(chunk)
        return _packed([t.id for t in self.merge(chunk.encode().decode("latin-1").translate(self.letters))])

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """One byte string a text, in order."""
        for text in texts:
            if not self.chunked or (self.special and self.special.search(text)):
                yield self._whole(text)
                continue
            yield b"".join(map(self.known.__getitem__, self.split(text)))


def encoder(path: str) -> Encoder:
    """An encoder for one task; the library's own threads stay off."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)
