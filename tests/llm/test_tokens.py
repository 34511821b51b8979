"""Encoder, token files, packing and rollups against the tokenizers library used plainly."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import *  # noqa: F403
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from threadlens.llm import packing, token_files, token_rollup
from threadlens.llm.tokens import Encoder, tokenizer_path

PATH = tokenizer_path()
PLAIN = Tokenizer.from_file(PATH)
OWN = Encoder(PATH)


def ids_of(text):
    return np.array([*PLAIN.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")


def order(rows):
    """By id with nulls first; equal ids in any order that the result shows."""
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


ALPHABET = st.sampled_from(list("abZéß9.,;:!?'’\"-_| \n\t\r\x1c\x85\u00a0\u2003\u3000é😀ªµ²½") + ["'s", "'ll", "<|endoftext|>", "  ", "Don't"])


@settings(max_examples=400, deadline=None)
@given(st.lists(ALPHABET, max_size=40).map("".join))
def test_chunks_give_the_same_ids(text):
    assert np.frombuffer(next(iter(OWN.encode([text]))), "<u4").tolist() == ids_of(text)[:-1].tolist()


def test_cache_overflow(monkeypatch):
    from threadlens.llm import tokens

    monkeypatch.setattr(tokens, "CACHED_CHUNKS", 5)
    texts = ["one two three four five six seven eight", "one two nine ten " * 3, ""]
    assert [len(x) // 4 for x in Encoder(PATH).encode(texts)] == [len(ids_of(t)) - 1 for t in texts]


def test_other_tokenizers_are_encoded_whole():
    path = tokenizer_path("word_bpe_49k.json")
    found = next(iter(Encoder(path).encode(["Some words, don't  split"])))
    assert np.frombuffer(found, "<u4").tolist() == Tokenizer.from_file(path).encode("Some words, don't  split", add_special_tokens=False).ids


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1023, 1024, 1025, 5000])
def test_blocks_round_trip(n):
    ids = (np.random.default_rng(n).zipf(1.3, n) % 50257).astype("<u4")
    if n > 10:
        ids[3], ids[7] = 2**32 - 1, 0
    blocks = token_files.encode_blocks(ids)
    starts = np.cumsum([0, *map(len, blocks)])[:-1]
    assert (token_files.decode_blocks(b"".join(blocks), starts) == ids).all()
    assert len(blocks) == -(-n // token_files.BLOCK)


def test_outliers_are_exceptions_and_blocks_are_small():
    ids = np.full(1024, 100, dtype="<u4")
    ids[::50] = 50_000
    assert len(token_files.encode_blocks(ids)[0]) < 200


def test_a_file_in_parts(tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "FLUSH_IDS", 2048)
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 50257, 9000 if k % 40 == 0 else int(rng.integers(0, 300))).astype("<u4") for k in range(150)]
    writer = token_files.FileWriter(str(tmp_path), "x.pfor")
    for k, ids in enumerate(docs):
        writer.add(k or None, ids.tobytes())
    path, n_docs, n_ids, n_blocks, size = writer.close()
    assert (n_docs, n_ids) == (150, sum(map(len, docs))) and size < 2.6 * n_ids
    reader = token_files.FileReader(path)
    for number, parts in reader.documents():
        assert np.concatenate([*parts, np.empty(0, "<u4")]).tolist() == docs[number].tolist()
    assert reader.null_ids.tolist() == [True] + [False] * 149
    assert reader.ids(1, 2).tolist() == np.concatenate(docs)[1024:2048].tolist()  # any block alone


def test_token_files(awkward, nothing, spark):
    got = [tuple(r) for r in token_files.token_files(awkward).collect()]
    want = [(i, len(ids_of(t)), zlib.crc32(ids_of(t).tobytes())) for i, t, *_ in awkward.collect()]
    assert Counter((r[0], r[2], r[3]) for r in got) == Counter(want)
    got = sorted(got, key=lambda r: r[1])
    assert [r[1] for r in got] == np.cumsum([0, *(r[2] for r in got)])[:-1].tolist()
    assert [r[0] for r in got] == [r[0] for r in order(want)]
    assert token_files.token_files(nothing).collect() == []


def pieces_of(rows, size):
    found = Counter()
    for doc_id, text, *_ in rows:
        ids = ids_of(text)
        first = len(ids) % size or min(size, len(ids))
        cuts = [0, *range(first, len(ids) + 1, size)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            found[doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    return found


def sequences_of(rows, size):
    by = defaultdict(list)
    for *_, length, _, sequence, offset in rows:
        by[sequence].append((offset, length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
    return len(by)


def best_fit(lengths, size):
    free = []
    for length in sorted(lengths, reverse=True):
        fits = [i for i, f in enumerate(free) if f >= length]
        if fits:
            free[min(fits, key=lambda i: free[i])] -= length
        else:
            free.append(size - length)
    return len(free)


@pytest.mark.parametrize("size", [64, 2048])
def test_packing(awkward, nothing, size):
    rows = [tuple(r) for r in packing.pack(awkward, size=size).collect()]
    want = pieces_of(awkward.collect(), size)
    assert Counter(r[:5] for r in rows) == want
    assert sequences_of(rows, size) == best_fit([p[3] for p in want.elements()], size)
    assert packing.pack(nothing, size=size).collect() == []


def test_plan_is_best_fit_decreasing():
    rng = random.Random(3)
    for _ in range(60):
        size = rng.choice([10, 50, 100])
        lengths = [rng.randint(1, size) for _ in range(rng.randint(0, 300))]
        plan = packing.plan(Counter(lengths), size)
        rows = []
        for at, length in enumerate(sorted(lengths, reverse=True)):
            first, sequence, step, offset, own = plan[np.searchsorted(plan[:, 0], at, side="right") - 1]
            assert own == length
            rows.append((length, 0, sequence + (at - first) // step, offset + (at - first) % step * length))
        assert sequences_of(rows, size) == best_fit(lengths, size)


def test_rollup(spark, tmp_path):
    schema = "doc_id long, action string, text string, source string, lang string, extra int"
    batch = lambda *rows: spark.createDataFrame([(*r, 1) for r in rows], schema)
    store = token_rollup.TokenRollup(spark, str(tmp_path / "store"))
    assert store.totals().collect() == []
    assert store.commit("a", batch((1, "upsert", "one two three", "s", "en"), (2, "upsert", None, "s", "en"), (None, "upsert", "x y", None, None)))
    assert store.commit("b", batch((1, "upsert", "one two", "t", "en"), (2, "delete", None, None, None), (9, "delete", None, None, None)))
    again = batch((3, "upsert", "four words are here", "s", "de"), (3, "upsert", "a a", "s", "de"))
    assert store.commit("c", again) and not store.commit("c", again) and not store.commit("a", again)
    assert store.commit("empty", batch().limit(0))
    plain = lambda: {(r["source"], r["lang"], r["tokenizer"]): (r["docs"], r["tokens"], r["bytes"]) for r in store.totals().collect()}
    bpe = lambda text: len(ids_of(text)) - 1
    assert plain() == {
        ("t", "en", "words_1"): (1, 2, 7), ("t", "en", "byte_bpe_50k"): (1, bpe("one two"), 7),
        (None, None, "words_1"): (1, 2, 3), (None, None, "byte_bpe_50k"): (1, bpe("x y"), 3),
        ("s", "de", "words_1"): (1, 4, 19), ("s", "de", "byte_bpe_50k"): (1, bpe("four words are here"), 19),
    }
    # A writer that died before its commit leaves parts that don't count, and the batch can be sent again.
    (tmp_path / "store/commits/batch=c/_SUCCESS").unlink()
    assert ("s", "de", "words_1") not in plain()
    assert store.commit("c", again) and ("s", "de", "words_1") in plain()


def test_maintained_counts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = Counter()
    first = {}
    rows = docs.collect()
    for r in rows:
        first[r["text"]] = min(first.get(r["text"], r["doc_id"]), r["doc_id"])
    for r in rows:
        if first[r["text"]] == r["doc_id"]:
            text = "\n".join(dict.fromkeys(r["text"].split("\n")))
            for name, n in (("words_1", len(text.split())), ("byte_bpe_50k", len(ids_of(text)) - 1)):
                key = r["source"], r["lang"], name
                want[(*key, "docs")] += 1
                want[(*key, "tokens")] += n
                want[(*key, "bytes")] += len(text.encode())
    got = token_rollup.maintained_counts(docs).collect()
    assert {(r["source"], r["lang"], r["tokenizer"], c): r[c] for r in got for c in ("docs", "tokens", "bytes")} == dict(want)


def test_a_worker_reads_the_tokenizer_once():
    first, second = Encoder(PATH), Encoder(PATH)
    assert first.tokenizer is second.tokenizer and first.known is not second.known
    for chunk in ("word", " word", " Élan", "a1", " a1", " ", "\n", "'s", " ."):
        assert second.known[chunk] == second._whole(chunk)
