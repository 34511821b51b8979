"""Aligned tokenizers, reused chunks and the filter audit against plain Python over the libraries themselves."""

import bisect
import hashlib
import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import *  # noqa: F403
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from threadlens.llm import alignment, chunk_reuse, document_terms, filter_audit
from threadlens.llm.tokens import byte_letters, tokenizer_path

A_PATH, B_PATH, WORD_PATH = (tokenizer_path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"))
PLAIN = st.lists(
    st.sampled_from(
        list("abZéß9.,;:!?'’\"-_|▁İſÅ \n\t\r\x0b\x0c\x1c\x85 ́ 　﻿é😀ªµ²½\x00")
        + ["'s", "'ll", "<|endoftext|>", "<|startoftext|>", "<s>", "<unk>", "<0x41>", "  ", " the", ";\r\n", "//\r", "▁▁", "{\r"]
    ),
    max_size=14,
).map("".join)


# --- alignment --------------------------------------------------------------------------------------

ALIGNER = alignment.Aligner(A_PATH, B_PATH)
LIBRARY_A, LIBRARY_B = Tokenizer.from_file(A_PATH), SentencePieceProcessor(model_file=B_PATH)
LIBRARY_A.encode_special_tokens = True
BYTE_OF = {letter: byte for byte, letter in byte_letters().items()}


def piece_bytes(i):
    piece = LIBRARY_B.id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", piece) else piece.replace("▁", " ").encode()


def plainly_aligned(text):
    """(A tokens, B tokens, groups) of a whole text."""
    if not text:
        return [], [], []
    a, b = LIBRARY_A.encode(" " + text, add_special_tokens=False).ids, LIBRARY_B.encode(text)
    a_bytes = [bytes(BYTE_OF[c] for c in LIBRARY_A.id_to_token(i)) for i in a]
    b_bytes = [piece_bytes(i) for i in b]
    own = (" " + text).encode()
    if b"".join(a_bytes) != own or b"".join(b_bytes) != own:
        return [], [], []
    a_ends, b_ends = (list(itertools.accumulate(map(len, x))) for x in (a_bytes, b_bytes))
    groups, i, j = [], 0, 0
    for cut in sorted(set(a_ends) & set(b_ends)):
        x, y = bisect.bisect_right(a_ends, cut), bisect.bisect_right(b_ends, cut)
        groups.append((a[i:x], b[j:y]))
        i, j = x, y
    return a, b, groups


def plain_alignment(rows):
    own = []
    for doc_id, text in rows:
        a, b, groups = plainly_aligned(text)
        links = Counter((x, y) for left, right in groups for x in left for y in right)
        said = ";".join(",".join(map(str, left)) + "|" + ",".join(map(str, right)) for left, right in groups)
        own.append((doc_id, len(a), len(b), len(groups), links, hashlib.sha256(said.encode()).hexdigest() if said else ""))
    counts = Counter(pair for row in own for pair in row[4])
    most = defaultdict(int)
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    return sorted(
        ((d, a, b, g, sum(links.values()), sum(m for p, m in links.items() if counts[p] == most[p[0]]), sum(m * counts[p] for p, m in links.items()), sha)
         for d, a, b, g, links, sha in own),
        key=repr,
    )


@settings(max_examples=400, deadline=None)
@given(st.lists(PLAIN, min_size=1, max_size=3))
def test_cells_give_what_whole_texts_give(texts):
    for text, cells in zip(texts, ALIGNER.cells(texts)):
        a, b, groups = plainly_aligned(text)
        assert [int(ALIGNER.tokens[cells, k].sum()) for k in range(3)] == [len(a), len(b), len(groups)]
        said = ";".join(",".join(map(str, left)) + "|" + ",".join(map(str, right)) for left, right in groups)
        assert "".join(ALIGNER.groups[c] for c in cells)[:-1] == said


@pytest.mark.parametrize("n", [0, 1, 5, 4095, 4096, 4097, 65536])
def test_bitmaps_round_trip_and_merge(n):
    rng = np.random.default_rng(n)
    places = np.sort(rng.choice(65536, n, replace=False)).astype(np.uint16)
    twice = np.sort(np.concatenate([places, places[::2]]))  # blocks that overlap
    names, counts, bitmaps = alignment.to_bitmaps(np.full(len(twice), 7), twice)
    assert counts.tolist() == ([n] if n else [])
    for bitmap in bitmaps.to_pylist():
        assert len(bitmap) <= 8192 and (alignment.to_places(bitmap) == places).all()


@pytest.mark.parametrize("small", [False, True])
def test_alignment(spark, awkward, monkeypatch, small):
    if small:  # many containers, blocks and forgotten cells
        for name, value in {"LINKED": 500, "BLOCK_CELLS": 40, "KEPT_CELLS": 30, "SCORED": 50}.items():
            monkeypatch.setattr(alignment, name, value)
    found = sorted(map(tuple, alignment.alignment(awkward).collect()), key=repr)
    assert found == plain_alignment([(r["doc_id"], r["text"]) for r in awkward.select("doc_id", "text").collect()])


def test_counts_of_pairs(spark, awkward):
    _, postings = alignment.pair_index(awkward)
    counts = {(r["a"], r["b"]): (r["n_docs"], r["n_links"]) for r in alignment.pair_counts(postings).collect()}
    docs, links = Counter(), Counter()
    for r in awkward.select("text").collect():
        own = Counter((x, y) for left, right in plainly_aligned(r["text"])[2] for x in left for y in right)
        docs.update(own.keys())
        links.update(own)
    assert counts == {p: (docs[p], links[p]) for p in docs}


# --- reused chunks ----------------------------------------------------------------------------------

WORDS = chunk_reuse.WordEncoder(WORD_PATH)
LIBRARY = Tokenizer.from_file(WORD_PATH)


def library_ids(text):
    return np.array(LIBRARY.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=400, deadline=None)
@given(PLAIN)
def test_words_give_what_the_library_gives(text):
    assert WORDS.ids(text.encode()) == library_ids(text)


def test_cuts_depend_on_content():
    rng = np.random.default_rng(3)
    parts = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in (0, 1, 127, 128, 5000, 40_000)] + [b"a" * 20_000]
    cuts = chunk_reuse.cuts_of(parts)
    assert cuts == [chunk_reuse.cuts_of([p])[0] for p in parts]
    for part, own in zip(parts, cuts):
        sizes = np.diff(own)
        assert own[0] == 0 and own[-1] == len(part) and (sizes <= chunk_reuse.MOST).all() and (sizes[:-1] >= chunk_reuse.LEAST).all()
    moved = chunk_reuse.cuts_of([b"some words before " + parts[5]])[0]
    assert len({c - 18 for c in moved} & set(cuts[5])) > 0.9 * len(cuts[5])


def test_joins_are_repaired_or_the_text_is_encoded_whole():
    text = b"Some words here, the cutting of words in their midst  and then more"
    for start, end in ((10, 34), (2, 44), (35, 60)):
        low, high = chunk_reuse.white_ends(text[start:end])
        taken = [(start, low, high, WORDS.ids(text[start + low : start + high + 1]))]
        assert WORDS.joined(text, taken) == library_ids(text.decode())
        # Ids that don't belong there never agree.
        assert WORDS.joined(text, [(start, low, high, WORDS.ids(b"quite other"))]) == library_ids(text.decode())


@pytest.mark.parametrize("bits", [9, 3])
def test_encoding(spark, awkward, monkeypatch, bits):
    if bits == 3:  # many small chunks, shared and not
        monkeypatch.setattr(chunk_reuse, "MASK_BITS", 3)
        monkeypatch.setattr(chunk_reuse, "LEAST", 32)
    found = sorted(map(tuple, chunk_reuse.encoding_digests(awkward).collect()), key=repr)
    wanted = []
    for r in awkward.select("doc_id", "text").collect():
        ids = library_ids(r["text"] or "")
        decoded = LIBRARY.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)
        wanted.append((r["doc_id"], len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert found == sorted(wanted, key=repr)


def test_shared_chunks_are_encoded_once(spark, monkeypatch):
    monkeypatch.setattr(chunk_reuse, "MASK_BITS", 5)
    monkeypatch.setattr(chunk_reuse, "LEAST", 32)
    rng = np.random.default_rng(4)
    passage = " ".join("p%d" % n for n in rng.integers(0, 10**6, 400))
    rows = [(n, f"start {n} {passage} end {n * n}") for n in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    kept = {}
    stored = chunk_reuse.materialize
    monkeypatch.setattr(chunk_reuse, "materialize", lambda df, name: kept.setdefault(name, stored(df, name)))
    found = {r["doc_id"]: r["ids_sha256"] for r in chunk_reuse.encoding_digests(docs).collect()}
    assert found == {d: hashlib.sha256(library_ids(t)).hexdigest() for d, t in rows}
    known = [bytes(r["chunk"]) for r in kept["encoded-chunks"].collect()]
    assert len(known) == len(set(known)) > 20
    in_all = kept["chunks"].groupBy("chunk").count().where("count = 40").count()
    assert in_all > 0.8 * len(known)  # the others lie where cuts have not yet fallen in step


# --- filter audit -----------------------------------------------------------------------------------

ORDERS = ["".join(p) for p in itertools.permutations("ABCDE")]


def plain_audit(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    least = {}
    for d, text, _ in rows:
        if d is not None:
            least[text or ""] = min(least.get(text or "", d), d)
    marked = []
    for d, text, source in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            c for c, failed in {
                "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
                "D": bool(re.search(r"[#$%&*|]", text)), "E": d is not None and least[text] < d,
            }.items() if failed
        }
        marked.append((source or "", fails, d in good, d in toxic))
    out = []
    for part in {m[0] for m in marked}:
        steps, shapley = {}, Counter()
        for order in ORDERS:
            left = [m for m in marked if m[0] == part]
            gone = []
            for step, letter in enumerate(order, 1):
                removed = [m for m in left if letter in m[1]]
                redundant = sum(letter in m[1] for m in gone)
                left = [m for m in left if letter not in m[1]]
                gone += removed
                alone = sum(m[1] == {letter} for m in left + gone)
                steps[order, step] = (len(left), len(removed), redundant, alone, sum(m[2] for m in removed), sum(m[3] for m in removed))
                shapley[letter] += len(removed)
        out += [(part, order, step, *counts, shapley[order[step - 1]]) for (order, step), counts in steps.items()]
    return sorted(out)


@pytest.fixture(scope="module")
def sourced(spark, awkward):
    upper = "SOME CAPITALS and " + " ".join(f"w{n}" for n in range(60))
    more = [(n, t, s) for n, t, s in [(50, upper, "x"), (49, upper, None), (51, upper + " $", "x"), (52, "a b " * 40, "y"), (53, " ".join(f"v{n}" for n in range(70)), "y")]]
    own = awkward.select("doc_id", "text", F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("s"), F.col("doc_id") % 3)).alias("source"))
    return own.union(spark.createDataFrame(more, "doc_id long, text string, source string")).withColumn("a.b", F.lit(1)).repartition(5).persist()


def test_audit(spark, sourced, monkeypatch):
    monkeypatch.setattr(document_terms, "SHARD_TERMS", 300)
    monkeypatch.setattr(document_terms, "BUCKET_DOCUMENTS", 3)
    said = [(1, 1, 0), (6, 1, 1), (6, 0, 1), (50, None, 1), (52, 1, None), (None, 1, 1), (99, 1, 1)]
    labels = spark.createDataFrame(said, "doc_id long, quality int, toxic int")
    found = sorted(map(tuple, filter_audit.filter_interactions(sourced, labels).collect()))
    assert found == plain_audit([(r["doc_id"], r["text"], r["source"]) for r in sourced.collect()], said)


def test_matrix(spark, sourced, monkeypatch):
    monkeypatch.setattr(document_terms, "SHARD_TERMS", 300)
    monkeypatch.setattr(document_terms, "BUCKET_DOCUMENTS", 3)
    dictionary, shards = document_terms.document_terms(sourced)
    words = {(r["bucket"] << 32) + n: w for r in dictionary.collect() for n, w in enumerate(document_terms.words_of(r["dictionary"])) if w}
    assert len(set(words.values())) == len(words)
    found = []
    for r in shards.collect():
        at, terms, counts = (np.frombuffer(r[c], t).tolist() for c, t in (("indptr", "<u4"), ("terms", "<i8"), ("counts", "<u4")))
        for row, low, high in zip(r["rows"], at, at[1:]):
            found.append((bytes(row["digest"]), {words[t]: c for t, c in zip(terms[low:high], counts[low:high])}))
    wanted = [(hashlib.sha256((r["text"] or "").encode()).digest(), dict(Counter((r["text"] or "").encode().split()))) for r in sourced.collect()]
    rows = [Counter((name, frozenset(own.items())) for name, own in side) for side in (found, wanted)]
    assert rows[0] == rows[1]


def test_nothing(nothing, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert alignment.alignment(nothing).count() == 0
    assert chunk_reuse.encoding_digests(nothing).count() == 0
    assert filter_audit.filter_interactions(nothing.withColumn("source", F.lit("x")), labels).count() == 0


def test_words_of_latin_letters_are_merged_alone(monkeypatch):
    plain = ["Élan", "straße", "ÀÞß.", "ÿ", "naïve,", "Plain"]
    other = ["a×b", "é", "ÿ1", "Ā", "日本"]
    expected = {w: WORDS.together(w.encode()) for w in plain + other}
    fresh = chunk_reuse.WordEncoder(WORD_PATH)
    assert fresh.library is WORDS.library
    assert [fresh[w.encode()] for w in other] == [expected[w] for w in other]
    asked, together = [], fresh.together
    monkeypatch.setattr(fresh, "together", lambda word: asked.append(word) or together(word))
    assert [fresh[w.encode()] for w in plain] == [expected[w] for w in plain]
    assert set(asked) <= {b".", b","}
