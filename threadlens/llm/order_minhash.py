"""Order MinHash fingerprints, in DataFrame functions only.

A text is cut into tokens, and every run of ``K`` tokens is a k-mer. Characters without white space between
them are one token if they are at most ``RUN``; of longer ones (text of a script without spaces, encoded
bytes) every ``TOKEN`` characters in a row are a token, overlapping, so that one put in moves no others. Equal k-mers of a text are numbered as they occur, so that how often one
occurs counts. Each numbered k-mer has a place on a ring of 2^32 points. For each of ``WIDTH`` evenly
spaced marks the ``L`` numbered k-mers that follow the mark on the ring are its minimal ones (an order
of its own for every mark); they are put back into text order, and the hash of that tuple is one entry
of the signature. Two entries agree if the texts share those k-mers in the same order, which is what
keeps edit distance small.

All work on a text happens in one row, with two sorts of whole numbers: no explode and no shuffle.

Defined results: null is the empty text; a text without tokens has a signature of its own; equal texts
have equal fingerprints; texts shorter than K tokens are one k-mer. Extra columns stay as they are.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadlens.llm.common import prepared, texts

RUN = 32  # characters of the longest word that is one token
TOKEN = 8  # characters of a token in longer ones
K = 3  # tokens of a k-mer
L = 2  # k-mers of a tuple
WIDTH = 64  # entries of a signature
DIGITS = 4  # hexadecimal digits of an entry

PLACE = 31  # low bits of a packed number: the place in the text, from 1 on; 0 is a mark
RING = 32  # bits of the ring

# Neighbouring rows: about so many rows share a task's window, and at most so many windows are bounded
# by values that pass through the driver.
ROWS_A_BUCKET = 256
BUCKETS = 10_000


def _low(x: Column, bits: int) -> Column:
    return x.bitwiseAND(F.lit((1 << bits) - 1))


def _packed(high: Column, place: Column) -> Column:
    return F.shiftleft(high, PLACE).bitwiseOR(place.cast("long"))


def _indexes(n: Column) -> Column:
    """0 to n - 1; empty for none."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _token_hashes(words: Column) -> Column:
    """Hashes of all tokens of the words, in text order."""
    is_long = lambda w: F.char_length(w) > RUN
    windows = lambda w: F.regexp_extract_all(w, F.lit(rf"(?=(\S{{{TOKEN}}}))"), F.lit(1))
    tokens = F.flatten(F.transform(words, lambda w: F.when(is_long(w), windows(w)).otherwise(F.array(w))))
    return F.transform(F.when(F.exists(words, is_long), tokens).otherwise(words), lambda t: F.xxhash64(t))


def with_fingerprint(df: DataFrame, text: Column, name: str = "fingerprint") -> DataFrame:
    """Add the fingerprint of ``text`` as a string of WIDTH * DIGITS hexadecimal digits."""
    kept = [df[c] for c in df.columns]
    out = df.select(*kept, F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\S+"), F.lit(0)).alias("_words"))
    out = out.select(*df.columns, _token_hashes(F.col("_words")).alias("_words"))

    # k-mers, packed with their place and sorted: equal ones lie together, in text order.
    def kmer(i: Column) -> Column:
        parts = [F.get("_words", i + j) for j in range(K)]
        return _packed(F.xxhash64(*parts), i + 1)

    count = F.when(F.size("_words") > 0, F.greatest(F.size("_words") - (K - 1), F.lit(1))).otherwise(0)
    out = out.select(*df.columns, F.sort_array(F.transform(_indexes(count), kmer)).alias("_kmers"))

    # Where runs of equal k-mers start; the number within the run is the occurrence.
    def differs(i: Column) -> Column:
        here, before = F.get("_kmers", i), F.get("_kmers", i - 1)
        return (i == 0) | (F.shiftright(here, PLACE) != F.shiftright(before, PLACE))

    out = out.select(*df.columns, "_kmers", F.filter(_indexes(F.size("_kmers")), differs).alias("_runs"))

    def on_ring(i: Column, start: Column) -> Column:
        here = F.get("_kmers", i)
        ring = F.shiftrightunsigned(F.xxhash64(F.shiftright(here, PLACE), i - start), 64 - RING)
        return _packed(ring, _low(here, PLACE))

    def of_run(start: Column, run: Column) -> Column:
        end = F.coalesce(F.get("_runs", run + 1), F.size("_kmers"))
        return F.transform(F.sequence(start, end - 1), lambda i: on_ring(i, start))

    # Marks and k-mers sorted together: what follows a mark, cyclically, is minimal for it.
    marks = F.array(*[F.lit((i << RING) // WIDTH << PLACE).cast("long") for i in range(WIDTH)])
    placed = F.sort_array(F.concat(F.flatten(F.transform("_runs", of_run)), marks))
    out = out.select(*df.columns, placed.alias("_ring"))
    marked = F.transform("_ring", lambda x, j: F.when(_low(x, PLACE) == 0, j).otherwise(-1))
    out = out.select(
        *df.columns,
        F.filter("_ring", lambda x: _low(x, PLACE) != 0).alias("_ring"),
        F.filter(marked, lambda j: j >= 0).alias("_marks"),
    )
    size = F.size("_ring")

    def entry(at: Column, mark: Column) -> Column:
        # ``at`` counts the marks before it, too.
        def member(j: Column) -> Column:
            x = F.get("_ring", F.pmod(at - mark + j, size))
            return F.shiftleft(_low(x, PLACE), RING).bitwiseOR(F.shiftright(x, PLACE))

        members = F.transform(F.sequence(F.lit(0), F.least(F.lit(L), size) - 1), member)
        in_text_order = F.transform(F.sort_array(members), lambda x: _low(x, RING))
        return F.lpad(F.lower(F.hex(_low(F.xxhash64(in_text_order), 4 * DIGITS))), DIGITS, "0")

    empty = F.lit("0" * (WIDTH * DIGITS))
    return out.select(*df.columns, F.when(size == 0, empty).otherwise(F.array_join(F.transform("_marks", entry), "")).alias(name))


def likeness(a: Column, b: Column) -> Column:
    """From the share of equal entries, on the scale of single k-mers: 0 to 1."""
    places = F.sequence(F.lit(0), F.lit(WIDTH - 1))
    part = lambda s, i: F.substring(s, i * DIGITS + 1, F.lit(DIGITS))
    same = F.size(F.filter(places, lambda i: part(a, i) == part(b, i)))
    return F.pow(same / F.lit(float(WIDTH)), F.lit(1.0 / L))


def _numbers(values: list[int]) -> Column:
    """A constant array, folded when the plan is made."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _bucket(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most ``key``: a search on two levels. A null key is in bucket 0."""
    if not bounds:
        return F.lit(0)
    width = isqrt(len(bounds)) + 1
    groups = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    table = F.array(*[_numbers(g) for g in groups])  # a lambda over rows of text would not be folded
    upper = F.size(F.filter(_numbers([g[0] for g in groups]), lambda b: b <= key))
    lower = F.size(F.filter(F.element_at(table, upper), lambda b: b <= key))
    return F.when(key.isNull() | (key < bounds[0]), 0).otherwise((upper - 1) * width + lower)


def with_next(df: DataFrame, columns: list[str], rows_a_bucket: int = ROWS_A_BUCKET) -> DataFrame:
    """Add ``next_<column>`` from the next row by ``(doc_id, text)``; the row after the last is the first.

    Rows go to buckets of neighbouring ids, in one shuffle. The first row of each bucket also goes, as
    a copy, behind the last row of the bucket before it. Only the bounds and first ids of the buckets,
    at most BUCKETS of each, pass through the driver.
    """
    keys = df.select("doc_id", F.xxhash64("text").alias("hash"))
    rows = df.count()
    buckets = max(1, min(BUCKETS, rows // rows_a_bucket))
    shares = [i / buckets for i in range(1, buckets)]
    bounds = keys.agg(F.percentile_approx("doc_id", shares, 20 * buckets)).first()[0] if shares else []
    bounds = sorted(set(bounds or []))
    bucket = _bucket(F.col("doc_id"), bounds)
    firsts = keys.groupBy(bucket.alias("bucket")).agg(F.min(F.struct("doc_id", "hash")).alias("key")).collect()
    firsts = sorted((r["bucket"], r["key"]["doc_id"], r["key"]["hash"]) for r in firsts) if rows else []
    copies = [(i, h, firsts[n - 1][0]) for n, (_, i, h) in enumerate(firsts)]  # behind the bucket before; the very first behind the last
    copies = df.sparkSession.createDataFrame(copies, "_id long, _hash long, _behind int")
    hashed = df.withColumn("_h", F.xxhash64("text"))
    found = hashed.join(F.broadcast(copies), hashed["doc_id"].eqNullSafe(copies["_id"]) & (hashed["_h"] == copies["_hash"]), "left")
    own = F.struct(bucket.alias("bucket"), F.lit(0).alias("late"))
    copy = F.struct(F.col("_behind").alias("bucket"), F.lit(1).alias("late"))
    dealt = found.select(*df.columns, "_h", F.explode(F.when(F.col("_id").isNull() & F.col("_hash").isNull(), F.array(own)).otherwise(F.array(own, copy))).alias("_to"))
    order = Window.partitionBy("_to.bucket").orderBy("_to.late", F.asc_nulls_first("doc_id"), "_h", "text")
    led = dealt.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns])
    return led.where(F.col("_to.late") == 0).drop("_h", "_to")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of the text whose second half was replaced by the start of the next one."""
    prepared(docs.sparkSession)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), texts(docs).alias("text"))
    led = with_next(with_fingerprint(rows, F.col("text")), ["text", "fingerprint"])
    n = F.char_length("text").cast("int")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    changed = led.select("doc_id", n.cast("long").alias("n_chars"), "fingerprint", "next_fingerprint", edited.alias("_edited"))
    both = with_fingerprint(changed, F.col("_edited"), "edited_fingerprint")
    return both.select(
        "doc_id", "n_chars", F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
