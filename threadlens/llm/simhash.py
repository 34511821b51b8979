"""SimHash near-duplicates at a bit distance, found by the generalised pigeonhole principle.

Fingerprints: words of the lower-cased (A-Z) text, shingles of SHINGLE words with repeats, XXH64 of
each; a bit is set if it is set in over half of them.

Search. The 64 bits are dealt into parts so that bits which vary together share a part. Part i gets a
threshold t_i >= -1 with sum(t_i) = distance - parts + 1; then two fingerprints within ``distance``
are within t_i on some part (-1: the part is not looked at). Number of parts and thresholds come from
dynamic programming on estimated candidates: pairs that agree on a part are counted exactly over all
fingerprints, and every bit allowed to differ multiplies them by that bit's odds of differing.
Fingerprints are dealt by part and by every value within its threshold; rows that meet are verified.

Copies count once: the search sees distinct fingerprints. A key that more than ``bucket`` of them
share is dealt again by the values of its other bits, cut in distance + 1 pieces (one must agree); what
is still too large is cut into blocks, and pairs of blocks meet. So a task holds a bounded number of
rows, and sends out a spanning forest of the links it found, never all pairs.

Defined results: null and blank texts have fingerprint zero; fewer words than a shingle are one
shingle; null ids keep a null id and never name a component unless all of it is null; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.llm.common import named, prepared, texts
from threadlens.llm.components import components
from threadlens.session import materialize

BITS = 64
SHINGLE = 3  # words
DISTANCE = 3  # bits
SEED = 42
BUCKET = 2_000  # fingerprints that meet in one place
PARTS = (2, 3, 4)  # numbers of parts the plan chooses from

# Cost of comparing two rows that met, measured in rows dealt.
COMPARED = 0.02

LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))


# --- fingerprints ---------------------------------------------------------------------------------


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Unsigned fingerprint of a UTF-8 text."""
    import xxhash

    words = text.translate(LOWER).split()  # on exactly the six ASCII spaces
    if not words:
        return 0
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return hashed(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-shingle] + 1).tolist()]
    total, count = np.zeros(BITS, dtype=np.int64), len(starts)
    stops = ends[shingle - 1 :].tolist()
    for low in range(0, count, 1 << 16):
        hashes = [hashed(joined[s:e], SEED) for s, e in zip(starts[low : low + (1 << 16)], stops[low : low + (1 << 16)])]
        total += _bits(np.array(hashes, dtype="<u8")).sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * total > count).tolist())


def _bits(values: np.ndarray) -> np.ndarray:
    """Rows of 64 zeros and ones, the lowest bit first."""
    return np.unpackbits(values.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, BITS)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp, hash)``; fp is the fingerprint as a signed long, hash one of the text."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), texts(docs).cast("binary").alias("text"), F.xxhash64(texts(docs)).alias("hash"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t, shingle) for t in batch.column("text").to_pylist()]
            fps = np.array(found, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps), batch.column("hash")], names=["doc_id", "fp", "hash"])

    return rows.mapInArrow(task, "doc_id long, fp long, hash long")


# --- plan -----------------------------------------------------------------------------------------


def bit_counts(fps: DataFrame) -> np.ndarray:
    """How many fingerprints have bits i and j both set, over all of them: 64 x 64, whatever the input."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS), dtype=np.int64)
        for batch in batches:
            bits = _bits(batch.column("fp").to_numpy().view(np.uint64)).astype(np.float32)
            total += (bits.T @ bits).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS)), pa.array(total.reshape(-1))], names=["cell", "n"])

    sums = fps.select("fp").mapInArrow(task, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(BITS * BITS, dtype=np.int64)
    for row in sums:
        counts[row["cell"]] = row["n"]
    return counts.reshape(BITS, BITS)


def group_bits(both: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Deal the bits into parts of equal size: each part starts with the strongest pair left and takes what
    varies most with what it has."""
    p = both.diagonal() / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    tie = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(tie, 0)
    left, out = set(range(BITS)), []
    sizes = [len(x) for x in np.array_split(np.arange(BITS), parts)]
    for size in sizes:
        rest = sorted(left)
        own = tie[np.ix_(rest, rest)]
        part = [rest[int(own.sum(axis=1).argmax())]] if size else []
        while len(part) < size:
            rest = sorted(left - set(part))
            part.append(rest[int(tie[np.ix_(rest, part)].sum(axis=1).argmax())])
        left -= set(part)
        out.append(sorted(part))
    return out


def part_value(fp: Column, bits: list[int]) -> Column:
    """The chosen bits, next to each other."""
    value = F.lit(0).cast("long")
    for k, b in enumerate(bits):
        value = value.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, b).bitwiseAND(F.lit(1).cast("long")), k))
    return value


def allocate(n: int, agreeing: list[float], odds: list[np.ndarray], distance: int) -> tuple[float, list[int]]:
    """Cheapest thresholds for the parts, by dynamic programming over parts and what is left of the sum.

    ``agreeing`` is how many ordered pairs agree on each part, ``odds`` each bit's odds of differing.
    """
    def cost(i: int, t: int) -> float:
        if t < 0:
            return 0.0
        series = np.zeros(t + 1)  # elementary symmetric sums: ways to differ in s bits
        series[0] = 1
        for o in odds[i]:
            series[1:] += series[:-1] * o
        rows = n * sum(comb(len(odds[i]), s) for s in range(t + 1))
        return rows + COMPARED * agreeing[i] * series.sum()

    goal = distance - len(agreeing) + 1
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for i in range(len(agreeing)):
        following: dict[int, tuple[float, list[int]]] = {}
        for total, (spent, chosen) in best.items():
            for t in range(-1, distance + 1):
                if total + t <= goal + len(agreeing) and (total + t not in following or spent + cost(i, t) < following[total + t][0]):
                    following[total + t] = (spent + cost(i, t), [*chosen, t])
        best = following
    return best[goal]


def choose(fps: DataFrame, distance: int = DISTANCE) -> tuple[list[list[int]], list[int]]:
    """Parts and thresholds for these fingerprints; every count is over all of them."""
    n = fps.count()
    both = bit_counts(fps)
    differs = 2 * (p := both.diagonal() / max(n, 1)) * (1 - p)
    odds = differs / np.maximum(1 - differs, 1e-9)
    options = [group_bits(both, n, parts) for parts in PARTS if parts <= distance + 1] or [group_bits(both, n, 1)]
    values = F.explode(F.array(*[F.struct(F.lit(k).alias("o"), F.lit(i).alias("i"), part_value(F.col("fp"), bits).alias("v")) for k, option in enumerate(options) for i, bits in enumerate(option)]))
    squares = fps.select(values.alias("x")).groupBy("x").count().groupBy("x.o", "x.i").agg(F.sum(F.col("count").cast("double") * F.col("count")).alias("pairs"))
    agreeing = {(r["o"], r["i"]): r["pairs"] for r in squares.collect()}
    plans = []
    for k, option in enumerate(options):
        spent, thresholds = allocate(n, [agreeing.get((k, i), 0.0) for i in range(len(option))], [odds[b] for b in option], distance)
        plans.append((spent, option, thresholds))
    _, option, thresholds = min(plans, key=lambda x: x[0])
    return option, thresholds


# --- search ---------------------------------------------------------------------------------------


def _flips(width: int, threshold: int) -> list[int]:
    return [sum(1 << b for b in chosen) for s in range(threshold + 1) for chosen in combinations(range(width), s)]


def _dealt(fps: DataFrame, parts: list[list[int]], thresholds: list[int], distance: int, bucket: int) -> DataFrame:
    """``(key, fp)``: where each fingerprint goes; no key has much over ``2 * bucket`` rows."""
    keyed = None
    for i, (bits, t) in enumerate(zip(parts, thresholds)):
        if t < 0:
            continue
        value = part_value(F.col("fp"), bits)
        if t:
            masks = F.split(F.lit(",".join(map(str, _flips(len(bits), t)))), ",").cast("array<bigint>")
            value = F.explode(F.transform(masks, lambda m, value=value: value.bitwiseXOR(m)))
        one = fps.select("fp", F.lit(i).alias("part"), value.alias("value"))
        keyed = one if keyed is None else keyed.union(one)
    keyed = keyed.select("fp", "part", F.xxhash64("part", "value").alias("key"))

    def crowded(rows: DataFrame) -> DataFrame:
        return rows.groupBy("key").count().where(F.col("count") > bucket)

    # The rest of the bits in distance + 1 pieces: two rows within the distance agree on one of them.
    keyed = keyed.join(crowded(keyed).select("key", "count"), "key", "left")
    small = keyed.where(F.col("count").isNull()).select("key", "fp")
    finer = None
    for i, (bits, t) in enumerate(zip(parts, thresholds)):
        if t < 0:
            continue
        rest = [b for b in range(BITS) if b not in bits]
        pieces = [p.tolist() for p in np.array_split(np.array(rest), distance + 1)]
        keys = [F.xxhash64("key", F.lit(j), part_value(F.col("fp"), piece)) for j, piece in enumerate(pieces)]
        one = keyed.where((F.col("part") == i) & F.col("count").isNotNull()).select("fp", F.explode(F.array(*keys)).alias("key"))
        finer = one if finer is None else finer.union(one)
    # Still too many: blocks of about a bucket, and every pair of blocks.
    finer = finer.join(crowded(finer).select("key", "count"), "key", "left")
    blocks = F.ceil(F.col("count") / bucket).cast("int")
    block = F.pmod(F.xxhash64("fp", F.lit(1)), blocks).cast("int")
    pair = F.transform(F.sequence(F.lit(0), blocks - 1), lambda c: F.xxhash64("key", F.least(block, c), F.greatest(block, c)))
    large = finer.where(F.col("count").isNotNull()).select(F.explode(pair).alias("key"), "fp")
    return small.union(finer.where(F.col("count").isNull()).select("key", "fp")).union(large)


def _forest(keys: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among neighbouring rows of equal key; keys are sorted."""
    label = np.arange(len(fps))
    at, d = np.arange(len(fps)), 0
    while True:
        d += 1
        at = at[at + d < len(fps)]
        at = at[keys[at + d] == keys[at]]
        if not len(at):
            break
        near = at[np.bitwise_count(fps[at] ^ fps[at + d]) <= distance]
        apart = near[label[near] != label[near + d]]
        if len(apart):
            parent = np.arange(len(fps))

            def find(x: int) -> int:
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            for a, b in zip(label[apart].tolist(), label[apart + d].tolist()):
                a, b = find(a), find(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            while True:
                further = parent[parent]
                if (further == parent).all():
                    break
                parent = further
            label = parent[label]
    linked = np.flatnonzero((label != np.arange(len(fps))) & (fps[label] != fps))
    return fps[linked], fps[label[linked]]


def links(fps: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET, plan: tuple | None = None) -> DataFrame:
    """``(u, v)`` links whose components are those of all links within ``distance`` among distinct ``fp``."""
    parts, thresholds = plan or choose(fps, distance)
    dealt = _dealt(fps.select("fp"), parts, thresholds, distance, bucket)
    rows = dealt.repartition("key").sortWithinPartitions("key")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)

        def out(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
            pairs = np.unique(np.stack([u, v], axis=1), axis=0).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

        for batch in batches:
            keys = np.concatenate([keys, batch.column("key").to_numpy()])
            fps = np.concatenate([fps, batch.column("fp").to_numpy().view(np.uint64)])
            if len(keys) < 1 << 14 or keys[0] == keys[-1]:
                continue
            cut = int(np.searchsorted(keys, keys[-1]))  # the last key may go on
            yield out(*_forest(keys[:cut], fps[:cut], distance))
            keys, fps = keys[cut:], fps[cut:]
        if len(keys):
            yield out(*_forest(keys, fps, distance))

    return rows.mapInArrow(task, "u long, v long")


def _components(stored: DataFrame, distance: int, bucket: int) -> DataFrame:
    """``(fp, root, component_id)`` of every fingerprint in ``stored`` (doc_id, fp, ...)."""
    classes = materialize(stored.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    roots = components(links(classes, distance, bucket))
    named = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return named.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, a row a document."""
    prepared(docs.sparkSession)
    stored = materialize(fingerprints(docs, shingle).drop("hash"), "fingerprints")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return stored.join(_components(stored, distance, bucket), "fp").select("doc_id", digits.alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """One row of ``docs`` for each component, that with the smallest id (null ids last; of equal ids, the smallest hash of
    the text; of equal rows, any); all columns stay."""
    prepared(docs.sparkSession)
    # The columns are out of the way in one struct, so that none can clash with the key.
    rows = docs.select(
        F.struct(*[named(docs, c) for c in docs.columns]).alias("row"), F.coalesce(docs["doc_id"].cast("long"), F.lit(0).cast("long")).alias("id"),
        docs["doc_id"].cast("long").isNull().alias("none"), F.xxhash64(texts(docs)).alias("hash"),
    )
    stored = materialize(fingerprints(docs, shingle), "fingerprints")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "hash")).alias("key")
    kept = stored.join(_components(stored, distance, bucket), "fp").groupBy("root").agg(least)
    key = ["id", "none", "hash"]
    kept = kept.select(F.coalesce("key.doc_id", F.lit(0).cast("long")).alias("id"), F.col("key.doc_id").isNull().alias("none"), "key.hash")
    # Join and choice among equal rows deal the texts by the same key: once.
    found = rows.join(kept, key, "left_semi").dropDuplicates(key)
    return found.select(*[F.col("row")[c].alias(c) for c in docs.columns])
