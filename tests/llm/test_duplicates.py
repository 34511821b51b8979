"""SimHash, suffix arrays, Order MinHash and decontamination against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from conftest import awkward_rows, words

from threadlens.llm import decontamination, order_minhash, simhash, suffix_dedup
from threadlens.llm import suffix_array as sa
from threadlens.llm.components import components

# --- SimHash --------------------------------------------------------------------------------------


def plain_fingerprint(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    own = [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in lower).split(" ") if w]
    if not own:
        return 0
    shingles = [" ".join(own[i : i + 3]) for i in range(max(1, len(own) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_roots(fps, distance=3):
    left, roots = set(fps), {}
    while left:
        start = min(left)
        group, todo = {start}, [start]
        while todo:
            x = todo.pop()
            near = {y for y in left - group if bin(x ^ y).count("1") <= distance}
            group |= near
            todo += near
        roots |= {x: start for x in group}
        left -= group
    return roots


def unsigned(x):
    return x & (2**64 - 1)


def test_near_duplicates(awkward, nothing):
    rows = [(r["doc_id"], plain_fingerprint(r["text"])) for r in awkward.collect()]
    roots = plain_roots([f for _, f in rows])
    least = {}
    for i, f in rows:
        if i is not None:
            least[roots[f]] = min(least.get(roots[f], i), i)
    want = Counter((i, format(f, "016x"), least.get(roots[f])) for i, f in rows)
    assert Counter(map(tuple, simhash.near_duplicates(awkward).collect())) == want
    assert simhash.near_duplicates(nothing).collect() == []
    kept = simhash.representatives(awkward)
    assert kept.columns == awkward.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(least.get(x) for x in set(roots.values()))
    assert simhash.representatives(nothing).collect() == []


@pytest.mark.parametrize("bucket", [2000, 8])
@pytest.mark.parametrize("plan", [(4, None), (3, None), (2, None), (4, [2, 0, -1, -1]), (4, [1, -1, 0, 0])])
def test_links_hold_every_link(spark, plan, bucket):
    rng = random.Random(4)
    fps = [rng.getrandbits(64) for _ in range(60)]
    centre = rng.getrandbits(64)
    for _ in range(250):  # chains and a crowd around one value
        fps.append(rng.choice(fps[-40:]) ^ sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3]))))
        fps.append(centre ^ sum(1 << b for b in rng.sample(range(20), rng.choice([1, 2, 4]))))
    parts, thresholds = plan
    order = list(range(64))
    rng.shuffle(order)
    bits = [sorted(p.tolist()) for p in np.array_split(np.array(order), parts)]
    thresholds = thresholds or {4: [0] * 4, 3: [0, 1, 0], 2: [1, 1]}[parts]
    df = spark.createDataFrame([(x - 2**64 if x >> 63 else x,) for x in sorted(set(fps))], "fp long")
    found = [(unsigned(r["u"]), unsigned(r["v"])) for r in simhash.links(df, bucket=bucket, plan=(bits, thresholds)).collect()]
    assert all(bin(u ^ v).count("1") <= 64 for u, v in found)
    joined = {unsigned(r["node"]): unsigned(r["root"]) for r in components(spark.createDataFrame([(u - 2**64 if u >> 63 else u, v - 2**64 if v >> 63 else v) for u, v in found], "u long, v long")).collect()}
    groups = lambda root: {frozenset(y for y in set(fps) if root(y) == root(x)) for x in set(fps)}
    roots = plain_roots(fps)
    assert groups(lambda x: joined.get(x, x)) == groups(roots.get)


def test_thresholds_are_chosen_by_cost():
    odds = [np.full(16, 0.9)] * 4
    _, even = simhash.allocate(10**6, [1e7] * 4, odds, 3)
    assert sum(even) == 0
    _, uneven = simhash.allocate(10**9, [1e18, 1e10, 1e10, 1e10], odds, 3)
    assert uneven[0] == -1 and sum(uneven) == 0


def test_correlated_bits_share_a_part():
    rng = np.random.default_rng(1)
    bits = rng.integers(0, 2, (4000, 64))
    bits[:, 40] = bits[:, 3]
    both = bits.T @ bits
    parts = simhash.group_bits(both, 4000, 4)
    assert sorted(b for p in parts for b in p) == list(range(64)) and {len(p) for p in parts} == {16}
    assert any({3, 40} <= set(p) for p in parts)


def test_components_of_a_long_chain(spark):
    n = 700
    edges = [(i, i + 1) for i in range(n)] + [(10_000 + i, 10_000) for i in range(1, 300)]
    roots = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert len({roots[i] for i in range(n + 1)}) == 1 and len({roots[10_000 + i] for i in range(300)}) == 1
    assert len(set(roots.values())) == 2
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


# --- suffix arrays --------------------------------------------------------------------------------


@pytest.mark.parametrize("leaf", [0, 1 << 19])
@pytest.mark.parametrize("digits", [2, 1500])
def test_suffix_arrays(monkeypatch, leaf, digits):
    monkeypatch.setattr(sa, "LEAF", leaf)
    monkeypatch.setattr(sa, "ONE_DIGIT", digits)
    rng = random.Random(leaf + digits)
    for _ in range(40):
        n, symbols = rng.choice([1, 70, 200, 400]), rng.choice([1, 2, 3, 10, 200])
        text = [rng.randint(1, symbols) for _ in range(n)]
        if rng.random() < 0.4:
            part = text[: rng.randint(1, 30)]
            text = (part * (n // len(part) + 1))[:n]
        text.append(0)
        order = sa.suffix_array(np.array(text))
        want = sorted(range(len(text)), key=lambda i: text[i:])
        assert order.tolist() == want
        before, common = sa.common_prefixes(np.array(text), order)
        for one, two in zip(want[1:], want):
            k = 0
            while max(one, two) + k < len(text) and text[one + k] == text[two + k]:
                k += 1
            assert (before[one], common[one]) == (two, k)


def plain_removal(rows, length):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[p : p + length] for _, b in data for p in range(len(b) - length + 1))
    out = []
    for i, b in data:
        gone = np.zeros(len(b) + 1, dtype=bool)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((i, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("settings", [{}, {"shard": 1000}, {"crowd": 1}])
def test_repeats(awkward, settings):
    rows = [(r["doc_id"], r["text"]) for r in awkward.select("doc_id", "text").collect()]
    assert Counter(map(tuple, suffix_dedup.repeat_digests(awkward, **settings).collect())) == plain_removal(rows, 200)


def test_repeats_at_every_offset(spark, monkeypatch):
    """Random texts over few letters share passages of all lengths around the limit; pieces are short, so they overlap."""
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    rng = random.Random(8)
    pool = ["".join(rng.choice("ab cdeé") for _ in range(n)) for n in (150, 199, 200, 201, 230, 400, 900)]
    rows = []
    for i in range(60):
        text = "".join(rng.choice(["", "".join(rng.choice("xyz uvw") for _ in range(rng.randint(0, 300))), rng.choice(pool), rng.choice(pool)[rng.randint(0, 60) :]]) for _ in range(5))
        rows.append((i, text))
    want = plain_removal(rows, 200)
    for settings in ({}, {"crowd": 1}, {"shard": 500}):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        assert Counter(map(tuple, suffix_dedup.repeat_digests(df, **settings).collect())) == want


def test_texts_without_repeats(awkward, nothing):
    assert suffix_dedup.repeat_digests(nothing).collect() == []
    assert suffix_dedup.without_repeats(nothing).columns == nothing.columns
    docs = awkward.selectExpr("*", "length(text) AS n_chars")
    found = suffix_dedup.without_repeats(docs)
    assert found.columns == docs.columns and found.count() == docs.count()
    rows = {r["doc_id"]: r for r in found.collect() if r["doc_id"] not in (None, 5, 6)}
    assert rows[1]["text"] == "" and rows[11]["text"] == "" and rows[12]["text"] == "x"
    assert rows[2]["text"] == "" and rows[15]["text"] == dict(awkward_rows())[15] and rows[15]["k"] == "clash"
    assert all(r["n_chars"] == len(r["text"]) for r in found.collect())


# --- Order MinHash --------------------------------------------------------------------------------


def plain_order_minhash(spark, texts):
    """The same signatures row by row; only the hash function is Spark's own."""
    import re

    hash_of = lambda rows, schema, expr: [r[0] for r in spark.createDataFrame(rows, schema).selectExpr(expr).collect()]
    out = []
    for text in texts:
        runs = re.findall(r"[^ \t\n\x0b\f\r]+", text or "")
        tokens = [t for r in runs for t in ([r] if len(r) <= 32 else [r[i : i + 8] for i in range(len(r) - 7)])]
        if not tokens:
            out.append("0" * 256)
            continue
        coded = hash_of([(t,) for t in tokens], "t string", "xxhash64(t)")
        count = max(1, len(tokens) - 2)
        grams = hash_of([tuple((coded + [None, None])[i : i + 3]) for i in range(count)], "a long, b long, c long", "xxhash64(a, b, c)")
        short = [(g & (2**64 - 1)) << 31 & (2**64 - 1) for g in grams]
        short = [(s - 2**64 if s >> 63 else s) >> 31 for s in short]  # as packed with the place
        seen, numbered = Counter(), []
        for place, g in enumerate(short):
            numbered.append((g, seen[g], place + 1))
            seen[g] += 1
        rings = hash_of([(g, o) for g, o, _ in numbered], "g long, o int", "shiftrightunsigned(xxhash64(g, o), 32)")
        ring = sorted((r, p) for r, (_, _, p) in zip(rings, numbered))
        entries = []
        for i in range(64):
            mark = i << 26
            at = sum(1 for r, _ in ring if r < mark)
            chosen = sorted(((ring[(at + j) % len(ring)]) for j in range(min(2, len(ring)))), key=lambda x: x[1])
            entries.append([r for r, _ in chosen])
        hashes = hash_of([(e,) for e in entries], "e array<long>", "xxhash64(e)")
        out.append("".join(format(h & 0xFFFF, "04x") for h in hashes))
    return out


def test_order_minhash_by_hand(spark, awkward):
    from pyspark.sql import functions as F

    short = awkward.where("length(text) < 1600 OR text IS NULL").select("doc_id", "text").distinct()
    rows = order_minhash.with_fingerprint(short, F.col("text")).collect()
    assert [r["fingerprint"] for r in rows] == plain_order_minhash(spark, [r["text"] for r in rows])


def test_edited_fingerprints(awkward, nothing, spark):
    got = order_minhash.edited_fingerprints(awkward).collect()
    rows = sorted(((r["doc_id"], r["text"] or "") for r in awkward.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r["doc_id"] for r in sorted(got, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))] == [i for i, _ in rows]
    single = [n for n, (i, _) in enumerate(rows) if all(sum(x == i2 for x, _ in rows) == 1 for i2 in (i, rows[(n + 1) % len(rows)][0]))]
    by = {r["doc_id"]: r for r in got}
    for n in single:
        doc_id, text = rows[n]
        following = rows[(n + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert by[doc_id]["n_chars"] == len(text)
        assert by[doc_id]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    texts = {}
    for r in got:
        assert 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1
        assert (r["fingerprint"] == r["edited_fingerprint"]) <= (r["near_edited"] == 1)
    assert by[15]["near_edited"] > 0.3 > by[15]["near_next"]
    for i, text in rows:
        texts.setdefault(text, set()).update(r["fingerprint"] for r in got if r["doc_id"] == i and rows.count((i, text)) and r["n_chars"] == len(text))
    assert len(texts[""]) == 1 and len(texts[dict(awkward_rows())[1]]) == 1
    assert order_minhash.edited_fingerprints(nothing).collect() == []
    one = order_minhash.edited_fingerprints(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).collect()
    assert one[0]["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()


@pytest.mark.parametrize("size", [1, 3, 256])
def test_next_row_in_buckets(spark, size):
    rng = random.Random(6)
    ids = rng.sample(range(-(10**15), 10**15), 90) + [7, 7, 7]
    rows = [(i, f"t{n}") for n, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = order_minhash.with_next(df, ["text"], rows_a_bucket=size).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(rows)
    following = {r["text"]: r["next_text"] for r in got}
    at, seen = rows[0][1], []
    for _ in rows:
        seen.append(at)
        at = following[at]
    own = dict((t, i) for i, t in rows)
    assert len(set(seen)) == len(rows)  # one ring through all rows
    turn = [own[t] for t in seen]
    low = turn.index(min(turn))
    assert turn[low:] + turn[:low] == sorted(ids)


def test_order_matters_more_than_words(spark):
    from pyspark.sql import functions as F

    rng = random.Random(9)
    own = words(rng, 400, 10**6).split()
    shuffled = own[:]
    for low in range(0, 400, 4):  # the same runs of words, in another order
        shuffled[low : low + 4] = own[396 - low : 400 - low]
    edited = own[:200] + words(rng, 10, 10**6).split() + own[210:]
    rows = [("same", " ".join(own)), ("edited", " ".join(edited)), ("shuffled", " ".join(shuffled))]
    df = spark.createDataFrame(rows, "name string, text string")
    found = {r["name"]: r["fingerprint"] for r in order_minhash.with_fingerprint(df, F.col("text")).collect()}
    near = lambda x: sum(found["same"][i : i + 4] == found[x][i : i + 4] for i in range(0, 256, 4)) / 64
    assert near("edited") > 0.6 > 0.3 > near("shuffled")


def test_unspaced_text_keeps_its_likeness(spark):
    from pyspark.sql import functions as F

    rng = random.Random(10)
    own = "".join(chr(rng.randrange(0x4E00, 0x9FA0)) for _ in range(4000))
    code = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ+/0123456789") for _ in range(4000))
    rows = [("a", own, own[:20] + "x" + own[20:]), ("b", code, code[:7] + code[8:]), ("c", "x" * 32 + " y", "x" * 33 + " y"), ("d", own, own[::-1])]
    df = spark.createDataFrame(rows, "name string, one string, two string")
    both = order_minhash.with_fingerprint(order_minhash.with_fingerprint(df, F.col("one"), "f"), F.col("two"), "g")
    near = dict(both.select("name", order_minhash.likeness(F.col("f"), F.col("g"))).collect())
    assert near["a"] > 0.9 and near["b"] > 0.9 and near["c"] < 1 and near["d"] < 0.3


# --- decontamination ------------------------------------------------------------------------------


BENCH = [
    (1, "Tom has 12 apples and buys 30 more apples for 5 dollars each. How many apples does Tom have now?"),
    (2, "the quick brown fox jumps over the lazy dog while nobody in the garden is watching it"),
    (3, "two words"), (4, ""), (5, None), (None, "an item without any id still is one that counts for somebody"),
]


def test_leaks(spark, nothing):
    noise = words(random.Random(1), 200)
    item = BENCH[0][1]
    docs = [
        (1, f"{noise} {item} {noise}"),
        (2, f"{noise}\n{item.replace('Tom', 'Ann').replace('12', '99').replace('30', '7').replace('dollars', 'euros')} {noise}"),
        (3, item.replace("many apples does Tom", "many apples does Bob")),  # Tom stands for two names
        (4, noise), (5, None), (6, ""), (7, "Two words."), (8, f"{noise} two words {noise}"),
        (9, " ".join(f"{noise[:50]}, {BENCH[1][1].upper()};" for _ in range(40))),
        (10, BENCH[1][1][: len(BENCH[1][1]) // 2]), (None, f"so {BENCH[5][1]}."), (11, f"{item} {item.replace('12', '13')}"),
        (11, noise), (1, f"{noise} {item} {noise}"),
    ]
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, hash string").repartition(3)
    bench = spark.createDataFrame([(*b, 1) for b in BENCH], "item_id long, text string, place int")
    for limit in (1 << 20, 0):
        rows = decontamination.leaks(frame, bench, broadcast=limit).collect()
        found = {(r["doc_id"], r["item_id"]): r for r in rows}
        assert set(found) == {(1, 1), (2, 1), (7, 3), (9, 2), (None, None), (11, 1)}
        assert len(rows) == 6
        assert found[1, 1]["coverage"] == 1 and found[1, 1]["n_changed"] == 0
        assert found[2, 1]["n_changed"] >= 4
    kept = decontamination.without_leaks(frame, bench)
    assert kept.columns == frame.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5, 6, 8, 10, 11]
    assert decontamination.leaks(nothing, bench).collect() == []
    assert decontamination.leaks(frame, bench.limit(0)).collect() == []


def test_whole_passages_are_found(spark, sf01):
    docs = spark.read.parquet(f"{sf01}/documents.parquet")
    bench = spark.read.parquet(f"{sf01}/benchmark.parquet")
    squeeze = lambda t: " ".join(t.lower().split())
    items = [(b["item_id"], squeeze(b["text"])) for b in bench.collect()]
    want = {(d["doc_id"], i) for d in docs.collect() for i, t in items if t in squeeze(d["text"])}
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs, bench).collect()}
    assert want and want <= got and len(got - want) <= 2


def found_items(spark, items, docs):
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(frame, bench).collect()}


def test_changed_names_begin_sentences(spark):
    item = "Tom has 5 apples in a basket. Tom buys 7 more at the shop. How many apples does Tom have now?"
    other = item.replace("5", "31").replace("7", "12")
    noise = words(random.Random(1), 40)
    docs = [
        f"{noise} {other.replace('Tom', 'Ann')} {noise}", f"{noise}. {other.replace('Tom', 'Ann Lee')}", other.replace("Tom buys", "Bob buys").replace("does Tom", "does Eve"),
        f"Problem {other.replace('Tom', 'Ann')} {noise}", other.replace("Tom", "Ann").replace("12", "twenty five"), noise,
    ]
    assert found_items(spark, [item], docs) == {(0, 0), (1, 0), (3, 0), (4, 0)}
    # The other way round, and with words that begin sentences but are no names.
    two = "When Ann Lee has twenty-five coins left. Then Ann Lee gives two hundred to the poor. May Ann Lee still buy bread?"
    assert found_items(spark, [two], [noise + " " + two.replace("Ann Lee", "Tom").replace("twenty-five", "8"), two.lower().replace("ann lee", "Ann Lee")]) == {(0, 0), (1, 0)}


def test_short_items_inside_longer_texts(spark):
    noise = words(random.Random(5), 30)
    items = ["Capital of France?", "Ann Lee works here", "yes no", "five apples and pears"]
    docs = [
        f"{noise} Capital of France? {noise}", f"{noise} the capital of France {noise}", f"{noise} Capital of Spain? {noise}",  # another value
        f"{noise} then Ann Lee works here {noise}", f"{noise} then Ann Lee works hard {noise}", f"{noise} yes no {noise}", "yes no",
        f"{noise} five apples and pears", f"{noise} six apples and pears", "Capital of Spain?", f"Population of France. Capital of France {noise}", noise, "", None,
    ]
    assert found_items(spark, items, docs) == {(0, 0), (1, 0), (3, 1), (6, 2), (7, 3), (9, 0), (10, 0)}
    frame = spark.createDataFrame([(None, docs[0]), (None, docs[0])], "doc_id long, text string")
    bench = spark.createDataFrame([(None, items[0])], "item_id long, text string")
    assert decontamination.without_leaks(frame, bench).collect() == []


def test_values_that_coincide(spark):
    item = "Ann picks 3 apples and 4 pears before noon and then carries all of them home to her mother."
    assert found_items(spark, [item], [item.replace("3", "5").replace("4", "5")]) == {(0, 0)}
    rest = " ".join(f"v{i}" for i in range(50))
    twice = f"Ann picks 3 apples and later on she also takes 3 pears {rest}"
    docs = [twice.replace("3 apples", "5 apples").replace("3 pears", "8 pears"), f"{twice[:20]} {rest[:90]}"]
    assert found_items(spark, [twice], docs) == {(0, 0)}
    # Windows that hold a value of several meanings are no evidence.
    assert found_items(spark, ["a 1 b 1 c 1 d 1 e 1 f"], ["a 1 b 2 c 3 d 4 e 5 f", "a 7 b 7 c 7 d 7 e 7 f"]) == {(1, 0)}


def test_readings_against_brute_force():
    rng = random.Random(2)
    tokens, choices, window = decontamination.Tokens(), decontamination._choices(5), 5
    for n in (1, 3, 4, 5, 6, 30):
        for _ in range(40):
            text = " ".join(rng.choice(["Ann", "Lee", "ran", "home.", "When", "5", "two", "*"]) for _ in range(n))
            template = tokens.read(text)
            units = len(template.first)

            def paths(u, left, choice, bit):
                if left == 0 or u == units:
                    yield [], choice
                    return
                for rest, c in paths(u + 1, left - 1, choice, bit + 1):
                    yield [template.codes[u]] + rest, c
                if template.either[u]:
                    own = [template.plain[u]] + [tokens.name] * int(template.sizes[u] > 1)
                    for rest, c in paths(u + 1, max(0, left - len(own)), choice | 1 << bit, bit + 1):
                        yield (own + rest)[:left], c

            want = set()
            for u in range(units):
                for path, c in paths(u, window, 0, 0):
                    if c and (len(path) == window or u == 0 and units < window):
                        want.add((int(decontamination.window_hashes(np.array(path, np.uint64), window)[0]), u, c))
            before = tokens.read("When Ann Lee")
            got = [(int(h), int(p), int(c)) for x in decontamination.other_windows([before, template], window, choices) for h, t, p, c in zip(*x) if t]
            assert sorted(got) == sorted(want)


def test_stages_keep_the_values_of_all_columns(spark):
    rng = random.Random(9)
    names = ["_id", "_hash", "_key", "a.b", "id", "none", "hash", "row", "k", "key", "revised"]
    rows = [(i, " ".join("w%d" % rng.randrange(10**6) for _ in range(80)), *[f"{c}{i}" for c in names]) for i in range(10, 18)]
    rows.append((30, rows[0][1], *["copy" for _ in names]))
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in names))
    items = spark.createDataFrame([(1, "What is the capital of a land that nobody knows by its name?")], "item_id long, text string")
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == rows[:-1]
    for stage in (suffix_dedup.without_repeats(kept), decontamination.without_leaks(kept, items)):
        assert stage.columns == docs.columns and sorted(map(tuple, stage.collect())) == rows[:-1]
