"""Benchmark decontamination by templates.

Words become template tokens: numbers, units and names are typed placeholders, other words are
themselves, lower-cased and without marks around them. A name is a run of capitalised words without marks
between them; spelled numbers that follow a number belong to it. A capitalised word that begins a sentence
or line may be a name or not, so it is read both ways, in documents and items: as (the begin of) a name, and
as itself, before what is left of the run. Every run of WINDOW tokens is a template window, and windows of
documents and benchmark items, those of all readings, are hash-joined; a window's place counts tokens with
every run as one.

Matches that lie on one diagonal (same distance between the places in document and item) are one reading
of the item in the document. Its slots, the item's placeholders and capitalised words, must be consistent: over the
whole reading, one value of the item stands for one value of the document. Windows that hold a value for which that fails
don't count, so a question with other numbers and names is caught, and a text that only has numbers at the same places is
not. Two values of the item may get the same value. Names of which one begins or ends with the other
(Ann Lee, Ann) count as one value, as runs take in a capitalised word that stands before them. An item is found in a document if
windows of its readings that are left cover at least COVERED of the item's windows.

The windows of the benchmark are broadcast as a sorted array of hashes and, for the join, as a table if
there are at most BROADCAST of them; beyond that all windows are joined by a shuffle. Nothing else
depends on the size.

Short items. An item of fewer than WINDOW tokens has one window. With other values it is found only in texts made of
just these tokens, as "capital of <name>" alone says too little. As it stands, an item of LEAST_INSIDE tokens or more is found
anywhere: such items are hash-joined with windows of their own length, and every slot must hold the item's own value.

Defined results: null is the empty text; an item of fewer than LEAST_INSIDE tokens is found only in texts made of just
these tokens; items without tokens are never found; repeated items and rows
count each for themselves; null ids are kept; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.llm.common import prepared, texts
from threadlens.session import materialize

WINDOW = 5  # tokens
COVERED = 0.8
LEAST_INSIDE = 3  # tokens of an item that is found inside longer texts
BROADCAST = 1 << 20  # benchmark windows
CACHED_WORDS = 400_000
BITMAP = 22  # bits of the first look-up

MARKS = ".,;:!?\"'()[]{}<>|*#_~`"
ENDS = ".:!?"
OTHER_MARKS = "".join(c for c in MARKS if c not in ENDS)
NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*%?")
DIGITS = frozenset("0123456789+-$€£")
UNITS = frozenset(
    "mm cm m km in ft yd mi mg g kg t oz lb lbs ml l gal s sec min h hr hrs ms hz khz mhz ghz w kw mw v kv a j kj cal kcal pa kpa bar k c f °c °f "
    "meter meters metre metres kilometer kilometers kilometre kilometres centimeter centimeters mile miles foot feet inch inches yard yards "
    "gram grams kilogram kilograms pound pounds ounce ounces liter liters litre litres gallon gallons second seconds minute minutes hour hours "
    "day days week weeks month months year years dollar dollars euro euros cent cents percent degree degrees".split()
)
SPELLED = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty "
    "thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
)
WORD, UNIT, COUNT, SPELL, NAME = range(5)  # kinds of a word; all but the first are slots
PIECE = 1 << 13  # windows whose other readings are made at once

FACTOR = np.uint64(0x9E3779B97F4A7C15)
MATCHES = "doc_id long, row_key long, hash long, place int, words array<string>, slots array<int>, ats array<int>"
READINGS = "doc_id long, row_key long, item_id long, item_key long, places array<int>, slots int, changed int"


def _hash(token: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(token.encode(), 0) | 1


def _mix(out: np.ndarray, code: np.ndarray) -> np.ndarray:
    out = (out ^ code) * FACTOR
    return out ^ (out >> np.uint64(31))


def _choices(window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The parts of each set of bits but the empty one: their number, where they begin, and all of them in a row."""
    parts = [[c for c in range(1, 1 << window) if mask & c == c] for mask in range(1 << window)]
    sizes = np.array([len(x) for x in parts])
    return sizes, np.cumsum(sizes) - sizes, np.array([c for x in parts for c in x])


class Template:
    """A text's units (tokens, with every run as one) and its windows in all readings."""

    def __init__(self, raw: list[str], first: np.ndarray, codes: np.ndarray, plain: np.ndarray, kinds: np.ndarray, either: np.ndarray, words: int):
        self.raw, self.first, self.kinds = raw, first, kinds  # first: the word each unit begins with
        self.codes, self.plain = codes, plain  # the code of the unit, and of its first word as itself
        self.either = either  # whether the first word may be no name
        self.sizes = np.diff(np.append(first, words))

    def tokens(self, place: int, choice: int, window: int) -> tuple[list[str], list[int], list[int]]:
        """Values of the window's tokens, which of them are slots, and the words they begin with."""
        values, slots, ats = [], [], []
        for unit in range(place, min(place + window, len(self.first))):
            at, size, kind = int(self.first[unit]), int(self.sizes[unit]), int(self.kinds[unit])
            own = [w.strip(MARKS).lower() for w in self.raw[at : at + size]]
            glue = " " if kind == NAME else "_"
            parts = [(own[0], at)] + [(glue.join(own[1:]), at + 1)] * (size > 1) if choice >> (unit - place) & 1 else [(glue.join(own), at)]
            for value, begin in parts:
                if len(values) < window:
                    if kind != WORD:
                        slots.append(len(values))
                    values.append(value), ats.append(begin)
        return values, slots, ats


def other_windows(templates: list[Template], window: int, choices: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, ...]]:
    """``(hashes, texts, places, choices)`` of the windows in which some first words stand for themselves: bit i of the choice is set if that of the i-th unit does."""
    counts = np.array([len(t.codes) for t in templates], dtype=np.int64)
    ends = np.cumsum(counts)
    either = np.concatenate([t.either for t in templates] or [np.empty(0, bool)])
    at = np.flatnonzero(either)
    if not len(at):
        return
    codes, plain = np.concatenate([t.codes for t in templates]), np.concatenate([t.plain for t in templates])
    double = either & (np.concatenate([t.sizes for t in templates]) > 1)
    text = np.repeat(np.arange(len(templates)), counts)
    begin, end = (ends - counts)[text], ends[text]
    masks = np.zeros(len(codes), dtype=np.int64)
    for j in range(window):
        masks[at[at - j >= begin[at]] - j] |= 1 << j
    name = np.uint64(_hash("<name>"))
    some = np.flatnonzero(masks)
    sizes, offsets, flat = choices
    for low in range(0, len(some), PIECE):
        starts = some[low : low + PIECE]
        parts = sizes[masks[starts]]
        place = np.repeat(starts, parts)
        turn = np.arange(len(place)) - np.repeat(np.cumsum(parts) - parts, parts)
        choice = flat[offsets[masks[place]] + turn]
        unit, rest, used, last = place.copy(), np.zeros(len(place), dtype=bool), np.zeros(len(place), dtype=np.int64), end[place]
        out = np.zeros(len(place), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for _ in range(window):
                inside = unit < last
                here = np.minimum(unit, last - 1)
                bit = np.int64(1) << (unit - place)
                own = inside & ~rest & (choice & bit != 0)
                used |= np.where(own, bit, 0)
                code = np.where(rest, name, np.where(own, plain[here], codes[here]))
                out = _mix(out, np.where(inside, code, np.uint64(0)))
                rest = own & double[here]
                unit += ~rest
        kept = (used == choice) & (inside | ((place == begin[place]) & (last - place < window)))
        place = place[kept]
        yield out[kept].view(np.int64), text[place], place - begin[place], choice[kept]


class Tokens:
    """Template tokens of texts; what is known of a word is remembered."""

    def __init__(self):
        self.known: dict[str, int] = {}
        self.codes = np.zeros(CACHED_WORDS, dtype=np.uint64)
        self.kinds = np.zeros(CACHED_WORDS, dtype=np.int8)
        self.ends = np.zeros(CACHED_WORDS, dtype=bool)
        self.opens = np.zeros(CACHED_WORDS, dtype=bool)
        self.closes = np.zeros(CACHED_WORDS, dtype=bool)
        self.name = np.uint64(_hash("<name>"))

    def _learn(self, raw: str) -> int:
        core = raw.strip(MARKS)
        low = core.lower()
        if core[:1] in DIGITS and NUMBER.fullmatch(core):
            token, kind = "<number>", COUNT
        elif low in SPELLED or "-" in low and SPELLED.issuperset(low.split("-")):
            token, kind = "<number>", SPELL
        elif low in UNITS:
            token, kind = "<unit>", UNIT
        elif core[:1].isupper() and core[1:] == low[1:]:
            token, kind = low, NAME
        else:
            token, kind = low, WORD
        at = self.known[raw] = len(self.known)
        self.codes[at] = _hash(token) if core else 0
        self.kinds[at] = kind
        self.ends[at] = raw.rstrip(OTHER_MARKS)[-1:] in ENDS
        self.opens[at] = raw[:1] in MARKS
        self.closes[at] = raw[-1:] in MARKS
        return at

    def read(self, text: str) -> Template:
        """The text's template; words made of marks only are left out."""
        raw, starts = [], []
        for line in text.split("\n"):
            starts.append(len(raw))
            raw += line.split()
        if not raw:
            none = np.empty(0, np.int64)
            return Template(raw, none, none.astype(np.uint64), none.astype(np.uint64), none, none.astype(bool), 0)
        if len(self.known) + len(raw) > CACHED_WORDS:
            self.known.clear()
        if len(raw) > CACHED_WORDS:  # longer than the memory for words: only its different words count
            need = max(CACHED_WORDS, len(set(raw)))
            for name in ("codes", "kinds", "ends", "opens", "closes"):
                setattr(self, name, np.zeros(need, dtype=getattr(self, name).dtype))
        known = self.known
        for word in raw:
            if word not in known:
                self._learn(word)
        index = np.fromiter(map(known.__getitem__, raw), dtype=np.int64, count=len(raw))
        codes, kinds = self.codes[index], self.kinds[index]
        begins = np.append(True, self.ends[index[:-1]])
        begins[[s for s in starts if s < len(raw)]] = True
        # A word goes on with the run of the word before if no mark stands between them.
        apart = begins | self.opens[index]
        apart[1:] |= self.closes[index[:-1]]
        some = codes != 0
        if not some.all():
            # What words of marks only say counts for the next word.
            at = np.flatnonzero(some)
            told = np.diff(np.append(0, np.cumsum(begins)[at])) > 0
            begins, apart = told, apart[at] | told
            codes, kinds, raw = codes[some], kinds[some], [w for w, s in zip(raw, some.tolist()) if s]
        is_name = kinds == NAME
        joins = np.zeros(len(raw), dtype=bool)
        joins[1:] = ~apart[1:] & ((is_name[1:] & is_name[:-1]) | ((kinds[1:] == SPELL) & ((kinds[:-1] == SPELL) | (kinds[:-1] == COUNT))))
        first = np.flatnonzero(~joins)
        names = is_name[first]
        return Template(raw, first, np.where(names, self.name, codes[first]), codes[first], kinds[first], names & begins[first], len(raw))


def window_hashes(codes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    if not len(codes):
        return np.empty(0, np.int64)
    whole = np.append(codes, np.zeros(max(0, window - len(codes)), np.uint64))
    count = len(whole) - window + 1
    out = np.zeros(count, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(window):
            out = _mix(out, whole[j : j + count])
    return out.view(np.int64)


def _windows(rows: DataFrame, window: int, wanted: np.ndarray | None, item: bool = False, exact: bool = False) -> DataFrame:
    """MATCHES of all windows in all readings, or of those whose hash is in the sorted ``wanted``.

    The windows of an ``item`` begin at as many places as it has with every run read as one token. If it must be
    found ``exact``, readings that part a run are left out, as they push its last word out of its only window.
    """
    small = None if wanted is None else rows.sparkSession.sparkContext.broadcast(wanted)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, choices, hashes, bitmap = Tokens(), _choices(window), None, None
        if small is not None:
            hashes = small.value
            bitmap = np.zeros(1 << BITMAP, dtype=bool)
            bitmap[hashes & ((1 << BITMAP) - 1)] = True

        def hits(own: np.ndarray) -> np.ndarray:
            found = np.arange(len(own))
            if hashes is not None:
                found = found[bitmap[own & ((1 << BITMAP) - 1)]]
                if len(found):
                    at = np.minimum(np.searchsorted(hashes, own[found]), len(hashes) - 1)
                    found = found[hashes[at] == own[found]] if len(hashes) else found[:0]
            return found

        for batch in batches:
            out: list[tuple] = []
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row_key"))))
            templates = [tokens.read(text) for text in batch.column("text").to_pylist()]
            for key, template in zip(keys, templates):
                own = window_hashes(template.codes, window)
                for p in hits(own).tolist():
                    out.append((*key, int(own[p]), p, *template.tokens(p, 0, window)))
            for own, which, places, chosen in other_windows(templates, window, choices):
                for i in hits(own).tolist():
                    t, p = int(which[i]), int(places[i])
                    if exact and any(int(chosen[i]) >> u & 1 and templates[t].sizes[p + u] > 1 for u in range(window)):
                        continue
                    if not item or p <= max(0, len(templates[t].codes) - window):
                        out.append((*keys[t], int(own[i]), p, *templates[t].tokens(p, int(chosen[i]), window)))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32())]
                columns = [pa.array(list(c), kind) for c, kind in zip(zip(*out), kinds)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row_key", "hash", "place", "words", "slots", "ats"])

    return rows.mapInArrow(task, MATCHES)


def one_value(values: set[str]) -> bool:
    """Whether all are one value: the shortest, or names that begin or end with it."""
    least = min(values, key=lambda v: (len(v), v))
    return all(v == least or v.startswith(least + " ") or v.endswith(" " + least) for v in values)


def _consistent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """READINGS without the windows that hold a slot with several values; a reading is as long as its item."""
    for batch in batches:
        out = []
        for *key, found in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row_key", "item_id", "item_key", "found"))):
            values = {}
            for f in found:
                for p in f["pairs"]:
                    values.setdefault(p["item"], set()).add(p["doc"])
            clashes = {item for item, docs in values.items() if not one_value(docs)}
            left = [f for f in found if not any(p["item"] in clashes for p in f["pairs"])]
            if left:
                pairs = {(p["at"], p["item"], p["doc"]) for f in left for p in f["pairs"]}
                changed = {at for at, item, doc in pairs if item != doc}
                out.append((*key, sorted({f["place"] for f in left}), len({p[0] for p in pairs}), len(changed)))
        if out:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.int32()]
            columns = [pa.array(list(c), kind) for c, kind in zip(zip(*out), kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row_key", "item_id", "item_key", "places", "slots", "changed"])


def keyed(docs: DataFrame) -> DataFrame:
    """``(doc_id, row_key, text)``; the key is a hash of the text, so rows of one id are told apart."""
    text = texts(docs)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text).alias("row_key"), text.alias("text"))


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the number of tokens, with every run as one."""
    tokens = Tokens()
    for batch in batches:
        units = [len(tokens.read(text).codes) for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(units, pa.int32())], names=[*batch.schema.names, "units"])


def _found(docs: DataFrame, items: DataFrame, window: int, covered: float, broadcast: int, exact: bool = False) -> DataFrame:
    """Rows of ``leaks`` for windows of one length; ``exact`` ones without a changed value."""
    parts = _windows(items, window, None, item=True, exact=exact).select(
        F.col("doc_id").alias("item_id"), F.col("row_key").alias("item_key"), "hash", F.col("place").alias("item_place"),
        F.col("words").alias("item_words"), F.col("slots").alias("item_slots"), F.col("ats").alias("item_ats"),
    )
    parts = materialize(parts, "benchmark")
    counts = parts.groupBy(F.col("item_id").alias("i"), F.col("item_key").alias("ik")).agg(F.countDistinct("item_place").alias("n_windows"))
    few = parts.count() <= broadcast
    wanted = np.array(sorted(r[0] for r in parts.select("hash").distinct().collect()), dtype=np.int64) if few else None
    found = _windows(keyed(docs), window, wanted)
    found = found.join(F.broadcast(parts) if few else parts, "hash")
    pairs = F.transform("item_slots", lambda j: F.struct(F.get("item_ats", j).alias("at"), F.get("item_words", j).alias("item"), F.get("words", j).alias("doc")))
    reading = ["doc_id", "row_key", "item_id", "item_key", (F.col("place") - F.col("item_place")).alias("diagonal")]
    # One reading has at most as many rows as its item has windows, in all their readings.
    readings = found.groupBy(*reading).agg(F.collect_set(F.struct(F.col("item_place").alias("place"), pairs.alias("pairs"))).alias("found"))
    readings = readings.drop("diagonal").mapInArrow(_consistent, READINGS)
    if exact:
        readings = readings.where("changed = 0")
    names = ["doc_id", "row_key", "item_id", "item_key"]
    most = readings.withColumn("place", F.explode("places")).groupBy(*names).agg(
        F.countDistinct("place").alias("n_found"), F.max("slots").alias("n_slots"), F.max("changed").alias("n_changed")
    )
    both = most.join(counts, most["item_id"].eqNullSafe(counts["i"]) & (most["item_key"] == counts["ik"]))
    share = F.col("n_found") / F.col("n_windows")
    return both.where(share >= covered).select("doc_id", "row_key", "item_id", "n_windows", "n_found", share.alias("coverage"), "n_slots", "n_changed")


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, covered: float = COVERED, broadcast: int = BROADCAST) -> DataFrame:
    """``(doc_id, row_key, item_id, n_windows, n_found, coverage, n_slots, n_changed)``: items found in documents.

    ``n_slots`` is the most slots of one reading, ``n_changed`` how many of them have another value than in the item.
    """
    prepared(docs.sparkSession)
    items = benchmark.select(benchmark["item_id"].cast("long").alias("doc_id"), F.xxhash64(texts(benchmark)).alias("row_key"), texts(benchmark).alias("text"))
    items = materialize(items.dropDuplicates(["doc_id", "row_key"]).mapInArrow(_lengths, "doc_id long, row_key long, text string, units int"), "items")
    found = _found(docs, items.drop("units"), window, covered, broadcast)
    # One row a length, and there are fewer lengths than a window has tokens.
    lengths = [r[0] for r in items.where(F.col("units").between(LEAST_INSIDE, window - 1)).select("units").distinct().collect()]
    if not lengths:
        return found
    found = materialize(found, "long-items")
    keys = ["doc_id", "row_key", "item_id"]
    known = found.select(*[F.col(c).alias(f"_{c}") for c in keys]).distinct()
    for length in sorted(lengths):
        inside = _found(docs, items.where(F.col("units") == length).drop("units"), length, covered, broadcast, exact=True)
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]
        found = found.unionByName(inside.join(known, same, "left_anti"))
    return found


def without_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, covered: float = COVERED) -> DataFrame:
    """``docs`` without the rows in which an item was found; all columns stay."""
    found = leaks(docs, benchmark, window, covered).select(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key")).distinct()
    return docs.join(found, docs["doc_id"].cast("long").eqNullSafe(found["_id"]) & (F.xxhash64(texts(docs)) == found["_key"]), "left_anti")
