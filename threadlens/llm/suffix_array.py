"""Suffix arrays by induced sorting, and permuted common prefixes, in whole-array steps.

A suffix is of type S if it is smaller than the one behind it, else of type L; an S after an L is a
leftmost-smaller (LMS) position. LMS substrings are sorted by one round of inducing, named, and, if
names repeat, the string of names is sorted recursively. From the order of the LMS suffixes a second
round induces that of all suffixes, in linear time.

Inducing goes bucket by bucket; all entries of a bucket that stand already are handled in one array
step, and what they add to the same bucket in further ones. To keep buckets few, a recursive string
writes each name as two digits, which does not change the order. A string of at most ``LEAF`` names ends
the recursion: only the suffixes that still tie are sorted, by ranks of doubling reach.
"""

from __future__ import annotations

from math import isqrt

import numpy as np

ONE_DIGIT = 1_500  # up to so many names are symbols themselves
LEAF = 1 << 19
SMALL = 64


def _types(text: np.ndarray) -> np.ndarray:
    """True for type S; the last symbol is the smallest and S."""
    n = len(text)
    differs = np.append(text[:-1] != text[1:], True)
    smaller = np.append(text[:-1] < text[1:], True)
    ends = np.where(differs, np.arange(n), n)
    ends = np.minimum.accumulate(ends[::-1])[::-1]  # where the run of equal symbols ends
    return smaller[ends]


class _Buckets:
    def __init__(self, text: np.ndarray, is_s: np.ndarray):
        self.text, self.is_s, self.is_l = text, is_s, ~is_s
        counts = np.bincount(text)
        self.ends = np.cumsum(counts)
        self.starts = self.ends - counts
        self.present = np.flatnonzero(counts).tolist()
        self.steps = np.arange(len(text))

    def _push(self, array: np.ndarray, seg: np.ndarray, kind: np.ndarray, at: np.ndarray, down: bool) -> None:
        """Place the left neighbours of ``seg`` that are of ``kind`` into their buckets, in order."""
        left = seg - 1
        left = left[kind[left] & (seg > 0)]
        if not len(left):
            return
        symbols = self.text[left]
        if len(left) > 1:
            order = np.argsort(symbols, kind="stable")
            left, symbols = left[order], symbols[order]
            firsts = np.flatnonzero(np.append(True, symbols[1:] != symbols[:-1]))
        else:
            firsts = np.zeros(1, dtype=np.int64)
        own = symbols[firsts]
        sizes = np.diff(np.append(firsts, len(left)))
        rank = self.steps[: len(left)] - np.repeat(firsts, sizes)
        if down:
            array[at[symbols] - 1 - rank] = left
            at[own] -= sizes
        else:
            array[at[symbols] + rank] = left
            at[own] += sizes

    def induce(self, lms: np.ndarray) -> np.ndarray:
        """The order of all suffixes (of LMS substrings, if ``lms`` is only in order of symbols)."""
        array = np.zeros(len(self.text), dtype=np.int32)
        heads, tails = self.starts.copy(), self.ends.copy()
        bounds = np.searchsorted(self.text[lms], np.arange(len(self.ends) + 1))
        for c in self.present:
            at = self.starts[c]
            while at < heads[c]:
                end = heads[c]
                self._push(array, array[at:end].copy(), self.is_l, heads, False)
                at = end
            if bounds[c] < bounds[c + 1]:
                self._push(array, lms[bounds[c] : bounds[c + 1]], self.is_l, heads, False)
        for c in reversed(self.present):
            end = self.ends[c]
            while end > tails[c]:
                at = tails[c]
                self._push(array, array[at:end][::-1].copy(), self.is_s, tails, True)
                end = at
            if self.starts[c] < heads[c]:
                self._push(array, array[self.starts[c] : heads[c]][::-1].copy(), self.is_s, tails, True)
        array[0] = len(self.text) - 1
        return array


def _names(text: np.ndarray, ordered: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Names of the LMS substrings, from 0 on, along ``ordered``; equal substrings share one."""
    lengths = np.zeros(len(text), dtype=np.int32)
    lengths[lms] = np.append(np.diff(lms), 0) + 1
    one, two = ordered[:-1], ordered[1:]
    same = lengths[one] == lengths[two]
    left = np.flatnonzero(same)
    size, t = lengths[one], 0
    while len(left):
        left = left[t < size[left]]
        differs = text[one[left] + t] != text[two[left] + t]
        same[left[differs]] = False
        left, t = left[~differs], t + 1
    return np.append(0, np.cumsum(~same))


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions of all suffixes in order. ``text`` holds whole numbers; its last one is 0 and no other is."""
    n = len(text)
    if n <= SMALL:
        symbols = text.tolist()
        return np.array(sorted(range(n), key=lambda i: symbols[i:]), dtype=np.int32)
    text = text.astype(np.uint16) if text.max() < 1 << 16 else text
    is_s = _types(text)
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]).astype(np.int32) + 1
    buckets = _Buckets(text, is_s)
    rough = buckets.induce(lms[np.argsort(text[lms], kind="stable")])
    is_lms = np.zeros(n, dtype=bool)
    is_lms[lms] = True
    ordered = rough[is_lms[rough]]
    del rough
    names = _names(text, ordered, lms)
    count = int(names[-1]) + 1
    if count < len(lms):
        named = np.zeros(n, dtype=np.int64)
        named[ordered] = names
        ordered = lms[_sort_names(named[lms], count)]
    return buckets.induce(ordered)


def _sort_names(names: np.ndarray, count: int) -> np.ndarray:
    """Order of the suffixes of a string of names; the last name is 0 and no other is."""
    if len(names) <= LEAF:
        return _sort_ties(names)
    if count <= ONE_DIGIT:
        return suffix_array(names)
    base = isqrt(count) + 1
    digits = np.zeros(2 * len(names) + 1, dtype=np.int64)
    digits[0:-1:2] = names // base + 1
    digits[1:-1:2] = names % base + 1
    order = suffix_array(digits)
    whole = order[(order % 2 == 0) & (order < 2 * len(names))]
    return whole // 2


def _sort_ties(names: np.ndarray) -> np.ndarray:
    """The same for a short string: suffixes that tie are told apart by the ranks of those further and further on."""
    n = len(names)
    order = np.argsort(names, kind="stable")
    keys = names[order]
    reach = 1
    rank = np.empty(n, dtype=np.int64)  # where the group of equal keys starts
    firsts = np.append(True, keys[1:] != keys[:-1])
    rank[order] = np.maximum.accumulate(np.where(firsts, np.arange(n), 0))
    tied = ~(firsts & np.append(firsts[1:], True))
    places, order_left = np.flatnonzero(tied), order[tied]
    while len(places):
        beyond = np.where(order_left + reach < n, rank[np.minimum(order_left + reach, n - 1)] + 1, 0)
        keys = rank[order_left] * (n + 1) + beyond
        by = np.argsort(keys, kind="stable")
        order_left, keys = order_left[by], keys[by]
        order[places] = order_left
        firsts = np.append(True, keys[1:] != keys[:-1])
        rank[order_left] = np.maximum.accumulate(np.where(firsts, places, 0))
        tied = ~(firsts & np.append(firsts[1:], True))
        places, order_left = places[tied], order_left[tied]
        reach *= 2
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In text order: the suffix before each one in ``order`` (-1 for none), and the length of their common prefix.

    A prefix is compared only where it is irreducible; elsewhere it is one less than its left
    neighbour's. Comparisons stop at the end of the text.
    """
    n = len(text)
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    place = np.arange(n)
    prior = np.append(-1, before[:-1])
    reducible = (prior >= 0) & (before == prior + 1)
    reducible[1:] &= text[:-1] == text[np.maximum(before[1:] - 1, 0)]
    reducible[0] = False
    common = np.zeros(n, dtype=np.int64)
    left = np.flatnonzero(~reducible & (before >= 0))
    padded = np.append(text, [0] * 8).astype(np.uint16)
    words = np.lib.stride_tricks.sliding_window_view(padded.view(np.uint8), 16)[::2].view(np.uint64)  # 8 symbols each
    words = words.reshape(len(words), 2)
    while len(left):
        one, two = left + common[left], before[left] + common[left]
        inside = np.maximum(one, two) < n
        left, one, two = left[inside], one[inside], two[inside]
        same = (words[one] == words[two]).all(axis=1)
        rest = left[~same]
        tail = padded[one[~same, None] + np.arange(8)] != padded[two[~same, None] + np.arange(8)]
        common[rest] += tail.argmax(axis=1)
        left = left[same]
        common[left] += 8
    last = np.maximum.accumulate(np.where(reducible, 0, place))  # the irreducible position at or before each one
    return before, np.where(reducible, common[last] - (place - last), np.minimum(common, n - np.maximum(place, before)))
