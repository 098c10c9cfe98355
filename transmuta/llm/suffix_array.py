"""Suffix arrays by induced sorting and permuted common prefixes, over numpy arrays of one shard.

Suffixes are classified as S (smaller than the next suffix) or L; the leftmost S suffixes of each S run (LMS) are sorted
by inducing, their substrings are named, and the string of names is sorted recursively while its alphabet is small
against its length (one bucket per name is visited), else by doubling ranks. From the sorted LMS suffixes the whole
array is induced in two linear scans. A scan visits buckets in order and, inside a bucket, handles all entries that are
known so far at once: their predecessors go to the next free places of their buckets in the order of the entries.
"""

from __future__ import annotations

import numpy as np



def _classify(t: np.ndarray) -> np.ndarray:
    """True where the suffix is S; the last symbol is the smallest and occurs once."""
    n = len(t)
    differs = np.flatnonzero(t[:-1] != t[1:])
    smaller = t[differs] < t[differs + 1]
    s = np.ones(n, bool)
    s[:n - 1] = smaller[np.searchsorted(differs, np.arange(n - 1))] if n > 1 else True
    return s


def _append(order_of: np.ndarray, chars: np.ndarray, heads: np.ndarray, sa: np.ndarray, step: int) -> None:
    """Put entries at the next free places of their buckets, in the given order."""
    if len(chars) == 1:
        c = chars[0]
        sa[heads[c]] = order_of[0]
        heads[c] += step
        return
    by = np.argsort(chars, kind="stable")
    c = chars[by]
    starts = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
    counts = np.diff(starts, append=len(c))
    within = np.arange(len(c)) - np.repeat(starts, counts)
    sa[heads[c] + step * within] = order_of[by]
    heads[c[starts]] += step * counts


def _induce(t: np.ndarray, s: np.ndarray, lms: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The suffix array, from LMS suffixes in order; first and last: bounds of each symbol's bucket."""
    n = len(t)
    sa = np.full(n, -1, np.int64)
    tails = last.copy()
    _append(lms[::-1], t[lms[::-1]], tails, sa, -1)  # from the end of the buckets
    lms_from = tails + 1
    heads = first.copy()
    for c in range(len(first)):
        if first[c] > last[c]:
            continue
        at = first[c]
        while at < heads[c]:
            stop = heads[c]
            at, entries = stop, sa[at:stop]
            _induced(t, s, entries, heads, sa, False, 1)
        _induced(t, s, sa[lms_from[c]:last[c] + 1], heads, sa, False, 1)
    ends = last.copy()
    l_until = heads
    for c in range(len(first) - 1, -1, -1):
        if first[c] > last[c]:
            continue
        at = last[c]
        while at > ends[c]:
            stop = ends[c]
            at, entries = stop, sa[stop + 1:at + 1][::-1]
            _induced(t, s, entries, ends, sa, True, -1)
        _induced(t, s, sa[first[c]:l_until[c]][::-1], ends, sa, True, -1)
    sa[0] = n - 1
    return sa


def _induced(t, s, entries, heads, sa, kind: bool, step: int) -> None:
    before = entries[entries > 0] - 1
    before = before[s[before] == kind]
    if len(before):
        _append(before, t[before], heads, sa, step)


def by_doubling(t: np.ndarray) -> np.ndarray:
    """The suffix array by doubling ranks."""
    n = len(t)
    rank = np.unique(t, return_inverse=True)[1].astype(np.int64)
    k = 1
    while True:
        later = np.zeros(n, np.int64)
        later[:n - k] = rank[k:] + 1
        key = rank * (n + 1) + later
        sa = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[sa] = np.concatenate(([0], np.cumsum(key[sa][1:] != key[sa][:-1])))
        rank = new
        if rank[sa[-1]] == n - 1:
            return sa
        k *= 2


def suffix_array(t: np.ndarray, symbols: int) -> np.ndarray:
    """Of a string whose last symbol is 0 and occurs only there; symbols: size of the alphabet."""
    n = len(t)
    if n < 3 or symbols > max(1024, n // 64):
        return by_doubling(t)
    counts = np.bincount(t, minlength=symbols)
    last = np.cumsum(counts) - 1
    first = last - counts + 1
    s = _classify(t)
    lms = np.flatnonzero(s[1:] & ~s[:-1]) + 1
    if len(lms) > 1:
        rough = _induce(t, s, lms, first, last)
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        ordered = rough[is_lms[rough]]
        length = np.empty(n, np.int64)
        length[lms] = np.diff(lms, append=n - 1) + 1
        length[n - 1] = 1
        same = np.concatenate(([False], _equal_runs(t, ordered[:-1], ordered[1:], length)))
        names = np.empty(n, np.int64)
        names[ordered] = np.cumsum(~same) - 1
        reduced = names[lms]
        distinct = int(names[ordered[-1]]) + 1
        if distinct == len(lms):
            lms = ordered
        else:
            lms = lms[suffix_array(reduced, distinct)]
    return _induce(t, s, lms, first, last)


def _equal_runs(t: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the substrings at a and b (of the lengths stated for their starts) are equal."""
    equal = length[a] == length[b]
    left = np.flatnonzero(equal)
    k = 0
    while len(left):
        left = left[length[a[left]] > k]
        wrong = t[a[left] + k] != t[b[left] + k]
        equal[left[wrong]] = False
        left = left[~wrong]
        k += 1
    return equal


def permuted_common_prefixes(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each position the length of the common prefix with the suffix before it in the array.

    Only irreducible values, where the symbols before the two suffixes differ, are compared; every other one is its left
    neighbour's less one.
    """
    n = len(t)
    before = np.empty(n, np.int64)
    before[sa[0]] = -1
    before[sa[1:]] = sa[:-1]
    position = np.arange(n)
    reducible = np.zeros(n, bool)
    reducible[1:] = (before[1:] > 0) & (t[:-1] == t[before[1:] - 1])
    compare = np.flatnonzero(~reducible & (before >= 0))
    value = np.zeros(n, np.int64)
    other = before[compare]
    k = 0
    while len(compare):
        inside = (compare + k < n) & (other + k < n)
        compare, other = compare[inside], other[inside]
        hit = t[compare + k] == t[other + k]
        compare, other = compare[hit], other[hit]
        value[compare] += 1
        k += 1
    anchor = np.maximum.accumulate(np.where(reducible, 0, position))
    return np.where(reducible, value[anchor] - (position - anchor), value)
