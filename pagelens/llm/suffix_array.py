"""Suffix arrays by induced sorting, and permuted longest common prefixes, with whole-array steps.

Induced sorting: the order of the leftmost-smaller suffixes, found by recursion on the
string of their substrings' names, induces that of all others. Suffixes are placed by runs
of one symbol in whole-array steps; only suffixes that still tie take another step.
"""

from __future__ import annotations

import numpy as np


def _types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one. s ends with a unique smallest symbol."""
    n = len(s)
    smaller = np.zeros(n, dtype=bool)
    smaller[-1] = True
    differs = np.flatnonzero(s[:-1] != s[1:])
    # equal neighbours take the type of the next place where the symbols differ
    at = differs[np.searchsorted(differs, np.arange(n - 1))]
    smaller[:-1] = s[at] < s[at + 1]
    return smaller


def _ordered(items: np.ndarray, key: np.ndarray, follow: np.ndarray, stop: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Items in the order of the keys met on the way item, follow[item], follow[follow[item]], ...

    Only tied items take another step, so the steps add up to the common parts of the ways.
    A tie that reaches a place in stop stays. Returns the order and for each place in it
    whether it begins a new group of equals.
    """
    order = items[np.argsort(key[items], kind="stable")]
    at, k = order.copy(), key[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = k[1:] != k[:-1]
    group = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    tied = np.flatnonzero(~new | ~np.append(new[1:], True))
    while len(tied):
        at[tied] = follow[at[tied]]
        g, k = group[tied], key[at[tied]]
        by = np.lexsort((k, g))
        order[tied], at[tied], k = order[tied[by]], at[tied[by]], k[by]
        fresh = np.ones(len(tied), dtype=bool)
        fresh[1:] = (g[1:] != g[:-1]) | (k[1:] != k[:-1])
        new[tied] |= fresh
        first = np.flatnonzero(fresh)
        size = np.diff(np.append(first, len(tied)))
        group[tied] = np.repeat(tied[first], size)
        more = np.repeat(size > 1, size)
        if stop is not None:
            more &= ~stop[at[tied]]
        tied = tied[more]
    return order, new


def _induced(s: np.ndarray, small: np.ndarray, marked: np.ndarray) -> np.ndarray:
    """All suffixes in the order that the order of the leftmost-smaller ones, marked, induces; for any alphabet.

    A larger suffix is a run of one symbol and the suffix behind it, down to a marked one;
    of two runs the longer is the larger. From the larger suffixes' order the smaller
    suffixes follow likewise, and there the longer run is the smaller. Within a symbol
    the larger suffixes stand before the smaller ones.
    """
    n = len(s)
    ends = np.append(np.flatnonzero(s[1:] != s[:-1]) + 1, n)
    after = np.minimum(np.repeat(ends, np.diff(np.append(0, ends))), n - 1)  # the place behind a suffix's first run
    run = after - np.arange(n)
    head = s.astype(np.int64) << 33
    key = head + run
    key[small] += 1 << 32
    key[marked] = head[marked] + (1 << 32) + np.arange(len(marked))
    larger, _ = _ordered(np.flatnonzero(~small), key, after)
    key = head + (1 << 32) + ((1 << 31) - run)
    key[larger] = head[larger] + np.arange(len(larger))
    smaller, _ = _ordered(np.flatnonzero(small), key, after)
    out = np.concatenate([larger, smaller])
    return out[np.argsort(s[out], kind="stable")]


def _sorted_suffixes(s: np.ndarray) -> np.ndarray:
    """Order of all suffixes of s, which ends with a unique smallest symbol."""
    n = len(s)
    if n == 1:
        return np.zeros(1, dtype=np.int64)
    small = _types(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    is_lms = np.zeros(n, dtype=bool)
    is_lms[lms] = True
    # substrings from one leftmost-smaller place to the next, equal ones under one name
    order, new = _ordered(lms, 2 * s.astype(np.int64) + small, np.minimum(np.arange(n) + 1, n - 1), is_lms)
    if not new.all():
        name = np.empty(n, dtype=np.int64)
        name[order] = np.cumsum(new)
        order = lms[_sorted_suffixes(name[lms])]
    return _induced(s, small, order)


def suffix_array(symbols: np.ndarray, sigma: int) -> np.ndarray:
    """Order of the suffixes of symbols (values 1 to sigma-1), without the empty one.

    Suffixes are classified as smaller or larger than their successor; the substrings
    between leftmost-smaller places are sorted and named; where names repeat, the string of
    names is sorted in the same way, by recursion; its order induces that of all suffixes.
    """
    return _sorted_suffixes(np.append(symbols, 0).astype(np.int64))[1:]


def repeated_starts(symbols: np.ndarray, sigma: int, length: int, separator: int) -> np.ndarray:
    """Places where a string of the given length without the separator starts that also starts elsewhere.

    Uses permuted common prefixes: phi(i) is the suffix before i in order; where the symbols
    before i and phi(i) agree, the common prefix is one shorter than that of i - 1, so only
    the other places are compared symbol by symbol.
    """
    n = len(symbols)
    found = np.zeros(n, dtype=bool)
    if n < length:
        return found
    order = suffix_array(symbols, sigma)
    phi = np.full(n, -1, dtype=np.int64)
    phi[order[1:]] = order[:-1]
    signed = symbols.astype(np.int64)  # as a byte, -1 would be 255, the separator of the shards
    before = np.where(phi > 0, signed[np.maximum(phi, 1) - 1], -1)
    own = np.concatenate([[-2], signed[:-1]])
    fresh = (before != own) | (phi < 0)
    fresh[1:] |= phi[:-1] < 0
    places = np.flatnonzero(fresh & (phi >= 0))
    common = np.zeros(n, dtype=np.int64)
    # eight symbols at a time, then one at a time
    wide = np.zeros(n + 16, dtype=np.uint8)
    wide[:n] = symbols
    words = np.lib.stride_tricks.sliding_window_view(wide, 8)[: n + 8]
    eight = np.zeros(n + 8, dtype=np.uint64)
    for j in range(8):
        eight |= words[:, j].astype(np.uint64) << np.uint64(8 * j)
    live, at = places, 0
    ended = []
    while len(live):
        inside = np.maximum(live, phi[live]) + at + 8 <= n
        equal = inside.copy()
        equal[inside] = eight[live[inside] + at] == eight[phi[live[inside]] + at]
        ended.append((live[~equal], at))
        live, at = live[equal], at + 8
    for some, at in ended:
        depth = np.full(len(some), at)
        on = np.arange(len(some))
        for _ in range(8):
            inside = np.maximum(some[on], phi[some[on]]) + depth[on] < n
            on = on[inside]
            on = on[symbols[some[on] + depth[on]] == symbols[phi[some[on]] + depth[on]]]
            depth[on] += 1
        common[some] = depth
    # places in between: one less than the place before
    last = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    common = np.where(phi >= 0, common[last] - (np.arange(n) - last), 0)
    ends = np.flatnonzero(symbols == separator)
    end = np.append(ends, n)[np.searchsorted(ends, np.arange(n))]
    hit = np.flatnonzero((common >= length) & (end - np.arange(n) >= length))
    found[hit] = True
    found[phi[hit]] = True
    return found
