"""Suffix arrays by induced sorting, of bytes swept bucket by bucket in vectors, and permuted common prefixes."""

from __future__ import annotations

import numpy as np

from textloom.llm.base import same_bytes


def _classify(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; t ends with a unique least symbol. Symbols of a run share the class that the run's end has."""
    end = np.flatnonzero(np.r_[t[1:] != t[:-1], True])  # last place of each run
    small = np.r_[t[end[:-1]] < t[end[1:]], True]
    return np.repeat(small, np.diff(np.r_[-1, end]))


class _Buckets:
    def __init__(self, t: np.ndarray) -> None:
        self.t = t
        self.small = _classify(t)
        self.lms = np.flatnonzero(self.small[1:] & ~self.small[:-1]) + 1
        size = np.bincount(t, minlength=256)
        self.end = np.cumsum(size)
        self.begin = self.end - size
        self.used = np.flatnonzero(size)

    def _deal(self, sa: np.ndarray, at: np.ndarray, items: np.ndarray, up: bool) -> None:
        """Append items, in order, to the buckets of their symbols: upwards from their begins or downwards from their ends."""
        c = self.t[items]
        order = np.argsort(c, kind="stable")
        c = c[order]
        n = np.bincount(c, minlength=256)
        rank = np.arange(len(c)) - (np.cumsum(n) - n)[c]
        if up:
            sa[at[c] + rank] = items[order]
            at += n
        else:
            sa[at[c] - 1 - rank] = items[order]
            at -= n

    def induce(self, sorted_lms: np.ndarray) -> np.ndarray:
        """All suffixes in the order that the given order of leftmost-smaller suffixes induces."""
        t, small = self.t, self.small
        sa = np.full(len(t), -1, np.int64)
        tails = np.split(sorted_lms, np.searchsorted(t[sorted_lms], np.arange(1, 256)))
        at = self.begin.copy()
        for c in self.used.tolist():  # larger ones, left to right
            done = self.begin[c]
            while done < at[c]:
                now = sa[done : at[c]]
                done = int(at[c])
                before = now[now > 0] - 1
                before = before[~small[before]]
                if len(before):
                    self._deal(sa, at, before, True)
            if len(tails[c]):
                before = tails[c][tails[c] > 0] - 1
                if len(before):
                    self._deal(sa, at, before, True)
        larger = at.copy()
        at = self.end.copy()
        last = len(t) - 1
        for c in self.used[::-1].tolist():  # smaller ones, right to left
            if c == t[last]:
                sa[self.end[c] - 1] = last  # the end symbol stands alone in its bucket
                at[c] = self.end[c] - 1
            done = self.end[c]
            while done > at[c]:
                now = sa[at[c] : done][::-1]
                done = int(at[c])
                before = now[now > 0] - 1
                before = before[small[before]]
                if len(before):
                    self._deal(sa, at, before, False)
            now = sa[self.begin[c] : larger[c]][::-1]
            before = now[now > 0] - 1
            before = before[small[before]]
            if len(before):
                self._deal(sa, at, before, False)
        return sa


def _names(t: np.ndarray, lms: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Names of the leftmost-smaller substrings in text order; by has their places in sorted order. Equal names are equal symbols."""
    place = np.empty(len(t), np.int64)
    place[lms] = np.arange(len(lms))
    size = (np.minimum(np.r_[lms[1:], len(t) - 1] + 1, len(t)) - lms)[place[by]]
    new = size[1:] != size[:-1]
    new[~new] = ~same_bytes(t, by[1:][~new], t, by[:-1][~new], size[1:][~new])
    names = np.empty(len(lms), np.int64)
    names[place[by]] = np.cumsum(np.r_[0, new])
    return names


def _order(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of names: at once if all differ, else by the same steps on the string of names."""
    if names.max(initial=0) + 1 == len(names):
        order = np.empty(len(names), np.int64)
        order[names] = np.arange(len(names))
        return order
    return _integers(names)


def _integers(t: np.ndarray) -> np.ndarray:
    """Suffix array of a string of integers from 0 whose last is 0 and occurs once. Its buckets are small, so they are swept symbol by symbol."""
    small = _classify(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    size = np.bincount(t)
    ends = np.cumsum(size)
    begins, ends, s, is_small = (ends - size).tolist(), ends.tolist(), t.tolist(), small.tolist()

    def induce(tails_of: np.ndarray) -> list[int]:
        sa = [-1] * len(s)
        at = ends.copy()
        for i in reversed(tails_of.tolist()):
            at[s[i]] -= 1
            sa[at[s[i]]] = i
        at = begins.copy()
        for i in sa:  # larger ones, left to right, as the list fills up
            if i > 0 and not is_small[i - 1]:
                c = s[i - 1]
                sa[at[c]] = i - 1
                at[c] += 1
        at = ends.copy()
        for i in reversed(sa):  # smaller ones, right to left
            if i > 0 and is_small[i - 1]:
                c = s[i - 1]
                at[c] -= 1
                sa[at[c]] = i - 1
        return sa

    if len(t) == 1:
        return np.zeros(1, np.int64)
    sa = np.array(induce(lms), np.int64)
    is_lms = np.zeros(len(t), bool)
    is_lms[lms] = True
    names = _names(t, lms, sa[is_lms[sa]])
    return np.array(induce(lms[_order(names)]), np.int64)


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffix array of uint8 symbols whose last is 0 and occurs once: classify, induce from unsorted leftmost-smaller suffixes, which sorts their substrings, name these, sort the string of names in the same way, induce again."""
    b = _Buckets(t)
    lms = b.lms
    if not len(lms):
        return b.induce(np.zeros(0, np.int64))
    sa = b.induce(lms[np.argsort(t[lms], kind="stable")])
    is_lms = np.zeros(len(t), bool)
    is_lms[lms] = True
    return b.induce(lms[_order(_names(t, lms, sa[is_lms[sa]]))])


def permuted_prefixes(t: np.ndarray, sa: np.ndarray, stop: int) -> np.ndarray:
    """For each place in text order, the symbols up to the next one of at most `stop` that its suffix shares with the one before it in the array.

    Where the neighbours in the array of two places in a row are in a row too and both agree on the first symbol, the second place shares one symbol less than the first; only the others are compared, all at once, eight symbols a step.
    """
    n = len(t)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    ends = np.flatnonzero(t <= stop)
    left = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)
    follows = np.zeros(n, bool)
    follows[1:] = (phi[1:] == phi[:-1] + 1) & (phi[:-1] >= 0) & (left[:-1] > 0) & (t[:-1] == t[np.maximum(phi[:-1], 0)])
    i = np.flatnonzero(~follows & (phi >= 0) & (left > 0))
    padded = np.concatenate([t, np.zeros(8, np.uint8)])
    eight = np.ndarray((n + 1,), "<u8", padded, strides=(1,))
    same = np.zeros(n, np.int64)
    j, k = i, np.zeros(len(i), np.int64)
    while len(j):
        x = eight[np.minimum(j + k, n)] ^ eight[np.minimum(phi[j] + k, n)]
        low = x & (~x + np.uint64(1))  # the lowest bit that differs
        step = np.where(x == 0, 8, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64) >> 3)
        k = k + step
        done = (x != 0) | (k >= left[j])
        same[j[done]] = np.minimum(k[done], left[j[done]])
        j, k = j[~done], k[~done]
    lead = np.maximum.accumulate(np.where(follows, 0, np.arange(n)))
    return np.maximum(same[lead] - (np.arange(n) - lead), 0)
