"""Suffix arrays over a shard of short byte strings, in numpy, for use inside tasks."""

from __future__ import annotations

import numpy as np

#: Bytes in one number of base 257, in which 0 is a string's end.
PACKED = 7


class Shard:
    """Strings laid end to end, each ended by a symbol of its own that is below every byte."""

    def __init__(self, strings: list[bytes]):
        self.size = np.array([len(s) for s in strings], np.int64)
        self.end = np.cumsum(self.size)
        self.begin = self.end - self.size
        self.bytes = np.frombuffer(b"".join(strings), np.uint8)
        self.string = np.repeat(np.arange(len(strings)), self.size)
        padded = np.concatenate([self.bytes, np.zeros(8, np.uint8)]).astype(np.uint64)
        self.eight = sum(padded[k : k + len(self.bytes)] << np.uint64(56 - 8 * k) for k in range(8)) if len(self.bytes) else np.zeros(0, np.uint64)
        self.order, self.place = self._sorted()

    def _sorted(self) -> tuple[np.ndarray, np.ndarray]:
        """Larsson and Sadakane's refinement: suffixes in groups by their first h symbols; groups of several are sorted by
        the group of the suffix h further on, and h doubles; suffixes that stand alone are left where they are."""
        n = len(self.bytes)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        left = self.end[self.string] - np.arange(n)
        padded, first = np.concatenate([self.bytes, np.zeros(PACKED, np.uint8)]).astype(np.int64) + 1, np.zeros(n, np.int64)
        for k in range(PACKED):
            first = first * 257 + np.where(k < left, padded[k : k + n], 0)
        order = np.argsort(first, kind="stable")
        group = np.empty(n, np.int64)  # of each suffix: the last place of its group
        last = np.concatenate([first[order][1:] != first[order][:-1], [True]])
        ends = np.flatnonzero(last)
        group[order] = ends[np.searchsorted(ends, np.arange(n))]
        alone = np.concatenate([[True], last[:-1]]) & last
        open_ = np.flatnonzero(~alone)
        h = PACKED
        strings = len(self.size)
        while len(open_):
            suffix = order[open_]
            own = group[suffix]
            beyond = np.where(left[suffix] > h, group[np.minimum(suffix + h, n - 1)] + strings, self.string[suffix])
            key = own * (n + strings + 1) + beyond
            by = np.argsort(key, kind="stable")
            suffix, key = suffix[by], key[by]
            order[open_] = suffix
            last = np.concatenate([key[1:] != key[:-1], [True]])
            ends = np.flatnonzero(last)
            group[suffix] = open_[ends[np.searchsorted(ends, np.arange(len(open_)))]]
            alone = np.concatenate([[True], last[:-1]]) & last
            open_ = open_[~alone]
            h *= 2
        return order, group

    def common_with_previous(self, starts: np.ndarray, counts: np.ndarray, most: int) -> list[np.ndarray]:
        """Kasai's common prefixes, up to ``most``, of suffixes with the one before them in order.

        For each string the suffixes at its first ``counts`` places: a suffix shares at least one byte less than the one
        before it in the text, so the count goes on from there.  All strings step together.  Returns one array a step,
        for the strings of ``starts`` that have that many.
        """
        shared, out = np.zeros(len(starts), np.int64), []
        for step in range(int(counts.max()) if len(counts) else 0):
            on = np.flatnonzero(counts > step)
            i = starts[on] + step
            at = self.place[i]
            j = np.where(at > 0, self.order[np.maximum(at - 1, 0)], 0)
            h = np.maximum(shared[on] - 1, 0)
            limit = np.where(at > 0, np.minimum(most, np.minimum(self.end[self.string[i]] - i, self.end[self.string[j]] - j)), 0)
            h = np.minimum(h, limit)
            go = np.flatnonzero(h + 8 <= limit)
            while len(go):
                go = go[self.eight[i[go] + h[go]] == self.eight[j[go] + h[go]]]
                h[go] += 8
                go = go[h[go] + 8 <= limit[go]]
            go = np.flatnonzero(h < limit)
            while len(go):
                go = go[self.bytes[i[go] + h[go]] == self.bytes[j[go] + h[go]]]
                h[go] += 1
                go = go[h[go] < limit[go]]
            shared[on] = h
            out.append(h)
        return out

    def windows(self, starts: np.ndarray, size: int) -> np.ndarray:
        """The windows of ``size`` bytes as rows of big-endian numbers; the last number ends with the window."""
        steps = np.append(np.arange(0, size - 7, 8), size - 8)
        return self.eight[starts[:, None] + steps]


def compared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """-1, 0 or 1 for each pair of rows, by the first number that differs."""
    differ = a != b
    first = differ.argmax(axis=1)
    row = np.arange(len(a))
    return np.where(differ.any(axis=1), np.where(a[row, first] < b[row, first], -1, 1), 0)


def find_sorted(queries: np.ndarray, known: np.ndarray) -> np.ndarray:
    """For each row of ``queries`` the first row of sorted ``known`` that isn't below it, by binary search."""
    low, high = np.zeros(len(queries), np.int64), np.full(len(queries), len(known), np.int64)
    while (low < high).any():
        on = np.flatnonzero(low < high)
        middle = (low[on] + high[on]) // 2
        below = compared(known[middle], queries[on]) < 0
        low[on] = np.where(below, middle + 1, low[on])
        high[on] = np.where(below, high[on], middle)
    return low
