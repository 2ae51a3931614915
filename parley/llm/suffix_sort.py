"""Suffix sorting by hashed prefixes.

Two suffixes are compared by the length of their common extension, found by binary search on prefix polynomial hashes
in a logarithmic number of steps, and by the byte after it. A mergesort on these comparisons sorts the suffixes of many
groups at once: in every pass each suffix finds its place in the neighbouring run of its group by binary search. What
hashes call equal is compared byte by byte afterwards, and sorted again by bytes if a collision shows.
"""

from __future__ import annotations

import numpy as np

from parley.llm import words as W


class Bytes:
    """Bytes with their prefix hashes; a suffix is named by its first byte and compared up to a limit of at least 8."""

    def __init__(self, data: np.ndarray) -> None:
        self.data = data
        self.sums, self.down = W.prefix_sums(data)

    def hashes(self, start: np.ndarray, length: int | np.ndarray) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.down[start]

    def common(self, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
        """Length of the common extension of suffixes, up to ``limit``."""
        known = np.zeros(len(a), dtype=np.int64)
        step = 1 << (limit.bit_length() - 1)
        while step:
            longer = np.minimum(known + step, limit)
            equal = self.hashes(a + known, longer - known) == self.hashes(b + known, longer - known)
            known = np.where(equal, longer, known)
            step >>= 1
        return known

    def compare(self, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
        """Negative, zero or positive as suffix a is before, equal to or after b."""
        out = np.zeros(len(a), dtype=np.int64)
        other = np.flatnonzero(self.hashes(a, limit) != self.hashes(b, limit))
        a, b = a[other], b[other]
        at = self.common(a, b, limit - 1)
        out[other] = self.data[a + at].astype(np.int64) - self.data[b + at]
        return out

    def first_words(self, start: np.ndarray) -> np.ndarray:
        """The first 8 bytes of suffixes as numbers in their order."""
        out = np.zeros(len(start), dtype=np.uint64)
        for k in range(8):
            out = out << np.uint64(8) | self.data[start + k]
        return out

    def equal(self, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
        """Byte by byte."""
        same = np.ones(len(a), dtype=bool)
        for k in range(limit):
            same &= self.data[a + k] == self.data[b + k]
        return same


def sorted_suffixes(text: Bytes, starts: np.ndarray, group: np.ndarray, limit: int) -> np.ndarray:
    """Order of the suffixes within each group; ``group`` is sorted. Suffixes are dealt by their first 8 bytes, and merged within those."""
    n = len(starts)
    order = np.arange(n)
    if not n:
        return order
    words = text.first_words(starts)
    order = np.lexsort((words, group))
    new = np.ones(n, dtype=bool)
    new[1:] = (group[order[1:]] != group[order[:-1]]) | (words[order[1:]] != words[order[:-1]])
    first = np.flatnonzero(new)
    ends = np.append(first[1:], n)
    number = np.cumsum(new) - 1
    largest = int((ends - first).max())
    width = 1
    while width < largest:
        at = np.flatnonzero((ends - first)[number] > width)  # places in groups that this pass can change
        begin, end = first[number[at]], ends[number[at]]
        local = at - begin
        run = local // width
        left = run % 2 == 0
        low = np.minimum(begin + np.where(left, run + 1, run - 1) * width, end)
        high = np.minimum(low + width, end)
        other = low.copy()
        open_ = np.flatnonzero(low < high)
        while len(open_):
            middle = (low[open_] + high[open_]) >> 1
            sign = text.compare(starts[order[at[open_]]], starts[order[middle]], limit)
            before = (sign > 0) | ((sign == 0) & ~left[open_])
            low[open_] = np.where(before, middle + 1, low[open_])
            high[open_] = np.where(before, high[open_], middle)
            open_ = open_[low[open_] < high[open_]]
        place = begin + run // 2 * 2 * width + local % width + low - other
        moved = order.copy()
        moved[place] = order[at]
        order = moved
        width *= 2
    return order


def repeated(text: Bytes, starts: np.ndarray, group: np.ndarray, limit: int) -> np.ndarray:
    """Which suffixes can equal another one of their group up to ``limit``: those whose hash isn't alone."""
    key = W.mix(text.hashes(starts, limit) ^ W.mix(group.astype(np.uint64)))
    order = np.argsort(key)
    ordered = key[order]
    same = ordered[1:] == ordered[:-1]
    out = np.zeros(len(starts), dtype=bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def equal_runs(text: Bytes, starts: np.ndarray, group: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes, and in that order where a new string of ``limit`` bytes (or a new group) begins."""
    order = sorted_suffixes(text, starts, group, limit)
    new = np.ones(len(order), dtype=bool)
    if len(order) > 1:
        a, b = starts[order[:-1]], starts[order[1:]]
        same = (group[1:] == group[:-1]) & (text.hashes(a, limit) == text.hashes(b, limit))
        if not text.equal(a[same], b[same], limit).all():  # a collision of hashes: sort by bytes
            rows = text.data[starts[:, None] + np.arange(limit)]
            order = np.lexsort((*rows.T[::-1], group))
            same = (group[1:] == group[:-1]) & (rows[order[1:]] == rows[order[:-1]]).all(axis=1)
        new[1:] = ~same
    return order, new
