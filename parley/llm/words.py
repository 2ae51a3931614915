"""Words of UTF-8 texts as arrays of 64-bit hashes, many texts at a time.

A word is a maximal run of bytes outside ``0x20`` and ``0x09-0x0D``; UTF-8 never uses those bytes inside a
longer code point, so words of bytes and of code points are the same. Every helper takes whole texts; memory is
bounded by ``SLICE_BYTES`` plus the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SLICE_BYTES = 1 << 20

ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def powers(base: int, n: int) -> np.ndarray:
    """``base ** i`` modulo 2**64 for ``i < n``."""
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out, dtype=np.uint64)


class Powers:
    """Powers of the hash base and of its inverse, grown when a longer text needs more."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, dtype=np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = powers(_BASE, n), powers(_INVERSE, n)
        return self.up[:n], self.down[:n]


_POWERS = Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def encoded(text: str | None, lower: bool = False) -> bytes:
    """UTF-8 of a text, null as empty; ``lower`` lowers A-Z only."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data.lower() if lower else data


def slices(texts: list[bytes], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes together, one text at least."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text) + 1
    if start < len(texts):
        yield start, len(texts)


def prefix_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix polynomial sums of bytes, and inverse powers: ``(sums[e] - sums[s]) * inverse[s]`` stands for bytes s to e."""
    up, down = _POWERS.to(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return sums, down


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number, first byte and end byte (in the texts joined by one newline) of each word, in order."""
    joined = b"\n".join(texts)
    data = np.frombuffer(joined, dtype=np.uint8)
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~_SPACE[data]
    edge = np.diff(inside)
    first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums, down = prefix_sums(data)
    words = mix((sums[end] - sums[first]) * down[first] ^ (end - first).astype(np.uint64) * ODD)
    starts = np.cumsum([0] + [len(t) + 1 for t in texts])[:-1]
    return words, np.searchsorted(starts, first, side="right") - 1, first, end


def ngrams(words: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``n`` words within one text, and the position of its first word."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    at = np.flatnonzero(text[:count] == text[n - 1 :])
    out = np.full(len(at), n, dtype=np.uint64)
    for k in range(n):
        out = mix(out * ODD + words[at + k])
    return out, at
