"""Polynomial names of substrings, vectorised over a buffer of symbols.

name(p, k) = sum of x[p+i] * B^i for i < k, modulo 2^64, then mixed; B is odd and so has an inverse.
Prefix sums give the name of any window in O(1). Two bases give 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_powers: dict[tuple[int, int], np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64; kept between batches, grown by doubling."""
    have = _powers.get((base, 0))
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        step = np.full(size, base, dtype=np.uint64)
        step[0] = 1
        have = _powers[(base, 0)] = np.cumprod(step, dtype=np.uint64)
    return have[:n]


class Names:
    """Names of the windows of ``x`` (uint64 symbols) under one base."""

    def __init__(self, x: np.ndarray, base: int):
        n = len(x)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(x * powers(base, n), out=self.sums[1:])
        self.inverse = powers(pow(base, -1, 1 << 64), n + 1)

    def windows(self, k: int) -> np.ndarray:
        """Of all windows of k symbols."""
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * self.inverse[:n])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])


def byte_symbols(seed: int) -> np.ndarray:
    """A 64-bit symbol for each byte value."""
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(2 * seed + 1) + np.uint64(0x2545F4914F6CDD1D))


BYTES = byte_symbols(7)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def words(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes other than 20 and 09 to 0D."""
    edge = np.diff(np.concatenate(([False], ~_SPACE[buffer], [False])).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def words_in_parts(buffer: np.ndarray, part: int = 1 << 22) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and symbols of the words; a long buffer goes in parts that end at white space."""
    found, lo = [], 0
    while lo < len(buffer):
        hi = min(len(buffer), lo + part)
        while hi < len(buffer) and not _SPACE[buffer[hi]]:
            hi += 1
        start, end = words(buffer[lo:hi])
        found.append((start + lo, end + lo, word_symbols(buffer[lo:hi], start, end)))
        lo = hi
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def word_symbols(buffer: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit symbol for each word."""
    return Names(BYTES[buffer], BASES[0]).spans(start, end) + (end - start).astype(np.uint64)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[p:p+w]) for each p, by block-wise prefix and suffix minima."""
    n = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(x)] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def majority(hashes: Iterable[np.ndarray]) -> int:
    """A bit is 1 if it is set in over half the hashes."""
    count, n = np.zeros(64, np.int64), 0
    for part in hashes:
        count += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(part)
    return int.from_bytes(np.packbits(2 * count > n).tobytes(), "big")
