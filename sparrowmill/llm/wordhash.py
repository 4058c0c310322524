"""Words, lines and windows of a batch of texts as numpy arrays of 64-bit hashes.

A word is a run of bytes other than ASCII white space. All texts of a batch lie
in one byte array; prefix sums of byte * P**i give every word's polynomial hash
without a step of Python for a word. Hashes are mixed, so sums and windows of
them are as good as random numbers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n + 1:
        size = 1 << n.bit_length()
        for k, base in enumerate((_P, _P_INVERSE)):
            full = np.full(size, base, np.uint64)
            full[0] = 1
            _powers[k] = np.cumprod(full)
    return _powers[0], _powers[1]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each span data[start:end], the same for equal bytes wherever they are."""
    up, down = _power(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _P)


@dataclass
class Words:
    """first[k]:first[k + 1] are the words of text k; starts and ends are places in data."""

    data: np.ndarray
    text_start: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def room(self, width: int) -> np.ndarray:
        """Which words begin a window of width words of their own text."""
        last = np.repeat(self.first[1:], np.diff(self.first))
        return np.arange(len(self.hashes)) + width <= last


def words_of(texts: list[bytes], table: np.ndarray | None = None) -> Words:
    """table: a byte map applied first, such as LOWER."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    if table is not None:
        data = table[data]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    text_start = np.concatenate([[0], np.cumsum(sizes)])
    solid = np.zeros(len(data) + 1, np.int8)
    solid[1:] = ~_SPACE[data]
    turn = np.diff(solid)
    starts, ends = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    return Words(data, text_start, starts, ends, span_hashes(data, starts, ends), np.searchsorted(starts, text_start))


def windows(hashes: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """A hash of each width consecutive hashes; the last width - 1 have none (zero)."""
    n = len(hashes)
    out = np.zeros(n, np.uint64)
    if n < width:
        return out
    total = np.full(n - width + 1, salt, np.uint64)
    for k in range(width):
        total = total * _P + hashes[k : n - width + 1 + k]
    out[: n - width + 1] = mix(total)
    return out
