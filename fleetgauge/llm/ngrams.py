"""Vectorised character n-grams of whole texts, for use inside Arrow tasks."""

from __future__ import annotations

import numpy as np

ORDERS = (2, 3, 4)
#: Code points hashed at once; longer texts are hashed in overlapping slices.
SLICE = 1 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)


_LETTERS: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """For every code point whether it is a letter; built once a task."""
    if not _LETTERS:
        _LETTERS.append(np.array([chr(c).isalpha() for c in range(0x110000)], bool))
    return _LETTERS[0]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser; spreads the bits of packed n-grams."""
    x = x ^ (x >> np.uint64(31))
    x = x * MIX
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def normalised(text: str | None) -> np.ndarray:
    """Lower-case letters as code points; every run of other characters is one space, also at both ends."""
    if not text:
        return np.zeros(0, np.uint64)
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = letter_table()[points]
    points = np.where(letters, points, 32)
    points = np.r_[np.uint32(32), points, np.uint32(32)]
    blank = points == 32
    keep = ~(blank & np.r_[False, blank[:-1]])
    points = points[keep]
    return points.astype(np.uint64) if len(points) > 2 else np.zeros(0, np.uint64)


def grams(points: np.ndarray, orders: tuple[int, ...] = ORDERS):
    """Yields arrays of hashed n-grams; a space occurs only first or last in one."""
    for at in range(0, len(points), SLICE):
        part = points[at : at + SLICE + max(orders) - 1]
        blank = part == 32
        for n in orders:
            m = min(len(part) - n + 1, SLICE)
            if m <= 0:
                continue
            value = np.full(m, n, np.uint64)
            inner = np.zeros(m, bool)
            for k in range(n):
                value = value * np.uint64(0x100000001B3) + part[k : k + m]
                if 0 < k < n - 1:
                    inner |= blank[k : k + m]
            if n == 2:
                inner = blank[:m] & blank[1 : m + 1]
            yield mix(value[~inner])
