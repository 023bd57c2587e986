"""Byte-level terms of whole texts, for use inside Arrow tasks.

Every byte of a term of ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` is an ASCII letter or 0x80 and above,
and no other byte is, so the terms of UTF-8 text can be found on bytes, without decoding.
"""

from __future__ import annotations

import numpy as np
import xxhash

#: Bytes tokenized at once; a longer text makes up a chunk of its own.
CHUNK = 1 << 23

_IS_TERM = np.zeros(256, bool)
_IS_TERM[0x41:0x5B] = _IS_TERM[0x61:0x7B] = _IS_TERM[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def boundaries(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of each term in concatenated texts that end at ``ends``; no term spans two texts."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _IS_TERM[data]
    starts = np.flatnonzero(inside[1:] & ~inside[:-1])
    stops = np.flatnonzero(inside[:-1] & ~inside[1:])
    # A term that crosses the end of a text is cut there.
    cuts = ends[(ends > 0) & (ends < len(data))]
    cuts = np.unique(cuts[inside[cuts] & inside[cuts + 1]]) if len(cuts) else cuts
    if len(cuts):
        starts, stops = np.sort(np.r_[starts, cuts]), np.sort(np.r_[stops, cuts])
    return starts, stops, np.searchsorted(ends, starts, side="right")


def group_slices(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, group): the group of each slice and the first slice of each group; grouped slices have equal bytes.

    xxHash proposes the groups.  All bytes are then compared with those of the
    group's first slice; slices that only share the hash get groups of their own.
    """
    view, digest = memoryview(data), xxhash.xxh64_intdigest
    hashed = np.fromiter((digest(view[a:b]) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)), np.uint64, len(starts))
    _, first, group = np.unique(hashed, return_index=True, return_inverse=True)
    wrong = differing(data, starts, stops, first[group])
    if len(wrong):
        named: dict[bytes, int] = {data[starts[k] : stops[k]].tobytes(): g for g, k in enumerate(first)}
        first = list(first)
        for k in wrong:
            term = data[starts[k] : stops[k]].tobytes()
            if term not in named:
                named[term] = len(first)
                first.append(k)
            group[k] = named[term]
        first = np.array(first)
    return first, group


def differing(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The slices whose bytes aren't those of the slice that ``other`` names."""
    size = stops - starts
    same = size == size[other]
    at = np.flatnonzero(same)
    size = size[at]
    ends = np.cumsum(size)
    inner = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size)
    unequal = data[np.repeat(starts[at], size) + inner] != data[np.repeat(starts[other[at]], size) + inner]
    if unequal.any():
        same[at[np.unique(np.repeat(np.arange(len(at)), size)[unequal])]] = False
    return np.flatnonzero(~same)


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z lower-cased."""
    return _LOWER[data]
