"""Per-batch fingerprint arithmetic used inside the SimHash tasks.

``fingerprint`` takes one whole text as UTF-8 bytes.  Words are maximal runs of
bytes outside space and 0x09-0x0D, A-Z folded to lower case; shingles are
``width`` consecutive words joined by one space, repeats included.
"""

from __future__ import annotations

import numpy as np
import xxhash

#: Shingles whose bits are unpacked at once; bounds memory for very long texts.
CHUNK = 1 << 15


def fingerprint(text: bytes | None, width: int = 4, seed: int = 42) -> int:
    """Unsigned 64-bit fingerprint; zero for a text without words."""
    words = (text or b"").lower().split()
    n = len(words)
    if n == 0:
        return 0
    joined = b" ".join(words)
    hash64 = xxhash.xxh64_intdigest
    if n <= width:
        return hash64(joined, seed)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    spans = zip(starts[: n - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    total = n - width + 1
    hashes = np.fromiter((hash64(joined[a:b], seed) for a, b in spans), np.uint64, total)
    ones = np.zeros(64, np.int64)
    for at in range(0, total, CHUNK):
        part = hashes[at : at + CHUNK].view(np.uint8)
        ones += np.unpackbits(part, bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    bits = np.packbits((2 * ones > total).astype(np.uint8), bitorder="little")
    return int(bits.view(np.uint64)[0])
