"""Compact tries of sorted words, and all words within one edit of given ones.

A trie has nodes only where words part or end; what follows below the last
branch is the tail of a leaf.  Words are bytes, one per code point.  Children
are found by binary search over one sorted array of (parent, label) keys.

The distance-one Levenshtein automaton of a word has the states (position,
edits spent).  States without an edit form one path down the trie; at every
node of it each edit opens branches, and these are followed down to their
leaves before the path goes on.  All words of a block move in step.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

#: Cells of the character matrix of one block of words.
CELLS = 1 << 20


class Trie(NamedTuple):
    """``keys[k]`` is the edge to node k + 1, whose children begin at ``first``; ``at[node]`` is the word that ends there or -1."""

    keys: np.ndarray
    first: np.ndarray
    at: np.ndarray
    tail: np.ndarray
    tail_at: np.ndarray

    @classmethod
    def build(cls, words: list[bytes]) -> Trie:
        """Over sorted distinct words."""
        keys, at, tails, first = [], [], [], []
        queue = [(0, len(words), 0)]
        for lo, hi, depth in queue:  # grows while it is read: breadth first, so keys come out sorted
            node = len(at)
            first.append(len(queue))
            if hi - lo == 1:
                at.append(lo)
                tails.append(words[lo][depth:])
                continue
            tails.append(b"")
            ends = hi > lo and len(words[lo]) == depth
            at.append(lo if ends else -1)
            lo += ends
            while lo < hi:
                label = words[lo][depth]
                until = _last_with(words, lo, hi, depth, label)
                keys.append((node << 8) | label)
                queue.append((lo, until, depth + 1))
                lo = until
        return cls(
            np.array(keys, np.int64),
            np.array([*first, len(queue)], np.int32),
            np.array(at, np.int32),
            np.frombuffer(b"".join(tails), np.uint8),
            np.cumsum([0, *map(len, tails)]).astype(np.int32),
        )

    def child(self, node: np.ndarray, label: np.ndarray) -> np.ndarray:
        """The child of each node by a label, or -1."""
        if not len(self.keys):
            return np.full(len(node), -1)
        key = (node << 8) | label
        k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[k] == key, k + 1, -1)


def _last_with(words: list[bytes], lo: int, hi: int, depth: int, label: int) -> int:
    """End of the run of words, from ``lo`` on, with a label at a depth."""
    step = 1
    while lo + step < hi and words[lo + step][depth] == label:
        step *= 2
    a, b = lo + step // 2, min(lo + step, hi)
    while b - a > 1:
        mid = (a + b) // 2
        a, b = (mid, b) if words[mid][depth] == label else (a, mid)
    return b


def blocks_of(words: list[bytes]):
    """Yields (positions, character matrix padded with 0, lengths), words of like length together."""
    size = np.array([len(w) for w in words], np.int64)
    order = np.argsort(size, kind="stable")
    lo = 0
    while lo < len(order):
        width = max(8, int(size[order[lo]]) * 3 // 2)
        hi = min(int(np.searchsorted(size[order], width, side="right")), lo + max(1, CELLS // width))
        part = order[lo:hi]
        width = int(size[part].max())
        chars = np.frombuffer(b"".join(words[k].ljust(width + 1, b"\0") for k in part), np.uint8).reshape(len(part), width + 1)
        yield part, chars.astype(np.int64), size[part]
        lo = hi


def near(trie: Trie, chars: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, word of the trie) of all pairs that differ by exactly one edit, each once."""
    rows, words = [], []

    def accept(row: np.ndarray, word: np.ndarray) -> None:
        rows.append(row)
        words.append(word)

    def follow(row: np.ndarray, pos: np.ndarray, node: np.ndarray) -> None:
        """From states whose edit is spent: what remains must match exactly."""
        while len(row):
            leaf = trie.first[node] == trie.first[node + 1]
            if leaf.any():
                r, p, v = row[leaf], pos[leaf], node[leaf]
                start, left = trie.tail_at[v], trie.tail_at[v + 1] - trie.tail_at[v]
                same = left == size[r] - p
                r, p, v, start, left = r[same], p[same], v[same], start[same], left[same]
                k = 0
                while len(r):
                    done = left <= k
                    if done.any():
                        accept(r[done], trie.at[v[done]])
                    go = ~done
                    go[go] = trie.tail[start[go] + k] == chars[r[go], p[go] + k]
                    r, p, v, start, left = r[go], p[go], v[go], start[go], left[go]
                    k += 1
                row, pos, node = row[~leaf], pos[~leaf], node[~leaf]
            over = pos == size[row]
            if over.any():
                ends = over & (trie.at[node] >= 0)
                accept(row[ends], trie.at[node[ends]])
                row, pos, node = row[~over], pos[~over], node[~over]
            node = trie.child(node, chars[row, pos])
            there = node >= 0
            row, pos, node = row[there], pos[there] + 1, node[there]

    row = np.arange(len(size))
    node = np.zeros(len(size), np.int64)
    i = 0
    while len(row):
        leaf = trie.first[node] == trie.first[node + 1]
        for r, v in zip(row[leaf].tolist(), node[leaf].tolist(), strict=True):
            # The path enters a tail: its one word is compared with what remains.
            rest, tail = chars[r, i : size[r]], trie.tail[trie.tail_at[v] : trie.tail_at[v + 1]]
            if one_edit(rest, tail):
                accept(np.array([r]), trie.at[v : v + 1])
        row, node = row[~leaf], node[~leaf]
        here, following = chars[row, i], chars[row, np.minimum(i + 1, size[row])]
        inside = size[row] > i
        # Deleting a character of a run of equal ones is the same as deleting the last.
        cut = inside & (here != following)
        follow(row[cut], np.full(cut.sum(), i + 1), node[cut])
        # All children by another label: inserted before the character, or put in its place.
        n = trie.first[node + 1] - trie.first[node]
        at = np.repeat(np.arange(len(row)), n)
        to = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(trie.first[node], n)
        other = (trie.keys[to - 1] & 255) != here[at]
        at, to = at[other], to[other]
        follow(row[at], np.full(len(at), i), to)
        put = inside[at]
        follow(row[at[put]], np.full(put.sum(), i + 1), to[put])
        row, node, here = row[inside], node[inside], here[inside]
        node = trie.child(node, here)
        row, node = row[node >= 0], node[node >= 0]
        i += 1
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(words).astype(np.int64)


def one_edit(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sequences differ by exactly one inserted, deleted or replaced element."""
    if abs(len(a) - len(b)) > 1:
        return False
    n = min(len(a), len(b))
    apart = np.flatnonzero(a[:n] != b[:n])
    if len(a) == len(b):
        return len(apart) == 1
    k = apart[0] if len(apart) else n
    longer, shorter = (a, b) if len(a) > len(b) else (b, a)
    return bool((longer[k + 1 :] == shorter[k:]).all())
