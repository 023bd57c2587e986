"""Maximum-scoring segments of a token sequence, for use inside Arrow tasks."""

from __future__ import annotations

import re
from math import exp

#: Runs of letters.
TOKEN = re.compile(r"[^\W\d_]+")


#: Lengths of the word beginnings that stand for inflected forms of one stem.
STEMS = range(4, 9)


def tokens_of(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


def units_of(token: str) -> list[str]:
    """The token and its beginnings, marked by a star."""
    return [token, *(f"{token[:k]}*" for k in STEMS if len(token) >= k)]


def maximal_segments(hits: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score), in one left-to-right pass.

    ``hits`` are (position, weight) of the tokens with a positive score, in
    order; every other token scores ``-drift``.  A segment is maximal if its
    score falls with every cut or extension and no better one contains it.
    Each candidate keeps the cumulative score before it and at its end; a new
    one is merged leftwards while an earlier candidate starts lower and ends
    lower.  Links to the last candidate that starts lower make this linear.
    """
    stack: list[tuple[int, int, float, float, int]] = []
    total, done = 0.0, 0
    for at, weight in hits:
        total -= drift * (at - done)
        done = at + 1
        first, last, low, high = at, at, total, total + weight
        total = high
        j = len(stack) - 1
        while True:
            while j >= 0 and stack[j][2] >= low:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= high:
                stack.append((first, last, low, high, j))
                break
            first, low = stack[j][0], stack[j][2]
            below = stack[j][4]
            del stack[j:]
            j = below
    return [(first, last, high - low) for first, last, low, high, _ in stack]


def score_rate(chances: list[tuple[float, float]], drift: float) -> float:
    """The rate of the extreme-value law: the positive root of E[exp(rate * score)] = 1.

    ``chances`` are (probability, weight) of the tokens with positive score.
    """
    others = 1 - sum(p for p, _ in chances)
    if not chances:
        return 1.0

    def excess(rate: float) -> float:
        return sum(p * exp(min(rate * w, 700.0)) for p, w in chances) + others * exp(-rate * drift) - 1

    low, high = 1e-6, 1.0
    while excess(high) < 0 and high < 64:
        high *= 2
    if excess(low) > 0:
        return low
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if excess(middle) > 0 else (middle, high)
    return high
