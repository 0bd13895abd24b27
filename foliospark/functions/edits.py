"""Levenshtein distance of two sequences of any length, exact, on the bits of large integers."""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Callable, Hashable, Sequence

#: Distance beyond the difference in length that is tried first, and what it grows by; characters of a block at least; bytes of bits held.
FIRST, GROWS, BLOCK, HELD = 2000, 4, 512, 32 << 20


def middle(a: Sequence, b: Sequence) -> tuple[Sequence, Sequence]:
    """Both sequences without their common beginning and end: their distance stays the same."""
    low, high = 0, min(len(a), len(b))
    while low < high:  # the longest common beginning, by halving
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    a, b = a[low:], b[low:]
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[len(a) - mid :] == b[len(b) - mid :] else (low, mid - 1)
    return a[: len(a) - low], b[: len(b) - low]


def distance(a: Sequence[Hashable] | None, b: Sequence[Hashable] | None) -> int | None:
    """Levenshtein distance of two strings or lists; null where one is null.

    A band of diagonals that grows until the distance fits in it, so that long texts that have
    much in common take little more than their length.
    """
    if a is None or b is None:
        return None
    a, b = middle(a, b)
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    places: dict[Hashable, array] = {}
    for i, c in enumerate(a):
        places.setdefault(c, array("I")).append(i)
    m, more = len(a), FIRST
    while (most := m - len(b) + more) < m // 2:
        if (found := _in_band(places, m, b, most)) is not None:
            return found
        more *= GROWS
    return _whole(places, m, b)


def _bits(places: dict[Hashable, array], low: int, high: int) -> Callable[[Hashable], int]:
    """Function of a character to the bits of its places from ``low`` to ``high``."""
    none, size = array("I"), (high - low) // 8 + 1
    held: dict[Hashable, int] = {}

    def of(c: Hashable) -> int:
        out = held.get(c)
        if out is None:
            at = places.get(c, none)
            start, end = bisect_left(at, max(low, 0)), bisect_left(at, high)
            if start == end:
                return 0
            raw = bytearray(size)
            for i in at[start:end]:
                raw[(i - low) >> 3] |= 1 << ((i - low) & 7)
            if (len(held) + 1) * size > HELD:
                held.clear()
            out = held[c] = int.from_bytes(raw, "little")
        return out

    return of


def _whole(places: dict[Hashable, array], m: int, b: Sequence[Hashable]) -> int:
    """Distance of ``b`` to a sequence of ``m`` places, a column of the table for each step (Myers, Hyyrö)."""
    full, last = (1 << m) - 1, m - 1
    up, down, score, bits = full, 0, m, _bits(places, 0, m)
    for c in b:
        x = bits(c)
        same = ((((x & up) + up) ^ up) | x | down) & full
        right, left = down | (full ^ (same | up)), same & up
        score += (right >> last) - (left >> last)
        right = (right << 1 | 1) & full
        left = (left << 1) & full
        up, down = left | (full ^ (same | right)), same & right
    return score


def _in_band(places: dict[Hashable, array], m: int, b: Sequence[Hashable], most: int) -> int | None:
    """As ``_whole`` where the distance is at most ``most``, else None: only the diagonals that such a distance can touch."""
    n = len(b)
    below, above = (most + m - n) // 2, (most - m + n) // 2
    width = below + above + 1
    full, last = (1 << width) - 1, width - 1
    up, down, score, block = full >> above << above, 0, below, max(BLOCK, width // 2)
    for start in range(0, n, block):
        bits = _bits(places, start - above, min(start + block, n) + below)
        for j in range(start, min(start + block, n)):
            x = (bits(b[j]) >> (j - start)) & full
            same = ((((x & up) + up) ^ up) | x | down) & full
            right, left = down | (full ^ (same | up)), same & up
            if j + below < m:  # the lowest diagonal, until it is at the last row; then along the row
                score += 1 - (same >> last)
            else:
                row = m - 1 - j + above
                score += (right >> row & 1) - (left >> row & 1)
            same >>= 1
            up, down = left | (full ^ (same | right)), same & right
        if min(start + block, n) + below <= m and score > most + n - m + below:
            return None
    return score if score <= most else None
