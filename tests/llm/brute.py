"""Plain Python versions of the operators' contracts."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def byte_repeats(rows: list[tuple], length: int) -> list[tuple]:
    raws = [(x or "").encode() for _, x in rows]
    seen = Counter(r[j : j + length] for r in raws for j in range(len(r) - length + 1))
    out = []
    for (i, _), r in zip(rows, raws, strict=True):
        gone = bytearray(len(r))
        for j in range(len(r) - length + 1):
            if seen[r[j : j + length]] > 1:
                gone[j : j + length] = b"\1" * length
        out.append((i, len(r), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(bytes(a for a, g in zip(r, gone, strict=True) if not g))))
    return out


def word_repeats(rows: list[tuple], width: int) -> list[tuple]:
    first: dict[tuple, int] = {}
    for i, x in rows:
        w = WORD.findall(x or "")
        for j in range(len(w) - width + 1):
            k = tuple(w[j : j + width])
            first[k] = min(first.get(k, 1 << 62), i if i is not None else 1 << 62)
    out = []
    for i, x in rows:
        w = WORD.findall(x or "")
        gone = [False] * len(w)
        for j in range(len(w) - width + 1):
            if first[tuple(w[j : j + width])] < (i if i is not None else 1 << 62):
                gone[j : j + width] = [True] * width
        out.append((i, len(w), sum(gone), sha(" ".join(a for a, g in zip(w, gone, strict=True) if not g).encode())))
    return out


def shingles(x: str | None, n: int = 5) -> set:
    w = WORD.findall((x or "").translate(_LOW))
    return {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


class Union:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, i):
        while self.up[i] != i:
            i = self.up[i]
        return i

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def jaccard(rows: list[tuple]) -> list[tuple]:
    sets = {i: shingles(x) for i, x in rows}
    by, both = defaultdict(list), Counter()
    for i, s in sets.items():
        for g in s:
            by[g].append(i)
    for ids in by.values():
        for a in range(len(ids)):
            for b in range(a):
                both[ids[b], ids[a]] += 1
    u = Union(sets)
    for (a, b), o in both.items():
        if 100 * o >= 75 * (len(sets[a]) + len(sets[b]) - o):
            u.join(a, b)
    return [(i, len(s), u.find(i)) for i, s in sets.items()]


def base_figures(x: str | None) -> tuple:
    x = x or ""
    w = WORD.findall(x)
    tri = Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
    cover = [False] * len(w)
    for j in range(len(w) - 2):
        if tri[tuple(w[j : j + 3])] > 1:
            cover[j : j + 3] = [True] * 3
    seen, dup = set(), 0
    for line in x.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in x), dup, sum(cover), len(w) < 50 or 100 * sum(cover) > 50 * len(w)


def line_key(line: str) -> tuple:
    return tuple(WORD.findall(line.translate(_LOW)))
