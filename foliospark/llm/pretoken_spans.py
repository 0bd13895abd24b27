"""Pre-token spans of whole text slices by numpy, and a bounded table of what they encode to.

The spans are those of the pattern in ``pretokens.SPLIT``, found from character classes
and run boundaries over the UTF-8 bytes of many texts at once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import regex
from tokenizers import Tokenizer

from foliospark.llm.kernels import U64, Texts, span_codes, spread

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: Slots of a worker's table (a power of two); it is thinned when half of them are taken,
#: and asked for the pieces of a quarter as many pre-tokens at a time.
SLOTS = 1 << 21


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of every code point, as the pattern's properties have it."""
    out = np.full(0x110000, OTHER, np.uint8)
    low, high = "".join(map(chr, range(0xD800))), "".join(map(chr, range(0xE000, 0x110000)))
    for base, text in ((0, low), (0xE000, high)):
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for m in regex.finditer(pattern, text):
                out[base + m.start() : base + m.end()] = kind
    return out


def classes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of each byte's character, and whether the byte starts a character."""
    table = _classes()
    kind = table[:256][data]
    lead = (data & 0xC0) != 0x80
    wide = np.flatnonzero(data >= 0xC0)
    if len(wide):
        d = np.append(data, np.zeros(3, np.uint8)).astype(np.int32)
        first = d[wide]
        point = np.where(first < 0xE0, ((first & 0x1F) << 6) | (d[wide + 1] & 0x3F), 0)
        three = (first >= 0xE0) & (first < 0xF0)
        point = np.where(three, ((first & 0x0F) << 12) | ((d[wide + 1] & 0x3F) << 6) | (d[wide + 2] & 0x3F), point)
        four = first >= 0xF0
        point = np.where(four, ((first & 0x07) << 18) | ((d[wide + 1] & 0x3F) << 12) | ((d[wide + 2] & 0x3F) << 6) | (d[wide + 3] & 0x3F), point)
        own = table[np.minimum(point, 0x10FFFF)]
        kind[wide] = own
        n = len(kind)
        for k, at in ((1, np.ones(len(wide), bool)), (2, three | four), (3, four)):
            pos = wide[at] + k
            ok = pos < n
            kind[pos[ok]] = own[at][ok]
    return kind, lead


def spans(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts of all pre-tokens in order, and the first pre-token of each text."""
    n = t.size
    if not n:
        return np.zeros(0, np.int64), np.zeros(t.n + 1, np.int64)
    data = t.data[:n]
    kind, lead = classes(data)
    edge = np.zeros(n + 1, bool)
    edge[t.off] = True
    new = np.ones(n, bool)
    new[1:] = (kind[1:] != kind[:-1]) | edge[1:-1]
    run = np.flatnonzero(new)
    stop = np.append(run[1:], n)
    is_space = kind[run] == SPACE
    start = np.zeros(n, bool)
    # words, numbers, others: from their run or the blank right before it
    solid = run[~is_space]
    blank = (solid > 0) & (data[np.maximum(solid - 1, 0)] == 0x20) & ~edge[solid]
    start[solid - blank] = True
    # white space: what a following run does not take
    a, z = run[is_space], stop[is_space]
    inner = ~edge[z]  # something follows in the same text (z is a run start there)
    last = z - 1  # start of the run's last character
    for _ in range(3):
        last = np.where(lead[last], last, last - 1)
    takes = inner & (data[z - 1] == 0x20)
    start[a[~takes | (last > a)]] = True
    split = inner & ~takes & (last > a)
    start[last[split]] = True
    # contractions: a lone apostrophe, no blank before it, and its letters
    mark = run[(data[run] == 0x27) & (stop - run == 1)]
    mark = mark[(mark == 0) | (data[np.maximum(mark - 1, 0)] != 0x20) | edge[mark]]
    mark = mark[(mark + 1 < n)]
    mark = mark[~edge[mark + 1]]
    if len(mark):
        pad = np.append(data, np.zeros(3, np.uint8))
        one, two = pad[mark + 1], pad[mark + 2]
        pair = ((one == 0x72) & (two == 0x65)) | ((one == 0x76) & (two == 0x65)) | ((one == 0x6C) & (two == 0x6C))
        pair &= ~edge[np.minimum(mark + 2, n)]
        single = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        for hit, size in ((single, 2), (pair & ~single, 3)):
            m = mark[hit]
            start[m + 1] = False
            rest = m + size
            ok = rest < n
            start[rest[ok & (kind[np.minimum(rest, n - 1)] == LETTER) & ~edge[np.minimum(rest, n)]]] = True
    at = np.flatnonzero(start)
    return at, np.searchsorted(at, t.off)


class Encodings:
    """Ids of pre-tokens by their 64-bit code; each distinct one is encoded once.

    Open addressing over a fixed number of keys; when half are taken, those seen once go,
    or all. As no more than a quarter are looked up at a time, there is always room.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError(f"not a plain byte-level BPE: {path}")
        self.model = Tokenizer.from_file(path).model
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {b: b for b in plain} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        self.shown = {b: chr(c) for b, c in shown.items()}
        self.clear()

    def clear(self) -> None:
        self.slots_, self.most = SLOTS, SLOTS // 2
        self.key = np.zeros(SLOTS, U64)
        self.first, self.size, self.seen = np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int32), np.zeros(SLOTS, np.uint8)
        self.pool, self.used, self.taken = np.zeros(1 << 20, np.uint32), 0, 0

    def _home(self, code: np.ndarray) -> np.ndarray:
        return (code >> U64(20)).astype(np.int64) & (self.slots_ - 1)

    def find(self, code: np.ndarray) -> np.ndarray:
        """Slots of the codes; -1 where there is none."""
        at = self._home(code)
        there = self.key[at]
        out = np.where(there == code, at, -1)
        live = np.flatnonzero((there != code) & (there != 0))
        while len(live):
            at[live] = (at[live] + 1) & (self.slots_ - 1)
            there = self.key[at[live]]
            hit = there == code[live]
            out[live[hit]] = at[live[hit]]
            live = live[~hit & (there != 0)]
        return out

    def _put(self, code: np.ndarray, first: np.ndarray, size: np.ndarray, seen: np.ndarray) -> None:
        at, live = self._home(code), np.arange(len(code))
        while len(live):
            free = self.key[at[live]] == 0
            spot, which = np.unique(at[live[free]], return_index=True)
            won = live[free][which]
            self.key[spot], self.first[spot], self.size[spot], self.seen[spot] = code[won], first[won], size[won], seen[won]
            live = np.setdiff1d(live, won, assume_unique=True)
            at[live] = np.where(self.key[at[live]] == 0, at[live], (at[live] + 1) & (self.slots_ - 1))
        self.taken += len(code)

    def learn(self, code: np.ndarray, words: list[bytes]) -> None:
        ids = [[t.id for t in self.model.tokenize("".join(map(self.shown.__getitem__, w)))] for w in words]
        size = np.fromiter(map(len, ids), np.int32, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.uint32, int(size.sum()))
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(flat)), np.uint32)])
        self.pool[self.used : self.used + len(flat)] = flat
        first = self.used + np.cumsum(size, dtype=np.int64) - size
        self.used += len(flat)
        self._put(code, first, size, np.zeros(len(code), np.uint8))

    def _thin(self) -> None:
        keep = np.flatnonzero((self.key != 0) & (self.seen > 0))
        if len(keep) > self.most // 2:
            keep = keep[:0]
        code, first, size, pool = self.key[keep], self.first[keep], self.size[keep], self.pool
        self.clear()
        flat = pool[spread(first, size)]
        self.pool = np.concatenate([flat, np.zeros(1 << 20, np.uint32)])
        self.used = len(flat)
        self._put(code, np.cumsum(size, dtype=np.int64) - size, size, np.zeros(len(code), np.uint8))

    def slots(self, t: Texts, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The slot of each pre-token, after encoding those that are new; of at most a
        quarter as many pre-tokens as there are slots."""
        code = span_codes(t.data, start, end)
        code[code == 0] = 1
        slot = self.find(code)
        miss = np.flatnonzero(slot < 0)
        if len(miss):
            new, which = np.unique(code[miss], return_index=True)
            if self.taken + len(new) > self.most:
                self._thin()
                slot = self.find(code)
                miss = np.flatnonzero(slot < 0)
                new, which = np.unique(code[miss], return_index=True)
            a, z = start[miss[which]].tolist(), end[miss[which]].tolist()
            view = memoryview(t.data)
            self.learn(new, [bytes(view[x:y]) for x, y in zip(a, z, strict=True)])
            slot[miss] = self.find(code[miss])
        self.seen[slot] = np.minimum(self.seen[slot], 254) + 1
        return slot

    def parts(self, t: Texts, start: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(from, to, slots) of stretches of the pre-tokens; the slots hold until the next."""
        step = max(1, self.slots_ // 4)
        end = np.append(start[1:], t.size)
        for a in range(0, len(start), step):
            z = min(a + step, len(start))
            yield a, z, self.slots(t, start[a:z], end[a:z])


def ids_of(e: Encodings, t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts end to end (uint32), and where each text's ids start.

    Added tokens whose string stands in a text count as one token there.
    """
    start, bound = spans(t)
    ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
    for _, _, slot in e.parts(t, start):
        size = e.size[slot]
        ids.append(e.pool[spread(e.first[slot], size)])
        sizes.append(size)
    off = np.concatenate([[0], np.cumsum(np.concatenate(sizes), dtype=np.int64)])[bound]
    return np.concatenate(ids), off


@lru_cache(maxsize=2)
def encodings(path: str) -> Encodings:
    """One per worker and vocabulary file."""
    return Encodings(path)
