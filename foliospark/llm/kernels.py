"""Vectorised numpy kernels over Arrow string buffers: words, fingerprints, windows.

All kernels work on one bounded slice of a column (``slices``), keep word and
document boundaries, and use 64-bit wrap-around arithmetic throughout.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute

SLICE_BYTES = 1 << 20
U64 = np.uint64
_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], U64)
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values (xor-shift and multiply); a bijection."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """B**0 .. B**(n-1) modulo 2**64, or those of the inverse of B."""
    key = (inverse,)
    have = _POWERS.get(key)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        out = np.full(size, U64(_INV if inverse else _BASE))
        out[0] = 1
        _POWERS[key] = have = np.multiply.accumulate(out)
    return have[:n]


_POWERS: dict = {}


class Texts:
    """A slice of a text column: bytes end to end, with document offsets."""

    def __init__(self, column: pa.Array):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
            column = column.cast(pa.large_binary())
            kind = np.int64
        else:
            column = column.cast(pa.binary())
            kind = np.int32
        if column.null_count:
            column = column.fill_null(b"")
        n = len(column)
        _, offsets, data = column.buffers()
        off = np.frombuffer(offsets, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64) if n else np.zeros(1, np.int64)
        self.n = n
        self.off = off - off[0]
        size = int(self.off[-1])
        self.data = np.zeros(size + 8, np.uint8)  # eight bytes of padding for whole loads
        if size:
            self.data[:size] = np.frombuffer(data, np.uint8, size, int(off[0]))
        self.size = size

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.off[i] : self.off[i + 1]].tobytes()


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+``: byte spans, document bounds, 64-bit codes."""

    def __init__(self, t: Texts, lower: bool = False, codes: bool = True):
        self.texts = t
        data = t.data[: t.size]
        if lower:
            up = (data >= 65) & (data <= 90)
            t.data[: t.size][up] += 32
        inside = ~_SEP[data] if t.size else np.zeros(0, bool)
        edge = np.zeros(t.size + 1, bool)
        edge[t.off] = True
        first = inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | edge[1:-1]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.n = len(self.start)
        #: words of document d: bounds[d] .. bounds[d + 1]
        self.bounds = np.searchsorted(self.start, t.off)
        self.code = span_codes(t.data, self.start, self.end) if codes else None

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.texts.n), self.counts())


def span_codes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit code of each byte span; eight bytes at a time."""
    words = np.lib.stride_tricks.as_strided(data.view(np.uint8), (max(len(data) - 7, 0), 8), (1, 1))
    length = end - start
    h = mix(length.astype(U64) + U64(_BASE))
    left, at, live = length, start, None
    while True:
        if live is None:
            if not len(at):
                return h
            chunk = words[at].view(U64).ravel() & _MASK[np.minimum(left, 8)]
            h = mix(h ^ chunk) + U64(_BASE)
            live = np.flatnonzero(left > 8)
        else:
            chunk = words[at].view(U64).ravel() & _MASK[np.minimum(left, 8)]
            h[live] = mix(h[live] ^ chunk) + U64(_BASE)
            live = live[left > 8]
        if not len(live):
            return h
        keep = left > 8
        left, at = left[keep] - 8, at[keep] + 8


def rolling(codes: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp fingerprints of every run of ``width`` codes (boundaries ignored)."""
    n = len(codes)
    if n < width:
        return np.zeros(0, U64)
    total = np.zeros(n + 1, U64)
    np.cumsum(codes * powers(n), out=total[1:])
    out = (total[width:] - total[:-width]) * powers(n, inverse=True)[: n - width + 1]
    return mix(out)


def run_starts(bounds: np.ndarray, width: int, n: int) -> np.ndarray:
    """True at each start from which ``width`` units stay inside one document."""
    ok = np.zeros(max(n - width + 1, 0), bool)
    if not len(ok):
        return ok
    delta = np.zeros(n + 2, np.int32)
    a, b = bounds[:-1], bounds[1:] - width + 1
    good = b > a
    np.add.at(delta, a[good], 1)
    np.add.at(delta, b[good], -1)
    return np.cumsum(delta)[: len(ok)] > 0


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by block prefix and suffix minima."""
    n = len(x)
    if n < width:
        return np.zeros(0, x.dtype)
    if width == 1:
        return x.copy()
    rows = -(-n // width)
    padded = np.full(rows * width, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    block = padded.reshape(rows, width)
    left = np.minimum.accumulate(block, axis=1).ravel()
    right = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of intervals sorted by start."""
    if not len(start):
        return start, end
    reach = np.maximum.accumulate(end)
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return start[at], reach[np.append(at[1:] - 1, len(start) - 1)]


def cuts(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(start, rows) of stretches of a text column of near ``most`` bytes each."""
    size = np.cumsum(np.asarray(pa.compute.binary_length(column.cast(pa.large_binary())).fill_null(0), dtype=np.int64))
    at, n = 0, len(column)
    while at < n:
        base = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, base + most, side="right")))
        yield at, to - at
        at = to


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the named text column stays near ``most`` bytes."""
    for batch in batches:
        for at, n in cuts(batch.column(batch.schema.get_field_index(column)), most):
            yield batch.slice(at, n)
    give_back()


def give_back() -> None:
    """Return freed memory to the system at the end of a task; workers are kept for others."""
    _POWERS.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def as_long(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def ints(column: pa.Array) -> np.ndarray:
    """A column of integers as int64 (nulls as the smallest value)."""
    return np.asarray(column.cast(pa.int64()).fill_null(np.iinfo(np.int64).min), dtype=np.int64)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType = pa.int64()) -> pa.Array:
    """A list column from values in row order and the number of them in each row."""
    off = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values, kind))


def groups(batches: Iterator[pa.RecordBatch], key: str, most: int | None = None) -> Iterator[pa.Table]:
    """Runs of rows with equal key from sorted batches; cut at ``most`` rows."""
    held: list[pa.RecordBatch] = []
    at = None
    for b in batches:
        if not b.num_rows:
            continue
        k = ints(b.column(key))
        cuts = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]])
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            if held and at != k[a]:
                yield from _blocks(held, most)
                held = []
            at = k[a]
            held.append(b.slice(a, z - a))
            if most and sum(x.num_rows for x in held) >= 2 * most:
                yield from _blocks(held, most)
                held = []
    if held:
        yield from _blocks(held, most)


def _blocks(held: list[pa.RecordBatch], most: int | None) -> Iterator[pa.Table]:
    t = pa.Table.from_batches(held)
    n = t.num_rows
    if not most or n <= most:
        yield t
        return
    size = -(-n // -(-n // most))
    for a in range(0, n, size):
        yield t.slice(a, size)


def spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions first[k] .. first[k] + size[k] - 1 for every k, end to end."""
    size = size.astype(np.int64)
    total = int(size.sum())
    ends = np.cumsum(size)
    return np.repeat(first - (ends - size), size) + np.arange(total)
