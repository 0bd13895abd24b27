"""Best-fit packing by patterns: few-document length patterns, fitted to the histogram.

Documents (their token ids and an end id) longer than a sequence are cut into pieces of
the sequence's length, the first of which may be shorter. Of the pieces only the
histogram of lengths, one number per possible length, goes to the driver. There,
patterns of one to three lengths that fill a sequence are enumerated, their repeat
counts fitted to the histogram by non-negative least squares (coordinate descent on the
sparse columns), rounded down, and what remains is packed best-fit, largest first. The
plan says, for ranges of ranks within a length, which sequence and place they take; its
size depends on the sequence length alone. Pieces get their rank within their length
from salted buckets, so a length that most pieces have is dealt over many tasks.

Defined cases: null text is empty and gives the end id alone; repeated rows and ids are
packed each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.kernels import Texts, slices
from foliospark.llm.pretoken_spans import encodings, ids_of
from foliospark.llm.pretokens import pieces
from foliospark.llm.shared import written

VOCABULARY = "byte_bpe_50k.json"
LENGTH, END = 1024, 2
#: Pieces in a bucket of one length, about; the buckets follow the number of pieces.
BUCKET = 50_000

Pattern = tuple[int, ...]


def cut(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; only the first may be shorter."""
    first = n % length or length
    return [(0, min(first, n))] + [(s, length) for s in range(first, n, length)]


def texts_ids(path: str, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a slice's texts end to end, and where each text's ids start."""
    of = encodings(path)
    marked = [i for i in range(len(column)) if of.added and (x := column[i].as_py()) and any(a in x for a in of.added)] if _holds(column, of.added) else []
    if not marked:
        return ids_of(of, Texts(column))
    # texts that hold an added token's string are cut there, and put together again
    whole = pieces(path)
    parts, at = [], 0
    for i in [*marked, len(column)]:
        if i > at:
            ids, off = ids_of(of, Texts(column.slice(at, i - at)))
            parts += [ids[x:y] for x, y in zip(off[:-1], off[1:], strict=True)]
        if i < len(column):
            parts.append(np.frombuffer(whole.id_bytes(column[i].as_py()), "<u4"))
        at = i + 1
    return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])


def _holds(column: pa.Array, added: dict[str, int]) -> bool:
    return any(pa.compute.any(pa.compute.match_substring(column, a)).as_py() for a in added)


def _emit_pieces(path: str, length: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "k_body"):
            ids, off = texts_ids(path, b.column("k_body"))
            n = np.diff(off) + 1  # with the end id
            first = np.minimum((n - 1) % length + 1, n)
            count = (n - first) // length + 1
            doc = np.repeat(np.arange(len(n)), count)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            start = np.where(piece == 0, 0, first[doc] + (piece - 1) * length)
            size = np.where(piece == 0, first[doc], length)
            raw, tail = memoryview(ids.astype("<u4").tobytes()), end.to_bytes(4, "little")
            a = off[doc] + start
            z = np.minimum(a + size, off[doc + 1])
            last = start + size == n[doc]
            crc = [zlib.crc32(tail, c) if e else c for c, e in ((zlib.crc32(raw[4 * x : 4 * y]), e) for x, y, e in zip(a.tolist(), z.tolist(), last.tolist(), strict=True))]
            arrays = [b.column("doc_id").take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(size), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def patterns(have: np.ndarray, length: int) -> list[Pattern]:
    """All fills of a whole sequence by up to three pieces of lengths that occur."""
    there = np.flatnonzero(have)
    out: list[Pattern] = [(length,)] if have[length] else []
    out += [(int(length - a), int(a)) for a in there if 2 * a <= length and a and have[length - a]]
    for a in there[there > 0].tolist():
        b = np.arange(a, (length - a) // 2 + 1)
        b = b[(have[b] > 0) & (have[length - a - b] > 0)]
        out += [(length - a - x, x, a) for x in b.tolist()]
    return out


def fit(found: list[Pattern], have: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - have|, by cyclic coordinate descent."""
    none = len(have)  # stands for the pieces that shorter patterns lack
    left, x = [*have.astype(float).tolist(), 0.0], [0.0] * len(found)
    cost = [sum(p.count(a) ** 2 for a in set(p)) for p in found]
    three = [(*p, none, none)[:3] for p in found]
    for _ in range(sweeps):
        moved = 0.0
        for k, (a, b, c) in enumerate(three):
            new = x[k] + (left[a] + left[b] + left[c]) / cost[k]
            if new < 0.0:
                new = 0.0
            if (d := new - x[k]) != 0.0:
                x[k] = new
                left[a] -= d
                left[b] -= d
                left[c] -= d
                left[none] = 0.0
                moved = max(moved, abs(d))
        if moved < 0.25:
            break
    return np.array(x)


def plan(have: np.ndarray, length: int) -> list[tuple[Pattern, int]]:
    """(pattern, repeats) that use up the histogram exactly: the shortest of a few.

    They differ in the patterns that are fitted (all, or for short histograms, whose repeats
    would be spread below one, a thinned set as well), in the part of the fitted repeats
    that is taken before the rest is packed best-fit, and in whether the rest looks for
    exact fills of several pieces first, and among how many of its largest pieces.
    """
    found = patterns(have, length)
    thin = [p for p in found if len(p) < 3 or (p[1] - p[2]) % max(1, length // 32) == 0]
    tried = []
    for some in (found, thin):
        repeats = fit(some, have)
        tried += [_packed(have, length, some, np.floor(part * repeats + 1e-9), exact) for part in (1.0, 0.95, 0.8, 0.5) for exact in (0, 24, length)]
    return min(tried, key=lambda x: sum(n for _, n in x))


def _packed(have: np.ndarray, length: int, found: list[Pattern], repeats: np.ndarray, exact: int) -> list[tuple[Pattern, int]]:
    left = have.astype(np.int64).copy()
    out: list[tuple[Pattern, int]] = []

    def use(p: Pattern, most: int) -> None:
        n = min(most, *(int(left[a]) // p.count(a) for a in p))
        if n > 0:
            out.append((p, n))
            for a in p:
                left[a] -= n

    for k in np.argsort(-repeats, kind="stable")[: np.count_nonzero(repeats)]:
        use(found[k], int(repeats[k]))
    while (there := np.flatnonzero(left)).size:
        p, gap = [int(there[-1])], length - int(there[-1])
        spare = left.copy()
        spare[p[0]] -= 1
        while gap > 0 and (best := _filler(spare, gap, exact)):
            p += best
            for a in best:
                spare[a] -= 1
            gap -= sum(best)
        use(tuple(p), 1 << 62)
    return out


def _filler(spare: np.ndarray, gap: int, exact: int) -> list[int]:
    """Pieces that fill the gap exactly, at most three if asked (the first among the ``exact`` largest); else the largest that fits."""

    def pair(g: int) -> list[int]:
        a = np.arange(1, g // 2 + 1)
        good = (spare[a] > 0) & (spare[g - a] > (a == g - a))
        return [int(g - a[good][0]), int(a[good][0])] if good.any() else []

    if spare[gap]:
        return [gap]
    fits = np.flatnonzero(spare[:gap])
    if exact and (both := pair(gap)):
        return both
    if exact:
        there = np.minimum(spare[: gap + 1], 1).astype(float)
        there[0] = 0
        two = np.convolve(there, there)  # which gaps two lengths that occur could fill
        first = fits[::-1][:exact]
        for c in first[two[gap - first] > 0].tolist():
            spare[c] -= 1
            rest = pair(gap - c)
            spare[c] += 1
            if rest:
                return [c, *rest]
    return [int(fits[-1])] if fits.size else []


def ranges(packed: list[tuple[Pattern, int]], length: int) -> dict[str, np.ndarray]:
    """Ranges of ranks within lengths: from which rank on, first sequence, offset."""
    seen = np.zeros(length + 1, np.int64)
    rows, sequence = [], 0
    for p, n in packed:
        at = 0
        for a in p:
            rows.append((a, int(seen[a]), sequence, at))
            seen[a] += n
            at += a
        sequence += n
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 4)
    return {"key": (cols[:, 0] << 44) | cols[:, 1], "rank": cols[:, 1], "sequence": cols[:, 2], "offset": cols[:, 3]}


def _place(of: dict[str, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, rank = (np.asarray(b.column(c), dtype=np.int64) for c in ("length", "rank"))
            at = np.searchsorted(of["key"], (size << 44) | rank, side="right") - 1
            cols = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(of["sequence"][at] + rank - of["rank"][at]), pa.array(of["offset"][at])],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, length: int = LENGTH, end: int = END) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    body = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("k_body"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    cuts = written(body.mapInArrow(_emit_pieces(path or public_tokenizers.path(VOCABULARY), length, end), schema), "pieces")
    have = np.zeros(length + 1, np.int64)
    for row in cuts.groupBy("length").count().collect():  # at most one row per length
        have[row["length"]] = row["count"]
    buckets = int(have.max()) // BUCKET + 1
    salted = cuts.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    sizes = salted.groupBy("length", "bucket").count()
    before = sizes.withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("bucket")) - F.col("count")).drop("count")
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = salted.withColumn("k", F.row_number().over(order)).join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("k") - 1)
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        _place(ranges(plan(have, length), length)), schema + ", sequence_id long, offset long"
    )
