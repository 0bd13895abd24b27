"""Periodic runs of words, found by probing harmonic grids and extending the hits.

A run is a longest stretch of a document's words with smallest period q (words q apart
are the same) of at least ``least`` words and ``times`` periods. In a run of period p,
every place but the last p has its word again p places on, and among these places are
``times`` - 1 neighbouring multiples of p. So for each p only the grid 0, p, 2p, ... is
probed: word jp against word (j+1)p, over all p about n ln n comparisons of whole
arrays. Where that many neighbouring points agree, points between them are probed, and
what survives is extended both ways by comparing ever longer chunks.

Grid points are passed over within a run found before whose period divides p: the
stretch with period p there is that run. Periods are taken in ranges from a power of two
to the next, in which none divides another, so all such runs are known beforehand.

Defined cases: a null or empty text has no words and no runs; a document that repeats an
id is worked out for each row; an empty table gives an empty result. Texts may be of any
length: probes are made ``PROBES`` at a time. Other columns are carried along under their
names; a clash with the name of a new column is an error that names it. Words are compared
by 64-bit codes: in a document of n distinct words the chance of a clash is about n*n / 2**65.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from foliospark.llm.kernels import Texts, Words, ints, slices, spread

LEAST, TIMES = 24, 3
#: Grid points probed at a time.
PROBES = 1 << 18
#: Words compared at first when a run is extended; doubled while they agree.
CHUNK = 32
RUN = StructType([StructField(c, LongType(), False) for c in ("start", "length", "period")])


def grids(n: int, times: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(period, place) of all grid points with a point after them, for stretches of periods."""
    lo = 1
    while lo * times <= n:
        hi = min(1 << lo.bit_length(), n // times + 1)  # up to the next power of two
        points = (n - 1) // np.arange(lo, hi)
        upto = np.cumsum(points)
        a = 0
        while a < hi - lo:
            z = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PROBES, side="right")))
            period = np.repeat(np.arange(lo + a, lo + z), points[a:z])
            yield period, period * spread(np.zeros(z - a, np.int64), points[a:z])
            a = z
        lo = hi


def agree(w: np.ndarray, at: int, p: int, step: int) -> int:
    """How many places in a row from ``at`` on, in the direction of ``step``, have their word again p on."""
    done, size = 0, CHUNK
    while True:
        a = at + step * done
        n = min(size, len(w) - p - a if step > 0 else a + 1)
        if n <= 0:
            return done
        lo = a if step > 0 else a - n + 1
        same = w[lo : lo + n] == w[lo + p : lo + p + n]
        if not same.all():
            return done + int(np.argmin(same if step > 0 else same[::-1]))
        done += n
        size *= 2


class Found:
    """Runs found so far, by period, in order of start."""

    def __init__(self):
        self.by: dict[int, tuple[list[int], list[int]]] = {}

    def add(self, start: int, end: int, period: int) -> None:
        a, z = self.by.setdefault(period, ([], []))
        a.append(start)
        z.append(end)

    def outside(self, period: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which probes (at, at + period) lie in no run whose period divides theirs."""
        out = np.ones(len(at), bool)
        for q, (a, z) in self.by.items():
            of = np.flatnonzero(out & (period % q == 0))
            if len(of):
                k = np.searchsorted(a, at[of], side="right") - 1
                out[of] = (k < 0) | (np.array(z)[k] <= at[of] + period[of])
        return out

    def end_over(self, p: int, at: int) -> int:
        """The end of the run of period p over a place, or 0."""
        a, z = self.by.get(p, ((), ()))
        k = bisect_right(a, at) - 1
        return z[k] if k >= 0 and z[k] > at else 0


def runs(w: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a row of codes, by start, then period."""
    found = Found()
    for period, at in grids(len(w), times):
        hit = w[at] == w[at + period]
        ok = hit[: len(hit) - times + 2].copy()
        for k in range(1, times - 1):
            ok &= hit[k : k + len(ok)] & (period[k : k + len(ok)] == period[: len(ok)])
        live = np.flatnonzero(ok)
        for part in (2, 4, 3):  # all places between agreeing grid points of a run agree
            live = live[w[at[live] + period[live] // part] == w[at[live] + period[live] // part + period[live]]]
        live = live[found.outside(period[live], at[live])]
        for p, x in zip(period[live].tolist(), at[live].tolist(), strict=True):
            if found.end_over(p, x) > x + p:
                continue
            start = x + 1 - agree(w, x, p, -1)
            end = x + agree(w, x, p, 1) + p
            if end - start >= max(least, times * p):
                found.add(start, end, p)
    return sorted((a, z - a, p) for p, (starts, ends) in found.by.items() for a, z in zip(starts, ends, strict=True))


def _dropped(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stand in a run after its first period."""
    delta = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        delta[start + period] += 1
        delta[start + length] -= 1
    return np.cumsum(delta[:n]) > 0


def joined(t: Texts, w: Words, which: np.ndarray, counts: np.ndarray) -> list[str]:
    """The named words joined by one space, for each text its number of them."""
    size = w.end[which] - w.start[which] + 1
    data = t.data[spread(w.start[which], size)]
    ends = np.cumsum(size)
    data[ends - 1] = 0x20
    raw = data.tobytes()
    off = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
    return [raw[a : max(a, z - 1)].decode("utf-8") for a, z in zip(off[:-1], off[1:], strict=True)]


def periodic_runs(docs: DataFrame, text_col: str = "text", runs_col: str = "runs", rest_col: str | None = "collapsed", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """``docs``, the runs of each text (array of start, length, period, by start, then period)
    and its words without those in a run after its first period, joined by one space."""
    if times < 3:
        raise ValueError("runs of under three periods need not hold two neighbouring grid points")
    new = [runs_col, *([rest_col] if rest_col else [])]
    if clash := sorted(set(new) & set(docs.columns)):
        raise ValueError(f"there are columns {clash} already")
    inner = docs.toDF(*[f"c_{i}" for i in range(len(docs.columns))])
    body = f"c_{docs.columns.index(text_col)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(c, pa.int64()) for c in RUN.names]))
        for b in slices(batches, body):
            t = Texts(b.column(body))
            w = Words(t)
            keep, held = np.ones(w.n, bool), []
            for a, z in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True):
                found = runs(w.code[a:z], least, times) if z - a >= least else []
                keep[a:z] &= ~_dropped(z - a, found)
                held.append([dict(zip(RUN.names, r, strict=True)) for r in found])
            cols = [*b.columns, pa.array(held, kind)]
            if rest_col:
                which = np.flatnonzero(keep)
                cols.append(pa.array(joined(t, w, which, np.diff(np.searchsorted(which, w.bounds))), pa.string()))
            yield pa.RecordBatch.from_arrays(cols, [*b.schema.names, *[f"n_{i}" for i in range(len(new))]])

    kinds = [ArrayType(RUN, False), StringType()]
    out = inner.mapInArrow(run, StructType([*inner.schema.fields, *[StructField(f"n_{i}", kinds[i]) for i in range(len(new))]]))
    return out.toDF(*docs.columns, *new)


def _tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text"):
        t = Texts(b.column("text"))
        w = Words(t, codes=False)
        n, h = w.counts(), ints(b.column("h"))
        g = h // 10
        of, which = (h >= 0) & (h % 10 == 0) & (n > 0), []
        for d in range(b.num_rows):
            i = np.arange(n[d])
            if of[d]:
                a = int(g[d] % n[d])
                p = 1 + (int(n[d]) - a) // (3 + int(g[d] % 8))
                i = np.where(i < a, i, a + (i - a) % p)
            which.append(w.bounds[d] + i)
        text = joined(t, w, np.concatenate(which), n)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(text, pa.string())], ["doc_id", "text"])


def with_tails(docs: DataFrame) -> DataFrame:
    """doc_id and words of every text, where a tenth of the documents (those whose id has a
    CRC-32 that ten divides) go on from some word by repeating what stands there."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.crc32(F.col("doc_id").cast("long").cast("string")).alias("h"))
    return keyed.mapInArrow(_tails, "doc_id long, text string")


def runs_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of greatest length / period, digests of all runs and of the rest.

    Of equal ratios the run with the smallest start, then period, counts.
    """
    found = periodic_runs(with_tails(docs))
    none = F.lit(None).cast(RUN)
    best = F.aggregate("runs", none, lambda x, r: F.when(x.isNull() | (r["length"] * x["period"] > x["length"] * r["period"]), r).otherwise(x))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
