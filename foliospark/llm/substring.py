"""Substring dedup: Rabin-Karp fingerprints of token windows, counted in Spark.

A window is ``width`` consecutive words of one document. A word goes when a window
over it also starts in a document with a smaller id; windows are judged on the input.

Plan. (1) Every window holds a smallest half-width fingerprint (its anchor); a window
that two documents share has its anchor in both, so anchors seen in one document only
rule their windows out without loss. (2) All other windows are emitted as 64-bit
Rabin-Karp fingerprints. (3) Spark finds the smallest document of each fingerprint by
an aggregation that combines before the shuffle, and joins it back (a join that AQE
splits when one fingerprint is hot). (4) Repeated windows merge into maximal removal
intervals of their document.

Defined cases: a null text has no words; a null id counts as larger than every id and
rows without id never stand for each other; rows that repeat an id are one document,
each with its own text; an empty table gives an empty result. Further columns are
carried along unread. Windows are told apart by 96 bits, two fingerprints of different
word codes: with n windows the chance of any false match is about n*n / 2**97.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.kernels import U64, Texts, Words, as_long, ints, lists, merged, mix, rolling, run_starts, slices, sliding_min
from foliospark.llm.shared import done_with, few, written

WIDTH = 50
_LAST = (1 << 63) - 1
#: Rows and list elements that may go to every task where the lists are few (sixteen megabytes or so).
SENT = 2_000_000


def _keyed(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("k_id"),
        F.coalesce(F.xxhash64(text_col), F.lit(0)).alias("k_text"),
        F.col(text_col).alias("k_body"),
        *[F.col(c) for c in more],
    )


def _window_anchors(w: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows inside documents and the anchor of each."""
    half = (width + 1) // 2
    ok = np.flatnonzero(run_starts(w.bounds, width, w.n))
    return ok, sliding_min(rolling(w.code, half), width - half + 1)[ok]


def _emit_anchors(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "k_body"):
            w = Words(Texts(b.column("k_body")))
            at, anchor = _window_anchors(w, width)
            doc = np.searchsorted(w.bounds, at, side="right") - 1
            new = np.ones(len(at), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
            doc, anchor = doc[new], anchor[new]
            yield pa.RecordBatch.from_arrays(
                [as_long(anchor), pa.array(ints(b.column("k_id"))[doc]), pa.array(ints(b.column("k_text"))[doc])], ["anchor", "k_id", "k_text"]
            )

    return run


def _emit_windows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "k_body"):
            w = Words(Texts(b.column("k_body")))
            at, anchor = _window_anchors(w, width)
            shared = np.unique(np.asarray(pa.compute.list_flatten(b.column("anchors")), dtype=np.int64))
            at = at[np.isin(anchor.view(np.int64), shared)]
            doc = np.searchsorted(w.bounds, at, side="right") - 1
            other = (rolling(mix(w.code ^ U64(0x2545F4914F6CDD1D)), width)[at] >> U64(32)).astype(np.uint32).view(np.int32)
            yield pa.RecordBatch.from_arrays(
                [as_long(rolling(w.code, width)[at]), pa.array(other), pa.array(ints(b.column("k_id"))[doc]), pa.array(ints(b.column("k_text"))[doc]), pa.array((at - w.bounds[doc]).astype(np.int32))],
                ["window", "other", "k_id", "k_text", "start"],
            )

    return run


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, sent: int = 0) -> DataFrame:
    """(k_id, k_text, starts): word positions of the windows that start in a smaller document.

    Lists of up to ``sent`` rows and elements go to every task instead of joining by a shuffle
    of the texts; that suits a corpus already without near duplicates.
    """
    keyed = _keyed(docs, id_col, text_col)
    anchors = written(keyed.mapInArrow(_emit_anchors(width), "anchor long, k_id long, k_text long"), "anchors")
    shared = anchors.groupBy("anchor").agg(F.min("k_id").alias("lo"), F.max("k_id").alias("hi")).where("lo < hi").select("anchor")
    by_doc = written(anchors.join(shared, "anchor").groupBy("k_id", "k_text").agg(F.collect_set("anchor").alias("anchors")), "shared-anchors")
    done_with(anchors)
    windows = written(
        keyed.join(few(by_doc, "anchors", sent), ["k_id", "k_text"]).mapInArrow(_emit_windows(width), "window long, other int, k_id long, k_text long, start int"), "windows"
    )
    done_with(by_doc)
    first = windows.groupBy("window", "other").agg(F.min("k_id").alias("lo"), F.max("k_id").alias("hi")).where("lo < hi").select("window", "other", "lo")
    hits = windows.join(first, ["window", "other"]).where("k_id > lo")
    out = written(hits.groupBy("k_id", "k_text").agg(F.collect_set("start").alias("starts")), "repeats")
    done_with(windows)
    return out


def _spans(b: pa.RecordBatch, w: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal removal intervals over the slice's words, and the document of each."""
    col = b.column("starts")
    n = np.asarray(pa.compute.list_value_length(col).fill_null(0), dtype=np.int64)
    doc = np.repeat(np.arange(b.num_rows), n)
    at = np.sort(np.asarray(pa.compute.list_flatten(col), dtype=np.int64) + w.bounds[doc]) if len(doc) else np.zeros(0, np.int64)
    a, z = merged_inside(at, at + width, w.bounds)
    return a, z, np.searchsorted(w.bounds, a, side="right") - 1


def merged_inside(start: np.ndarray, end: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``merged``, but runs that meet at a document's edge stay apart."""
    a, z = merged(start, end)
    if len(a):
        cut = bounds[1:-1]
        inner = cut[(np.searchsorted(a, cut, side="left") > 0)]
        run = np.searchsorted(a, inner, side="left") - 1
        inner = np.unique(inner[(inner > a[run]) & (inner < z[run])])
        a, z = np.sort(np.append(a, inner)), np.sort(np.append(z, inner))
    return a, z


def joined_words(t: Texts, w: Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kept words of every document joined by one space: bytes, and document offsets."""
    kept = np.flatnonzero(keep)
    doc = np.searchsorted(w.bounds, kept, side="right") - 1
    gap = np.zeros(len(kept), bool)
    gap[:-1] = doc[1:] == doc[:-1]
    delta = np.zeros(t.size + 1, np.int8)
    delta[w.start[kept]] += 1
    delta[w.end[kept]] -= 1
    mask = np.cumsum(delta[: t.size], dtype=np.int8).astype(bool)
    data = t.data[: t.size]
    space = w.end[kept][gap]
    data[space] = 0x20
    mask[space] = True
    off = np.zeros(t.size + 1, np.int64)
    np.cumsum(mask, out=off[1:])
    return data[mask], off[t.off]


def _digest(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "k_body"):
            t = Texts(b.column("k_body"))
            w = Words(t, codes=False)
            a, z, doc = _spans(b, w, width)
            delta = np.zeros(w.n + 1, np.int32)
            np.add.at(delta, a, 1)
            np.add.at(delta, z, -1)
            keep = np.cumsum(delta[: w.n]) == 0
            gone = np.bincount(doc, z - a, b.num_rows).astype(np.int64)
            data, off = joined_words(t, w, keep)
            raw = data.tobytes()
            sha = [hashlib.sha256(raw[off[i] : off[i + 1]]).hexdigest() for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(w.counts()), pa.array(gone), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def _cut(columns: list[str], width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "k_body"):
            t = Texts(b.column("k_body"))
            w = Words(t, codes=False)
            a, z, doc = _spans(b, w, width)
            # a removed run takes the white space up to the next word of its document
            upto = np.where(z < w.bounds[doc + 1], w.start[np.minimum(z, max(w.n - 1, 0))] if w.n else 0, t.off[doc + 1])
            delta = np.zeros(t.size + 1, np.int32)
            np.add.at(delta, w.start[a], 1)
            np.add.at(delta, upto, -1)
            mask = np.cumsum(delta[: t.size]) == 0
            off = np.zeros(t.size + 1, np.int64)
            np.cumsum(mask, out=off[1:])
            raw, off = t.data[: t.size][mask].tobytes(), off[t.off]
            null = np.asarray(b.column("k_body").is_null())
            text = [None if null[i] else raw[off[i] : off[i + 1]].decode("utf-8") for i in range(b.num_rows)]
            spans = lists(np.column_stack([a - w.bounds[doc], z - w.bounds[doc]]).ravel(), 2 * np.bincount(doc, minlength=b.num_rows))
            yield pa.RecordBatch.from_arrays([*[b.column(f"c_{i}") for i in range(len(columns))], pa.array(text, pa.string()), spans], [*[f"c_{i}" for i in range(len(columns))], "k_out", "k_spans"])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, spans_col: str | None = None, sent: int = 0) -> DataFrame:
    """``docs`` with repeated passages cut out of the text.

    With ``spans_col``, that column holds the removed word intervals as a flat list
    (start, end, start, end, ...).
    """
    names = docs.columns
    hits = repeated_windows(docs, id_col, text_col, width, sent)
    inner = docs.toDF(*[f"c_{i}" for i in range(len(names))])
    at, body = f"c_{names.index(id_col)}", f"c_{names.index(text_col)}"
    all_cols = _keyed(inner, at, body, *inner.columns).join(few(hits, "starts", sent), ["k_id", "k_text"], "left").drop("k_id", "k_text")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in inner.schema) + ", k_out string, k_spans array<long>"
    out = all_cols.mapInArrow(_cut(names, width), schema)
    cols = [F.col("k_out" if f"c_{i}" == body else f"c_{i}").alias(c) for i, c in enumerate(names)]
    return out.select(*cols, *([F.col("k_spans").alias(spans_col)] if spans_col else []))


def substring_digest(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 (kept words joined by a space)."""
    hits = repeated_windows(docs, "doc_id", "text", width)
    keyed = _keyed(docs.select("doc_id", "text", F.col("doc_id").cast("long").alias("doc")), "doc_id", "text", "doc")
    return keyed.join(hits, ["k_id", "k_text"], "left").select("doc", "k_body", "starts").mapInArrow(
        _digest(width), "doc_id long, n_words long, n_removed long, kept_sha256 string"
    )
