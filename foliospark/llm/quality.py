"""Quality rules: cross-document line frequency within hosts, and per-text base rules.

Lines are normalised (A-Z lower-cased, white space collapsed) and hashed together with
their host. For each, Spark counts the distinct documents (by id; every row without one is
its own) of that host that have it. Lines in more than ``max(least, share * documents of
the host)`` documents are removed, and documents of which too little is left are rejected.
With ``copies_once`` documents with the same whole text count once, so that copies alone
make no line frequent; the pipeline, which looks for copies later, wants that.

The table of removed lines has at most ``lines per document / share`` entries for each
host. Where it is small (BROADCAST entries, checked) it goes to every task; beyond that
it is joined to the lines by their hash instead.

Defined cases: null text has no words and fails the base rules; a null host is a host of
its own; repeated rows are judged alike; an empty table gives an empty result; further
columns are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.kernels import U64, Texts, Words, ints, lists, mix, powers, rolling, run_starts, slices, span_codes
from foliospark.llm.ngram_join import by_document
from foliospark.llm.shared import written

BROADCAST = 500_000
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Limits:
    """A line is removed above ``least`` documents and ``share`` of its host's; a document
    is rejected below ``words_left`` words or ``part_left`` of its words. ``copies_once``
    counts distinct texts instead of distinct documents."""

    least: int = 10
    share: float = 0.05
    words_left: int = 50
    part_left: float = 0.3
    copies_once: bool = False


def _lines(t: Texts, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Byte spans of the ``\\n``-split lines that hold a word, and their word ranges."""
    data = t.data[: t.size]
    stop = np.flatnonzero(data == 10)
    start = np.unique(np.concatenate([stop + 1, t.off[:-1]]))
    start = start[start < t.size]
    end = np.minimum(np.append(stop, t.size)[np.searchsorted(stop, start)], t.off[np.searchsorted(t.off, start, side="right")]) if t.size else start
    a, z = np.searchsorted(w.start, start), np.searchsorted(w.start, end)
    keep = z > a
    return start[keep], end[keep], a[keep], z[keep]


def line_keys(t: Texts, w: Words, a: np.ndarray, z: np.ndarray, host: np.ndarray) -> np.ndarray:
    """Host-specific hash of each normalised line; ``w`` holds lower-cased codes."""
    total = np.zeros(w.n + 1, U64)
    if w.n:
        np.cumsum(w.code * powers(w.n), out=total[1:])
        doc = np.searchsorted(w.bounds, a, side="right") - 1
        return mix(mix((total[z] - total[a]) * powers(w.n, inverse=True)[a] + (z - a).astype(U64)) ^ host.view(U64)[doc])
    return np.zeros(0, U64)


def _profile():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "k_body"):
            n = b.num_rows
            t = Texts(b.column("k_body"))
            w = Words(t)
            data = t.data[: t.size]
            sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[t.off])
            in_word = np.zeros(t.size + 1, np.int8)
            in_word[w.start] += 1
            in_word[w.end] -= 1
            lead = (data & 0xC0) != 0x80
            chars = sums(np.cumsum(in_word[: t.size], dtype=np.int8).astype(bool) & lead)
            symbols = sums(_SYMBOL[data])
            start, end, a, z = _lines(t, w)
            doc = np.searchsorted(w.bounds, a, side="right") - 1
            raw, owner = by_document(span_codes(t.data, start, end), doc, n)
            same = (raw[1:] == raw[:-1]) & (owner[1:] == owner[:-1])
            dup_lines = np.bincount(owner[1:][same], minlength=n)
            at = np.flatnonzero(run_starts(w.bounds, 3, w.n))
            gram, of = rolling(w.code, 3)[at], np.searchsorted(w.bounds, at, side="right") - 1
            order = np.argsort(gram)
            order = order[np.argsort(of[order].astype(np.uint16) if n < 1 << 16 else of[order], kind="stable")]
            twin = (gram[order][1:] == gram[order][:-1]) & (of[order][1:] == of[order][:-1])
            twice = np.zeros(len(at), bool)
            twice[order[1:][twin]] = True
            twice[order[:-1][twin]] = True
            cover = np.zeros(w.n + 3, bool)
            for k in range(3):
                cover[at[twice] + k] = True
            repeat = np.diff(np.concatenate([[0], np.cumsum(cover[: w.n], dtype=np.int64)])[w.bounds])
            low = Words(t, lower=True)
            keys = line_keys(t, low, a, z, ints(b.column("k_host")))
            per = np.bincount(doc, minlength=n)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"), b.column("k_text"), b.column("k_host"), pa.array(w.counts()), pa.array(chars), pa.array(symbols), pa.array(dup_lines.astype(np.int64)),
                    pa.array(repeat), lists(keys.view(np.int64), per), lists((z - a).astype(np.int32), per, pa.int32()),
                ],
                ["doc_id", "k_text", "k_host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines", "line_words"],
            )

    return run


_PROFILE = (
    "doc_id long, k_text long, k_host long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, lines array<long>, line_words array<int>"
)


def _keyed(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.xxhash64(text_col), F.lit(0)).alias("k_text"), F.xxhash64(F.col(host_col).cast("string")).alias("k_host"), F.col(text_col).alias("k_body")
    )


def frequent_lines(profile: DataFrame, limits: Limits) -> DataFrame:
    """(line, n_docs): the lines above their host's limit."""
    one = F.col("k_text") if limits.copies_once else F.col("k_doc")
    hosts = profile.groupBy("k_host").agg(F.countDistinct(one).alias("host_docs"))
    seen = profile.select("k_host", one.alias("one"), F.explode(F.array_distinct("lines")).alias("line"))
    each = seen.groupBy("line").agg(F.countDistinct("one").alias("n_docs"), F.min("k_host").alias("k_host")).where(F.col("n_docs") > limits.least)
    return written(each.join(hosts, "k_host").where(F.col("n_docs") > F.lit(limits.share) * F.col("host_docs")).select("line", "n_docs"), "frequent-lines")


class Rules:
    """The rules fitted to a corpus: its profile and its frequent lines."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", limits: Limits | None = None):
        self.limits, self.docs, self.cols = limits or Limits(), docs, (id_col, text_col, host_col)
        # rows without an id get one below all that they could share with another
        alone = F.when(F.col("doc_id").isNull(), -1 - F.monotonically_increasing_id())
        found = _keyed(docs, *self.cols).mapInArrow(_profile(), _PROFILE)
        self.profile = written(found.withColumn("k_doc", F.struct(F.coalesce("doc_id", alone).alias("id"), F.col("doc_id").isNull().alias("none"))), "profile")
        self.lines = frequent_lines(self.profile, self.limits)
        self.small = self.lines.count() <= BROADCAST

    def verdicts(self) -> DataFrame:
        """Per document the base figures, words that removed lines held, and the verdict."""
        each = self.profile.select("k_host", "k_text", F.explode(F.arrays_zip("lines", "line_words")).alias("x")).select("k_host", "k_text", F.col("x.lines").alias("line"), F.col("x.line_words").alias("words"))
        lines = F.broadcast(self.lines) if self.small else self.lines
        # texts that repeat in a host carry their lines once for each row
        rows = self.profile.groupBy("k_host", "k_text").agg(F.count("*").alias("rows"))
        gone = each.join(lines.select("line"), "line").groupBy("k_host", "k_text").agg(F.sum("words").alias("words")).join(rows, ["k_host", "k_text"]).select("k_host", "k_text", (F.col("words") / F.col("rows")).cast("long").alias("n_removed_words"))
        lim = self.limits
        out = self.profile.drop("lines", "line_words", "k_doc").join(written(gone, "gone"), ["k_host", "k_text"], "left").withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0)))
        left = F.col("n_words") - F.col("n_removed_words")
        out = out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
        return out.withColumn("kept", ~F.col("base_failed") & (left >= lim.words_left) & (left >= F.lit(lim.part_left) * F.col("n_words")))

    def cleaned(self, length_col: str | None = "n_chars") -> DataFrame:
        """The documents that stay, without the removed lines; columns as they came."""
        id_col, text_col, host_col = self.cols
        names = self.docs.columns
        found = self.lines.select("line")
        known = None
        if self.small:
            known = np.sort(np.array([r[0] for r in found.collect()], np.int64))  # at most BROADCAST
        inner = self.docs.toDF(*[f"c_{i}" for i in range(len(names))])
        at = {c: f"c_{names.index(c)}" for c in (id_col, text_col, host_col)}
        full = inner.select("*", F.xxhash64(F.col(at[host_col]).cast("string")).alias("k_host"), F.coalesce(F.xxhash64(at[text_col]), F.lit(0)).alias("k_text"), F.col(at[text_col]).alias("k_body"))
        if not self.small:
            own = self.profile.select("k_host", "k_text", F.explode("lines").alias("line")).join(found, "line").groupBy("k_host", "k_text").agg(F.collect_set("line").alias("own"))
            full = full.join(own, ["k_host", "k_text"], "left")
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in inner.schema) + ", k_out string"
        out = full.drop("k_text").mapInArrow(_clean([f.name for f in inner.schema], known, self.limits), schema)
        cols = [F.col("k_out" if f"c_{i}" == at[text_col] else f"c_{i}").alias(c) for i, c in enumerate(names)]
        out = out.select(*cols)
        if length_col in names:
            kind = self.docs.schema[length_col].dataType
            out = out.withColumn(length_col, F.length(text_col).cast(kind))
        return out.select(*names)


def _clean(columns: list[str], known: np.ndarray | None, limits: Limits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profile = _profile()
        for b in slices(batches, "k_body"):
            base = next(profile(iter([b.append_column("doc_id", pa.nulls(b.num_rows, pa.int64())).append_column("k_text", pa.nulls(b.num_rows, pa.int64()))])), None)
            words, repeat = (np.asarray(base.column(c), dtype=np.int64) for c in ("n_words", "n_repeat_words"))
            t = Texts(b.column("k_body"))
            plain = t.data[: t.size].copy()
            low = Words(t, lower=True)
            start, end, a, z = _lines(t, low)
            keys = line_keys(t, low, a, z, ints(b.column("k_host"))).view(np.int64)
            bad = known if known is not None else np.unique(np.asarray(pa.compute.list_flatten(b.column("own")), dtype=np.int64))
            gone = np.isin(keys, bad)
            doc = np.searchsorted(low.bounds, a, side="right") - 1
            left = words - np.bincount(doc[gone], (z - a)[gone], b.num_rows).astype(np.int64)
            keep = ~((words < 50) | (100 * repeat > 50 * words)) & (left >= limits.words_left) & (left >= limits.part_left * words)
            delta = np.zeros(t.size + 1, np.int32)
            np.add.at(delta, start[gone], 1)
            # the line's own line break goes too, if the document has one there
            stop = end[gone] + (end[gone] < t.off[doc[gone] + 1])
            np.add.at(delta, stop, -1)
            mask = np.cumsum(delta[: t.size]) == 0
            off = np.zeros(t.size + 1, np.int64)
            np.cumsum(mask, out=off[1:])
            raw, off = plain[mask].tobytes(), off[t.off]
            rows = np.flatnonzero(keep)
            text = [raw[off[i] : off[i + 1]].decode("utf-8") for i in rows]
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays([*[b.column(c).take(at) for c in columns], pa.array(text, pa.string())], [*columns, "k_out"])

    return run


def quality_rules(docs: DataFrame, limits: Limits | None = None) -> DataFrame:
    """doc_id, the base figures, base_failed, kept and n_removed_words of every document."""
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words"]
    return Rules(docs, limits=limits).verdicts().select(*cols)
