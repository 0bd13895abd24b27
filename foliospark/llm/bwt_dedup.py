"""Suffix-array dedup: repeated byte strings found by merging shard BWTs.

Every byte covered by a string of ``length`` bytes that also starts anywhere else (the
same document included) is removed; matches never cross documents.

The suffix order is only needed as deep as ``length``. A Burrows-Wheeler transform over
an alphabet of STEP-byte symbols (every position starts one; STEP divides the length) is
built for shards of a string collection; shards are merged by iterative interleave
refinement: one pass over the transforms deepens the interleave by one symbol, keeping
block boundaries, so ``length / STEP`` passes give, without sorting suffixes again, the
intervals with a common prefix of at least ``length`` bytes. An interval that holds two
or more positions is a repeat.

What goes into the transforms is narrowed without loss. (1) A window of ``length`` bytes
has a smallest fingerprint of its half-length substrings; if that is nowhere else, the
window is unique. (2) Other windows are collected into contexts: runs of windows with
the same smallest fingerprint. Equal contexts are one string with a
count, summed before the shuffle, so groups of copies of any size cost one string.
(3) Only contexts with the same fingerprint can share windows, so the strings are dealt by
it over tasks that build, merge and read off the transforms; a context that is alone with
its fingerprint, has a count of one and none of its fingerprints twice is left out. Groups
of more than GROUP strings (a passage a little shorter than ``length`` with ever other
surroundings) are cut into strings of one window each and dealt by these, so that no
group binds a task. Every removed span is read off a merged transform, which also says
it of strings with a count above one.

Defined cases: null text is empty; rows that repeat an id (or have none) are documents
of their own, so that repeated rows remove each other's bytes; texts shorter than
``length`` lose nothing; an empty table gives an empty result. Symbols are told apart by 64-bit
fingerprints within one merge, contexts by 64 bits within their group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.kernels import U64, Texts, as_long, ints, mix, powers, rolling, run_starts, slices, sliding_min, spread
from foliospark.llm.shared import done_with, written
from foliospark.llm.substring import _keyed, merged_inside

LENGTH = 200
STEP = 50
#: Windows in one context, at most.
RUN = 128
#: Strings in a group that one task merges, at most; larger groups are cut further.
GROUP = 8192
#: Bytes of contexts whose transforms are merged at once, and of one shard among them.
AT_ONCE, SHARD = 1 << 16, 1 << 14
#: Bytes of contexts that a task merges, about.
TASK = 4 << 20
_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))


def sliding_max(x: np.ndarray, width: int) -> np.ndarray:
    return ~sliding_min(~x, width)


def chosen(prints: np.ndarray, least: np.ndarray, ok: np.ndarray, width: int) -> np.ndarray:
    """Positions whose fingerprint is the smallest of some window that is ``ok``."""
    n = len(prints)
    padded = np.zeros(n + width - 1, U64)  # windows i - width + 1 .. i cover position i
    padded[width - 1 : width - 1 + len(least)] = np.where(ok, least, U64(0))
    return np.flatnonzero((sliding_max(padded, width)[:n] == prints) & (prints > 0))


def _windows(t: Texts, length: int, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints of ``part`` bytes, the smallest in each window, windows inside documents."""
    prints = rolling(_BYTE[t.data[: t.size]], part)
    return prints, sliding_min(prints, length - part + 1), run_starts(t.off, length, t.size)


def _emit_anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "k_body"):
            t = Texts(b.column("k_body"))
            if t.size < length:
                continue
            prints, least, ok = _windows(t, length, length // 2)
            at = chosen(prints, least, ok, length - length // 2 + 1)
            doc = np.searchsorted(t.off, at, side="right") - 1
            yield pa.RecordBatch.from_arrays([as_long(prints[at]), pa.array(ints(b.column("k_id"))[doc]), pa.array(ints(b.column("k_text"))[doc])], ["anchor", "k_id", "k_text"])

    return run


def _emit_contexts(length: int, single: bool = False):
    """Contexts of the windows that may repeat; with ``single`` only those of the groups in
    ``cut``, one for each window, in groups of their own."""
    part = length // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "k_body"):
            t = Texts(b.column("k_body"))
            if t.size < length:
                continue
            shared = np.unique(np.asarray(pa.compute.list_flatten(b.column("anchors")), dtype=np.int64))
            prints, least, ok = _windows(t, length, part)
            ok &= np.isin(least.view(np.int64), shared)
            if single:
                ok &= np.isin(least.view(np.int64), np.unique(np.asarray(pa.compute.list_flatten(b.column("cut")), dtype=np.int64)))
            at = np.flatnonzero(ok)
            if not len(at):
                continue
            value = least[at]
            run = 1 if single else RUN
            new = np.ones(len(at), bool)
            new[1:] = (value[1:] != value[:-1]) | (at[1:] != at[:-1] + 1) | np.isin(at[1:], t.off)
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, len(at)))
            more = -(-size // run)  # long runs (periodic text) are cut
            k = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
            start = np.repeat(at[first], more) + k * run
            size = np.minimum(np.repeat(size, more) - k * run, run)
            group = np.repeat(value[first], more)
            # equal fingerprints close by: the context may repeat a string inside itself
            sel = chosen(prints, least, ok, length - part + 1)
            order = np.lexsort((sel, prints[sel]))
            near = (prints[sel][order][1:] == prints[sel][order][:-1]) & (np.diff(sel[order]) <= RUN + length)
            twin = np.zeros(len(prints) + 1, np.int32)
            twin[sel[order[1:][near]]] = 1
            twin[sel[order[:-1][near]]] = 1
            seen = np.concatenate([[0], np.cumsum(twin)])
            inside = seen[np.minimum(start + size + length - part, len(seen) - 1)] > seen[start]
            total = np.zeros(t.size + 1, U64)
            np.cumsum(_BYTE[t.data[: t.size]] * powers(t.size), out=total[1:])
            stop = start + size - 1 + length
            text = mix((total[stop] - total[start]) * powers(t.size, inverse=True)[start] + size.astype(U64))
            if single:
                group = mix(text ^ group)
            doc = np.searchsorted(t.off, start, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [
                    as_long(group), as_long(text), pa.array(size.astype(np.int32)), pa.array(inside), pa.array(ints(b.column("k_id"))[doc]), pa.array(ints(b.column("k_text"))[doc]),
                    pa.array(start - t.off[doc]),
                ],
                ["g", "context", "windows", "twin", "k_id", "k_text", "start"],
            )

    return run


_CONTEXT = "g long, context long, windows int, twin boolean, k_id long, k_text long, start long"


_DONE = ["g", "context", "windows", "copies", "start", "k_id", "k_text", "first", "run"]
_RUNS = "g long, context long, windows int, copies long, start long, k_id long, k_text long, first long, run int"


def hit_runs(hit: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of hits as (which stretch, start in it, length); stretches begin at ``first``."""
    edge = np.zeros(len(hit) + 1, bool)
    edge[first] = True
    before = np.concatenate([[False], hit[:-1]])
    after = np.concatenate([hit[1:], [False]])
    a = np.flatnonzero(hit & (~before | edge[:-1]))
    z = np.flatnonzero(hit & (~after | edge[1:])) + 1
    which = np.searchsorted(first, a, side="right") - 1
    return which, a - first[which], z - a


def _emit_strings(length: int):
    """Contexts as strings for the merge. Contexts that are alone with their fingerprint
    share windows with no other: those that follow each other in a text are one string,
    whose transform is built here, and go on with the runs read off it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "k_body"):
            t = Texts(b.column("k_body"))
            col = b.column("places")
            x = pa.compute.list_flatten(col)
            doc = np.repeat(np.arange(b.num_rows), np.asarray(pa.compute.list_value_length(col), dtype=np.int64))
            at = np.asarray(x.field("start"), dtype=np.int64) + t.off[doc]
            order = np.argsort(at, kind="stable")
            x, doc, at = x.take(pa.array(order)), doc[order], at[order]
            windows, copies = (np.asarray(x.field(c), dtype=np.int64) for c in ("windows", "copies"))
            solo = np.asarray(x.field("solo"))
            raw = t.data.tobytes()
            end = at + windows - 1 + length
            cols = lambda which: [*(x.field(c).take(which) for c in _DONE[:5]), *(b.column(c).take(pa.array(doc).take(which)) for c in ("k_id", "k_text"))]  # noqa: E731, B023
            rest = np.flatnonzero(~solo)
            none = lambda kind: pa.nulls(len(rest), kind)  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([*cols(pa.array(rest)), none(pa.int64()), none(pa.int32()), pa.array([raw[i:j] for i, j in zip(at[rest], end[rest], strict=True)], pa.binary())], [*_DONE, "string"])
            own = np.flatnonzero(solo)
            if not len(own):
                continue
            part = np.cumsum(windows[own]) // AT_ONCE
            new = np.ones(len(own), bool)
            new[1:] = (doc[own][1:] != doc[own][:-1]) | (at[own][1:] != (at + windows)[own][:-1]) | (part[1:] != part[:-1])
            head = np.flatnonzero(new)
            tail = np.append(head[1:], len(own)) - 1
            sizes = end[own[tail]] - at[own[head]]
            turn = np.cumsum(sizes) // AT_ONCE
            for k in np.unique(turn):
                mine = np.flatnonzero(turn == k)
                lo, hi = head[mine[0]], tail[mine[-1]] + 1
                c = own[lo:hi]
                strings = [raw[i:j] for i, j in zip(at[own[head[mine]]], end[own[tail[mine]]], strict=True)]
                base = np.concatenate([[0], np.cumsum(sizes[mine])])
                # where each context begins, and how often its windows occur
                shift = base[:-1] - at[own[head[mine]]]
                first = at[c] + np.repeat(shift, tail[mine] - head[mine] + 1)
                weight = np.zeros(base[-1], np.int64)
                weight[spread(first, windows[c])] = np.repeat(copies[c], windows[c])
                which, start, n = hit_runs(repeated_places(strings, weight, length), first)
                yield pa.RecordBatch.from_arrays([*cols(pa.array(c[which])), pa.array(start), pa.array(n.astype(np.int32)), pa.nulls(len(n), pa.binary())], [*_DONE, "string"])

    return run


_STRING = _RUNS + ", string binary"


def stable_order(c: np.ndarray) -> np.ndarray:
    """Stable order of symbol numbers, by radix passes of 16 bits."""
    order = np.argsort((c & 0xFFFF).astype(np.uint16), kind="stable")
    if len(c) and c.max() > 0xFFFF:
        order = order[np.argsort((c[order] >> 16).astype(np.uint16), kind="stable")]
    return order


class Bwt:
    """A shard's transform: the symbol before each suffix, suffixes in order, their places.

    Suffixes are ordered by ``depth`` symbols. Symbol 0 stands before the first symbol
    of a string and marks its end.
    """

    def __init__(self, symbols: np.ndarray, places: np.ndarray):
        self.symbols, self.places = symbols, places
        #: last-to-first: where the suffix that starts one symbol earlier stands
        self.first = np.empty(len(symbols), np.int32)
        self.first[stable_order(symbols)] = np.arange(len(symbols), dtype=np.int32)


def shard_bwt(symbol: np.ndarray, before: np.ndarray, place: np.ndarray, depth: int) -> Bwt:
    """The transform of one shard.

    ``symbol[e]`` is the symbol with which suffix e starts (0: the end of a string),
    ``before[e]`` the suffix one symbol earlier (cyclic through the string's end).
    """
    order = np.arange(len(symbol), dtype=np.int32)
    for _ in range(depth):
        prior = before[order]
        order = prior[stable_order(symbol[prior])]
    return Bwt(symbol[before[order]], place[order])


def interleave(shards: list[Bwt], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge transforms: (places in the merged order, common prefix with the entry before).

    Each pass reads all transforms in the present interleave and deals their entries,
    stably, by symbol; entries that a pass tells apart get the pass's depth as the
    length of their common prefix (in symbols, at most ``depth``).
    """
    base = np.cumsum([0, *(len(s.symbols) for s in shards)]).astype(np.int32)
    symbols = np.concatenate([s.symbols for s in shards])
    first = np.concatenate([s.first + b for s, b in zip(shards, base, strict=False)])
    places = np.concatenate([s.places for s in shards])
    order, block = np.arange(len(symbols), dtype=np.int32), np.zeros(len(symbols), np.int32)
    common = np.full(len(symbols), depth, np.int32)
    for h in range(depth):
        c = symbols[order]
        dealt = stable_order(c)
        cut = np.ones(len(c), bool)
        cut[1:] = (c[dealt][1:] != c[dealt][:-1]) | (block[dealt][1:] != block[dealt][:-1])
        order = first[order[dealt]]
        common[cut & (common == depth)] = h  # blocks are only ever split where they are
        block = np.cumsum(cut, dtype=np.int32)
    return places[order], common


def repeated_places(strings: list[bytes], weight: np.ndarray, length: int, step: int = STEP, shard: int = SHARD) -> np.ndarray:
    """Over all strings end to end, the starts of ``length``-byte substrings whose places
    weigh two or more together; ``weight`` says of each place how often it occurs."""
    sizes = np.array([len(s) for s in strings], np.int64)
    data = np.frombuffer(b"".join(strings), np.uint8)
    off = np.concatenate([[0], np.cumsum(sizes)])
    owner = np.repeat(np.arange(len(strings)), sizes)
    local = np.arange(len(data)) - off[owner]
    prints = np.zeros(len(data), U64)
    prints[: max(len(data) - step + 1, 0)] = rolling(_BYTE[data], step)
    whole = local <= sizes[owner] - step  # a symbol starts here; elsewhere is an end
    _, number = np.unique(np.where(whole, prints, U64(0)), return_inverse=True)
    number = np.where(whole, number + 1, 0).astype(np.int32)
    depth = length // step
    before = _cyclic(owner, local, sizes, off, step)
    shards, a = [], 0
    while a < len(strings):
        z = max(a + 1, int(np.searchsorted(off, off[a] + shard, side="right")) - 1)
        lo, hi = off[a], off[z]
        shards.append(shard_bwt(number[lo:hi], before[lo:hi] - np.int32(lo), np.arange(lo, hi, dtype=np.int32), depth))
        a = z
    places, common = interleave(shards, depth)
    block = np.cumsum(common < depth) - 1
    starts = local[places] <= sizes[owner[places]] - length
    total = np.bincount(block[starts], weight[places[starts]], block[-1] + 1 if len(block) else 0)
    hit = np.zeros(len(data), bool)
    hit[places[starts & (total[block] >= 2)]] = True
    return hit


def _cyclic(owner: np.ndarray, local: np.ndarray, sizes: np.ndarray, off: np.ndarray, step: int) -> np.ndarray:
    """The suffix one symbol earlier, as a permutation.

    A string has ``step`` phases; phase p holds the positions p, p + step, ... The last
    of them starts no whole symbol and serves as the end of the phase's string, after
    which its first suffix follows.
    """
    phase = local % step
    last = off[owner] + phase + step * ((sizes[owner] - 1 - phase) // step)
    return np.where(local < step, last, np.arange(len(local)) - step).astype(np.int32)


def _merge(length: int):
    """Merge the transforms of whole groups, about AT_ONCE bytes of strings at a time."""

    def merge(t: pa.Table) -> pa.RecordBatch:
        strings = t.column("string").to_pylist()
        sizes = np.array([len(x) for x in strings], np.int64)
        weight = np.repeat(np.asarray(t.column("copies"), dtype=np.int64), sizes)
        which, first, n = hit_runs(repeated_places(strings, weight, length), np.cumsum(sizes) - sizes)
        cols = t.select(_DONE[:7]).take(pa.array(which)).combine_chunks()
        return pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in cols.columns), pa.array(first), pa.array(n.astype(np.int32))], _DONE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            done = b.column("string").is_null()
            yield b.filter(done).select(_DONE)
            b = pa.Table.from_batches([b.filter(pa.compute.invert(done))])
            held = b if held is None else pa.concat_tables([held, b]).combine_chunks()
            g = ints(held.column("g").combine_chunks())
            size = np.cumsum(np.asarray(pa.compute.binary_length(held.column("string")), dtype=np.int64))
            ends = np.flatnonzero(g[1:] != g[:-1]) + 1  # the last group may go on in the next batch
            at = 0
            for to in ends.tolist():
                if size[to - 1] - (size[at - 1] if at else 0) >= AT_ONCE:
                    yield merge(held.slice(at, to - at))
                    at = to
            held = held.slice(at)
        if held is not None and held.num_rows:
            yield merge(held)

    return run


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(k_id, k_text, places): runs (start, windows) of byte windows that occur elsewhere."""
    if length % STEP or length < 2 * STEP:
        raise ValueError(f"the length must be a multiple of {STEP}")
    spark = docs.sparkSession
    keyed = _keyed(docs, id_col, text_col)
    anchors = written(keyed.mapInArrow(_emit_anchors(length), "anchor long, k_id long, k_text long"), "anchors")
    shared = anchors.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    by_doc = written(anchors.join(shared, "anchor").groupBy("k_id", "k_text").agg(F.collect_set("anchor").alias("anchors")), "shared-anchors")
    done_with(anchors)
    contexts = written(keyed.join(by_doc, ["k_id", "k_text"]).mapInArrow(_emit_contexts(length), _CONTEXT), "contexts")
    same = ["g", "context", "windows"]
    large = written(contexts.select(*same).distinct().groupBy("g").count().where(F.col("count") > GROUP).select("g"), "large-groups")
    if not large.isEmpty():
        per = contexts.join(large, "g").groupBy("k_id", "k_text").agg(F.collect_set("g").alias("cut"))
        single = keyed.join(by_doc, ["k_id", "k_text"]).join(per, ["k_id", "k_text"]).mapInArrow(_emit_contexts(length, True), _CONTEXT)
        whole, contexts = contexts, written(contexts.join(large, "g", "left_anti").unionByName(single), "contexts")
        done_with(whole)
    done_with(by_doc, large)
    distinct = contexts.groupBy(*same).agg(F.count("*").alias("copies"), F.min(F.struct("k_id", "k_text", "start")).alias("p"), F.max("twin").alias("twin"))
    distinct = written(distinct, "distinct-contexts")
    # a string that is alone with its fingerprint and has one place holds nothing twice
    open_ = written(distinct.groupBy("g").agg(F.count("*").alias("n"), F.max("copies").alias("most"), F.max("twin").alias("twin")).where("n > 1 or most > 1 or twin").select("g", "n"), "open")
    solo = (F.col("n") == 1) & (F.col("copies") > 1)
    places = distinct.join(open_, "g").select("p.k_id", "p.k_text", F.struct("g", "context", "windows", "copies", F.col("p.start").alias("start"), solo.alias("solo")).alias("x"))
    per_doc = written(places.groupBy("k_id", "k_text").agg(F.collect_list("x").alias("places")), "open-places")
    size = per_doc.select(F.explode("places").alias("x")).where("not x.solo").agg(F.sum(F.col("x.windows") + length)).head()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, int(size // TASK) + 1)
    once = keyed.join(per_doc, ["k_id", "k_text"]).dropDuplicates(["k_id", "k_text"])
    strings = once.mapInArrow(_emit_strings(length), _STRING).repartition(parts, "g").sortWithinPartitions("g")
    found = written(strings.mapInArrow(_merge(length), _RUNS), "repeated")
    here = found.where("copies = 1").select("k_id", "k_text", (F.col("start") + F.col("first")).alias("start"), F.col("run").alias("windows"))
    # what the transform says of a string holds at all its places
    everywhere = found.where("copies > 1").select(*same, "first", "run")
    every = contexts.join(everywhere, same).select("k_id", "k_text", (F.col("start") + F.col("first")).alias("start"), F.col("run").alias("windows")).unionByName(here)
    out = written(every.groupBy("k_id", "k_text").agg(F.collect_set(F.struct("start", "windows")).alias("places")), "repeats")
    done_with(contexts, distinct, open_, per_doc, found)
    return out


def _spans(b: pa.RecordBatch, t: Texts, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    col = b.column("places")
    n = np.asarray(pa.compute.list_value_length(col).fill_null(0), dtype=np.int64)
    x = pa.compute.list_flatten(col)
    doc = np.repeat(np.arange(b.num_rows), n)
    start = np.asarray(x.field("start"), dtype=np.int64) + t.off[doc]
    end = start + np.asarray(x.field("windows"), dtype=np.int64) - 1 + length
    order = np.argsort(start)
    a, z = merged_inside(start[order], end[order], t.off)
    return a, z, np.searchsorted(t.off, a, side="right") - 1


def _cut(t: Texts, a: np.ndarray, z: np.ndarray) -> tuple[bytes, np.ndarray]:
    delta = np.zeros(t.size + 1, np.int32)
    np.add.at(delta, a, 1)
    np.add.at(delta, z, -1)
    keep = np.cumsum(delta[: t.size]) == 0
    off = np.zeros(t.size + 1, np.int64)
    np.cumsum(keep, out=off[1:])
    return t.data[: t.size][keep].tobytes(), off[t.off]


def _digest(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "k_body"):
            t = Texts(b.column("k_body"))
            a, z, doc = _spans(b, t, length)
            raw, off = _cut(t, a, z)
            sha = [hashlib.sha256(raw[off[i] : off[i + 1]]).hexdigest() for i in range(b.num_rows)]
            gone = np.bincount(doc, z - a, b.num_rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(np.diff(t.off)), pa.array(gone), pa.array(np.bincount(doc, minlength=b.num_rows)), pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def _keep(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "k_body"):
            t = Texts(b.column("k_body"))
            a, z, doc = _spans(b, t, length)
            raw, off = _cut(t, a, z)
            spans: list[list[dict]] = [[] for _ in range(b.num_rows)]
            for d, x, y in zip(doc.tolist(), (a - t.off[doc]).tolist(), (z - t.off[doc]).tolist(), strict=True):
                spans[d].append({"start": x, "end": y})
            kept = [raw[off[i] : off[i + 1]] for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(kept, pa.binary()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], ["doc_id", "kept", "spans"])

    return run


def _joined(docs: DataFrame, length: int) -> DataFrame:
    hits = repeats(docs, "doc_id", "text", length)
    keyed = _keyed(docs.select("doc_id", "text", F.col("doc_id").cast("long").alias("doc")), "doc_id", "text", "doc")
    return keyed.join(hits, ["k_id", "k_text"], "left").select("doc", "k_body", "places")


def kept_bytes(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, the bytes that stay, and the removed byte spans of every document."""
    return _joined(docs, length).mapInArrow(_keep(length), "doc_id long, kept binary, spans array<struct<start:long,end:long>>")


def bwt_digest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    return _joined(docs, length).mapInArrow(_digest(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
