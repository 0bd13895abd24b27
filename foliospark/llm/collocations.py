"""Phrase collocations: packed id n-grams, range partitioned, radix sorted, run lengths counted.

Per language, phrases of 2 to ``longest`` words inside pieces of text that occur at least
``least`` times are scored by their weakest cut, floor(1000 * a * n / (l * r)).

Plan. (1) Words are counted by language; counts are combined within slices of texts and
by Spark before the shuffle. (2) Words that occur ``least`` times get dense ids. The
commonest ``SENT`` of them go to every task; the rest, if there are more, are joined to
the documents that hold them. (3) Pieces are broken at all other words, since no phrase
over one can occur often enough. From each place where two frequent words follow each
other, the ids of up to ``longest`` words are packed into one binary key of fixed width;
the counts of all shorter phrases are those of its prefixes. (4) Keys are dealt out by
ranges (bounds from a sample of texts, which decide only how even the ranges are), equal
keys of a slice as one with a count. Ranges cut between whole keys, so neither a hot word
nor a hot pair lands in one of them. Each range is radix sorted, and the run lengths of
its prefixes are counted; prefixes that reach over the edge of a range are added up
after. (5) Everything else is joins and aggregations of the phrases found.

Defined cases: a null text is empty, a null language ``und``; repeated rows count each;
an empty table gives an empty result; further columns are not read. Words are told apart
by 64-bit codes of language and word: with D frequent ones among V, the chance that any
is taken for another is about V*D / 2**64. Scores are exact as long as 1000 * a * n has
no more than 38 digits; beyond, an error is raised.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.kernels import U64, Texts, mix, slices, span_codes
from foliospark.llm.shared import done_with, written

LONGEST, LEAST, SUBSUMED, TOP = 5, 100, 100, 2000
#: Bytes of text whose counts are combined in one go.
SLICE = 8 << 20
#: Words of the dictionary that are sent to every task (twelve bytes each).
SENT = 1 << 21
#: Keys that a range is meant to hold, and the most ranges there are.
RANGE, RANGES = 1 << 20, 1 << 16
#: Keys of the sample for each range.
SAMPLED = 32
#: Keys that a task holds at a time; more distinct ones in a range are counted in parts.
HELD = 1 << 21
#: Rows that one word's count is copied to, so that a hot word's phrases meet it in several tasks.
SALTS = 16
_BLANK, _BREAK = np.zeros(256, bool), np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_BLANK[[0x20, 0x09]] = True


class PieceWords:
    """Lower-cased words of a slice: byte spans, piece numbers, codes of language and word."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        t = self.texts = Texts(texts)
        data = t.data[: t.size]
        data[(data >= 65) & (data <= 90)] += 32
        stop = _BREAK[data]
        inside = np.zeros(t.size + 2, bool)
        inside[1:-1] = ~(stop | _BLANK[data])
        edge = np.zeros(t.size + 1, bool)
        edge[t.off] = True
        self.start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
        self.end = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
        self.n = len(self.start)
        self.doc = np.searchsorted(t.off, self.start, side="right") - 1
        self.piece = np.cumsum(stop)[self.start] + self.doc if self.n else np.zeros(0, np.int64)
        dictionary = langs.dictionary_encode()
        self.langs, kind = dictionary.dictionary, np.asarray(dictionary.indices, dtype=np.int64)
        of = Texts(self.langs)
        seed = mix(span_codes(of.data, of.off[:-1], of.off[1:]) ^ U64(0x5851F42D4C957F2D))
        self.lang = kind[self.doc]
        self.code = mix(span_codes(t.data, self.start, self.end) ^ seed[self.lang]) if self.n else np.zeros(0, U64)


def _emit_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, code, count) of a slice; a null word has the count of all words of the language."""
    for b in slices(batches, "text", SLICE):
        w = PieceWords(b.column("text"), b.column("lang"))
        code, at, count = np.unique(w.code, return_index=True, return_counts=True)
        raw = w.texts.data.tobytes()
        word = [raw[a:z] for a, z in zip(w.start[at].tolist(), w.end[at].tolist(), strict=True)]
        all_of = np.bincount(w.lang, minlength=len(w.langs))
        lang = pa.concat_arrays([w.langs.take(pa.array(w.lang[at])), w.langs]).cast(pa.string())
        yield pa.RecordBatch.from_arrays(
            [
                lang,
                pa.array(word + [None] * len(w.langs), pa.binary()).cast(pa.string()),
                pa.array(np.concatenate([code, np.zeros(len(w.langs), U64)]).view(np.int64)),
                pa.array(np.concatenate([count, all_of])),
            ],
            ["lang", "word", "code", "n"],
        )


class Lexicon:
    """Ids of frequent words by their code."""

    def __init__(self, code: np.ndarray, id_: np.ndarray):
        order = np.argsort(code)
        self.code, self.id = code[order], id_[order].astype(np.int32)

    def ids(self, code: np.ndarray) -> np.ndarray:
        """The id of each word, 0 where it has none."""
        if not len(self.code):
            return np.zeros(len(code), np.int32)
        at = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
        return np.where(self.code[at] == code, self.id[at], 0)


def packed(ids: np.ndarray, piece: np.ndarray, longest: int) -> np.ndarray:
    """Ids of up to ``longest`` words from every place with two frequent words in one piece, 0 after their end."""
    out = np.zeros((len(ids), longest), np.int32)
    out[:, 0] = ids
    for k in range(1, longest):
        on = (out[:-k, k - 1] > 0) & (piece[k:] == piece[:-k]) if k < len(ids) else np.zeros(0, bool)
        out[: len(on), k] = np.where(on, ids[k:], 0)
    return out[(out[:, 0] > 0) & (out[:, 1] > 0)]


def radix_sorted(keys: np.ndarray, count: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ids in order, equal ones as one: stable passes over 16-bit digits from the last on."""
    order = np.arange(len(keys))
    for col in range(keys.shape[1] - 1, -1, -1):
        for shift in range(0, max(top.bit_length(), 1), 16):
            digit = ((keys[order, col] >> shift) & 0xFFFF).astype(np.uint16)
            order = order[np.argsort(digit, kind="stable")]  # a radix sort for 16-bit digits
    keys, count = keys[order], count[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]).any(axis=1)
    at = np.flatnonzero(new)
    return keys[at], np.add.reduceat(count, at) if len(at) else count


def prefix_runs(keys: np.ndarray, count: np.ndarray, least: int, whole: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, count) of the runs of each prefix of two ids or more in sorted keys.

    A run in the middle of a whole range is all there is of it, so it goes if it is short.
    """
    new = np.zeros(len(keys), bool)
    if not len(keys):
        return
    new[0] = True
    for m in range(1, keys.shape[1] + 1):
        new[1:] |= keys[1:, m - 1] != keys[:-1, m - 1]
        if m == 1:
            continue
        at = np.flatnonzero(new)
        total = np.add.reduceat(count, at)
        keep = total >= least if whole else np.ones(len(at), bool)
        keep[[0, -1]] = True
        keep &= keys[at, m - 1] > 0
        if keep.any():
            yield keys[at[keep], :m], total[keep]


def bytes_of(ids: np.ndarray, width: int) -> np.ndarray:
    """Big-endian bytes of rows of ids."""
    wide = ids.astype(">u4").view(np.uint8).reshape(len(ids), ids.shape[1], 4)
    return np.ascontiguousarray(wide[:, :, 4 - width :]).reshape(len(ids), ids.shape[1] * width)


def ids_of(raw: np.ndarray, width: int, longest: int) -> np.ndarray:
    wide = np.zeros((len(raw) // (width * longest), longest, 4), np.uint8)
    wide[:, :, 4 - width :] = raw.reshape(-1, longest, width)
    return wide.reshape(-1).view(">u4").reshape(-1, longest).astype(np.int32)


def binaries(rows: np.ndarray) -> pa.Array:
    """A binary column of rows of equal width."""
    off = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(rows))])


def _slice_keys(b: pa.RecordBatch, sent, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """The packed keys of a slice, unsorted, and counts of one."""
    w = PieceWords(b.column("text"), b.column("lang"))
    ids = sent.value.ids(w.code)
    if "rest" in b.schema.names:
        rest = pa.compute.list_flatten(b.column("rest"))
        if len(rest):
            code, which = np.unique(np.asarray(rest.field("code"), dtype=np.int64).view(U64), return_index=True)
            ids = np.maximum(ids, Lexicon(code, np.asarray(rest.field("id"), dtype=np.int64)[which]).ids(w.code))
    keys = packed(ids, w.piece, longest)
    return keys, np.ones(len(keys), np.int64)


def _emit_unknown(sent):
    """Codes of the words of each slice that the sent dictionary lacks, with the texts that hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE):
            w = PieceWords(b.column("text"), b.column("lang"))
            new = np.flatnonzero(sent.value.ids(w.code) == 0)
            pair = np.unique(np.stack([w.doc[new].astype(U64), w.code[new]], axis=1), axis=0)
            row = np.asarray(b.column("row"), dtype=np.int64)[pair[:, 0].astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(np.ascontiguousarray(pair[:, 1]).view(np.int64))], ["row", "code"])

    return run


def _emit_sample(sent, width: int, longest: int, one_in: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE):
            keys, _ = _slice_keys(b, sent, longest)
            yield pa.RecordBatch.from_arrays([binaries(bytes_of(keys[one_in // 2 :: one_in], width))], ["key"])

    return run


def fixed(raw: np.ndarray) -> np.ndarray:
    """Rows of bytes as fixed-width strings, which compare as the keys do."""
    return np.ascontiguousarray(raw).view(f"S{raw.shape[1]}").ravel()


def _emit_keys(sent, bounds: np.ndarray, top: int, width: int, parts: int, longest: int):
    """(part, span, keys, counts): what a slice has of each range, sorted, end to end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE):
            keys, count = radix_sorted(*_slice_keys(b, sent, longest), top)
            raw, size = bytes_of(keys, width), width * longest
            edges = np.concatenate([[0], np.searchsorted(fixed(raw), bounds), [len(keys)]])
            span = np.flatnonzero(np.diff(edges))
            a, z = edges[span].tolist(), edges[span + 1].tolist()
            blob, counts, once = raw.tobytes(), count.astype("<u4").tobytes(), count == 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array((span * parts // (len(bounds) + 1)).astype(np.int32)),
                    pa.array(span.astype(np.int32)),
                    pa.array([blob[x * size : y * size] for x, y in zip(a, z, strict=True)], pa.binary()),
                    pa.array([b"" if once[x:y].all() else counts[x * 4 : y * 4] for x, y in zip(a, z, strict=True)], pa.binary()),
                ],
                ["part", "span", "keys", "counts"],
            )

    return run


def _count_runs(top: int, width: int, longest: int, least: int):
    """Run lengths of the prefixes of each range; rows of a range come one after the other."""

    def found(keys: list[np.ndarray], count: list[np.ndarray], whole: bool) -> Iterator[pa.RecordBatch]:
        for ids, total in prefix_runs(*radix_sorted(np.concatenate(keys), np.concatenate(count), top), least, whole):
            yield pa.RecordBatch.from_arrays([binaries(bytes_of(ids, 4)), pa.array(total)], ["key", "a"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        count: list[np.ndarray] = []
        held, at, whole = 0, None, True
        for b in batches:
            for span, k, n in zip(b.column("span").to_pylist(), b.column("keys"), b.column("counts"), strict=True):
                if span != at:
                    if keys:
                        yield from found(keys, count, whole)
                    keys, count, held, at, whole = [], [], 0, span, True
                ids = ids_of(np.frombuffer(k.as_buffer(), np.uint8), width, longest)
                some = np.frombuffer(n.as_buffer(), "<u4").astype(np.int64)
                keys.append(ids)
                count.append(some if len(some) else np.ones(len(ids), np.int64))
                held += len(ids)
                if held > HELD:
                    one = radix_sorted(np.concatenate(keys), np.concatenate(count), top)
                    keys, count, held = [one[0]], [one[1]], len(one[0])
                    if held > HELD // 2:
                        whole = False
                        yield from found(keys, count, whole)
                        keys, count, held = [], [], 0
        if keys:
            yield from found(keys, count, whole)

    return run


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, code, n): occurrences; a null word stands for all words of the language."""
    return docs.mapInArrow(_emit_counts, "lang string, word string, code long, n long").groupBy("lang", "word", "code").agg(F.sum("n").alias("n"))


def numbered(words: DataFrame) -> tuple[DataFrame, int]:
    """``words`` with dense ids from 1 on, the commoner words first (up to partitions), and how many there are."""
    spark = words.sparkSession
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    held = written(words.repartitionByRange(F.desc("n"), "lang", "word").select("*", F.spark_partition_id().alias("part"), row.alias("row")), "lexicon")
    sizes = sorted((r["part"], r["count"]) for r in held.groupBy("part").count().collect())  # a row a partition
    upto = np.cumsum([n for _, n in sizes], dtype=np.int64)
    before = spark.createDataFrame([(p, int(k) - n + 1) for (p, n), k in zip(sizes, upto, strict=True)], "part int, first long")
    out = held.join(F.broadcast(before), "part").withColumn("id", F.col("first") + F.col("row")).drop("part", "row", "first")
    return out, int(upto[-1]) if len(upto) else 0


def _bounds(docs: DataFrame, sent, width: int, longest: int, ranges: int, total: int) -> np.ndarray:
    """Keys that cut a sample of near SAMPLED keys a range into equal parts."""
    want = SAMPLED * ranges
    one_in = max(1, min(total // want, 8))
    some = docs.sample(min(1.0, one_in * want / max(total, 1)), seed=7)
    keys = some.mapInArrow(_emit_sample(sent, width, longest, one_in), "key binary").toArrow()["key"].combine_chunks()
    keys = np.frombuffer(b"".join(keys.to_pylist()), f"S{width * longest}")
    return np.unique(np.sort(keys)[np.arange(1, ranges) * len(keys) // ranges]) if len(keys) else keys


def phrase_counts(docs: DataFrame, lexicon: DataFrame, words: int, total: int, longest: int = LONGEST, least: int = LEAST, sent_most: int = SENT) -> DataFrame:
    """(key, a): phrases of two words or more that occur ``least`` times; the key is their ids, four bytes each.

    ``docs`` has the columns text and lang, ``lexicon`` code and id of ``words`` words;
    ``total`` is the number of all words, frequent or not.
    """
    spark = docs.sparkSession
    common = lexicon.where(F.col("id") <= sent_most).select("code", "id").toArrow()  # at most sent_most rows
    sent = spark.sparkContext.broadcast(Lexicon(np.asarray(common["code"], dtype=np.int64).view(U64), np.asarray(common["id"], dtype=np.int64)))
    rest = None
    if words > sent_most:
        keyed = docs.withColumn("row", F.xxhash64("lang", "text"))  # equal texts share a list; a clash only makes it longer
        rare = lexicon.where(F.col("id") > sent_most).select("code", "id")
        unknown = keyed.mapInArrow(_emit_unknown(sent), "row long, code long").distinct()
        rest = written(unknown.join(rare, "code").groupBy("row").agg(F.collect_list(F.struct("code", "id")).alias("rest")), "rest")
        docs = keyed.join(rest, "row", "left").select("text", "lang", "rest")
    width = (max(words, 1).bit_length() + 7) // 8
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = min(max(parts, math.ceil(total / RANGE)), RANGES)
    bounds = _bounds(docs, sent, width, longest, ranges, total)
    keys = docs.mapInArrow(_emit_keys(sent, bounds, words, width, parts, longest), "part int, span int, keys binary, counts binary")
    runs = keys.repartitionById(parts, "part").sortWithinPartitions("span").mapInArrow(_count_runs(words, width, longest, least), "key binary, a long")
    out = written(runs.groupBy("key").agg(F.sum("a").alias("a")).where(F.col("a") >= least), "phrases")
    done_with(rest)
    sent.destroy()
    return out


def unsubsumed(phrases: DataFrame, subsumed: int = SUBSUMED) -> DataFrame:
    """Phrases without those that stand in a longer one at least ``subsumed`` hundredths as often.

    A phrase between two is as frequent as the longer, so one word more is enough to look at.
    """
    inner = F.explode(F.array(F.expr("substring(key, 1, length(key) - 4)"), F.expr("substring(key, 5)")))
    longer = phrases.where("length(key) > 8").select(inner.alias("key"), "a").groupBy("key").agg(F.max("a").alias("over"))
    return phrases.join(longer, "key", "left").where(f"over is null or 100 * over < {int(subsumed)} * a").drop("over")


def scored(phrases: DataFrame, counts: DataFrame, lexicon: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) by the weakest cut; ``counts`` holds all phrases, ``lexicon`` all words."""
    word = lexicon.select(
        F.unhex(F.lpad(F.hex("id"), 8, "0")).alias("part"), F.col("n").alias("f"), F.struct("word", "lang", "total").alias("w"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    )
    known = word.unionByName(counts.select(F.col("key").alias("part"), F.col("a").alias("f"), F.lit(0).alias("salt")), allowMissingColumns=True)
    parts = F.expr("""concat(
        transform(sequence(1, length(key) div 4 - 1), k -> struct('l' as side, cast(k as int) as k, substring(key, 1, cast(4 * k as int)) as part)),
        transform(sequence(1, length(key) div 4 - 1), k -> struct('r' as side, cast(k as int) as k, substring(key, cast(4 * k + 1 as int)) as part)),
        transform(sequence(0, length(key) div 4 - 1), k -> struct('w' as side, cast(k as int) as k, substring(key, cast(4 * k + 1 as int), 4) as part)))""")
    salt = F.when(F.length("part") == 4, F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).otherwise(0)
    asked = phrases.select("key", "a", F.inline(parts)).withColumn("salt", salt)
    cuts = range(1, longest)
    side = lambda s, k: F.max(F.when((F.col("side") == s) & (F.col("k") == k), F.col("f")))
    words = F.collect_list(F.when(F.col("side") == "w", F.struct("k", "w")))
    row = asked.join(known, ["part", "salt"]).groupBy("key", "a").agg(F.array_sort(words).alias("ws"), *[side("l", k).alias(f"l{k}") for k in cuts], *[side("r", k).alias(f"r{k}") for k in cuts])
    row = row.withColumn("n", F.expr("ws[0].w.total")).withColumn("lang", F.expr("ws[0].w.lang")).withColumn("phrase", F.expr("array_join(transform(ws, x -> x.w.word), ' ')"))
    big = lambda c: F.col(c).cast("decimal(38,0)")
    cut = [F.when(F.col(f"l{k}").isNotNull(), F.struct(_div(F.lit(1000) * big("a") * big("n"), big(f"l{k}") * big(f"r{k}")).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in cuts]
    return row.withColumn("cut", F.array_min(F.array(*cut))).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def best(found: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` phrases of each language; first of parts of a language, so that no task sees all of one."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = found.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    some = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    last = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    return some.withColumn("rank", last.cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, least: int = LEAST, subsumed: int = SUBSUMED, top: int = TOP, sent_most: int = SENT
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of each language."""
    body = docs.select(F.col(text_col).alias("text"), F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"))
    counts = written(word_counts(body).where((F.col("n") >= least) | F.col("word").isNull()), "words")
    totals = counts.where("word is null").select("lang", F.col("n").alias("total"))
    lexicon, words = numbered(counts.where("word is not null").join(totals, "lang"))
    total = totals.agg(F.sum("total")).head()[0] or 0
    phrases = phrase_counts(body, lexicon, words, total, longest, least, sent_most)
    done_with(counts)
    return best(scored(unsubsumed(phrases, subsumed), phrases, lexicon, longest), top)
