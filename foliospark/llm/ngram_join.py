"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence.

A document's set holds its distinct ``n``-word shingles (A-Z lower-cased; a shorter
text is one shingle; a text without words is empty and links with nothing). Two
documents link when the Jaccard similarity of their sets is at least
``percent`` / 100, decided in whole numbers.

Plan. The overlaps of all pairs are the entries of A A^T, with A the document by n-gram
incidence; only entries that can reach the limit are formed, block of columns by block.
Columns have one global order, those of many documents last. The first block of a row
is its first ``size - ceil(share * size) + 1`` columns: any linked pair has a common
column in it, at a place of which the sizes bound how far back it is. Equal sets are one
row. The product runs over the first block, its counts are accumulated, pairs that cannot
reach the limit with all their other columns are discarded, and the counts of the rest
are completed over the remaining columns.

The first block is multiplied in turns, so that a dense group is not multiplied out: each
row by one row for each of its columns, by up to eight, and then all rows that share a
column and are still in different components. Columns of up to HOT such rows are joined
and their counts accumulated by pair. Columns of more rows are cut by size class and
salt into tiles; two tiles are multiplied in one task, where the symmetric difference of
two rows is bounded from below by that of their bitmaps (one bit for every hashed column,
flipped by each), so that only pairs near the limit leave it.

Defined cases: null texts are empty; a null id links with nothing and has a null
component; rows that repeat an id are one node, linked by any of its texts; an empty
table gives an empty result. Columns are 64-bit fingerprints of shingles, sets are told
apart by 128 bits and their size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.kernels import U64, Texts, Words, groups, lists, mix, rolling, run_starts, slices
from foliospark.llm.shared import components, done_with, written

SHINGLE = 5
PERCENT = 75
#: How many rows of a column the others meet in each round, before what is left is multiplied out.
CENTRES = (1, 8)
#: Documents whose columns are counted together in search of frequent ones; a column of
#: more than FREQUENT / COUNTED of all documents is found in at least one such block.
COUNTED, FREQUENT = 8192, 2
#: Ids of candidates that are sent to every task (four megabytes); more are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Most columns that the frequency order tells apart; it orders columns and drops none.
ORDERED = (1 << 16) - 1
#: Rows of a column up to which they are joined; those of larger ones are cut into tiles of about TILE.
HOT, TILE = 64, 1024
#: Bits that the columns of a row are hashed to.
BITS = 1024


def shingle_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Distinct shingles of each text: fingerprints sorted within documents, their documents."""
    w = Words(Texts(column), lower=True)
    count = w.counts()
    grams = rolling(w.code, n)
    at = np.flatnonzero(run_starts(w.bounds, n, w.n))
    h, doc = grams[at], np.searchsorted(w.bounds, at, side="right") - 1
    for size in range(1, n):  # short texts: the whole sequence as one
        short = np.flatnonzero(count == size)
        if len(short):
            h = np.append(h, mix(rolling(w.code, size)[w.bounds[short]] + U64(size)))
            doc = np.append(doc, short)
    h, doc = by_document(h, doc, len(count))
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], doc[new], len(count)


def by_document(h: np.ndarray, doc: np.ndarray, n: int, rank: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sort by document, then by rank if given, then by fingerprint."""
    order = np.argsort(h)
    if rank is not None:
        order = order[np.argsort(rank[order], kind="stable")]
    key = doc[order]
    order = order[np.argsort(key.astype(np.uint16) if n < 1 << 16 else key, kind="stable")]
    return h[order], doc[order]


def _count_frequent(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, docs = [], 0

        def flush() -> pa.RecordBatch:
            value, times = np.unique(np.concatenate(have), return_counts=True) if have else (np.zeros(0, U64), np.zeros(0, np.int64))
            often = times >= max(FREQUENT, -(-FREQUENT * docs // COUNTED))
            return pa.RecordBatch.from_arrays([pa.array(value[often].view(np.int64)), pa.array(times[often].astype(np.int64))], ["gram", "times"])

        for b in slices(batches, "k_body"):
            h, _, rows = shingle_sets(b.column("k_body"), n)
            have.append(h)
            docs += rows
            if docs >= COUNTED or sum(map(len, have)) > 2 << 20:
                yield flush()
                have, docs = [], 0
        yield flush()

    return run


def frequent_columns(docs: DataFrame, n: int) -> Broadcast:
    """Columns of many documents and their rank by frequency, to order columns by.

    At most ORDERED entries of ten bytes: the broadcast does not grow with the data.
    """
    found = docs.mapInArrow(_count_frequent(n), "gram long, times long").groupBy("gram").agg(F.sum("times").alias("times"))
    top = found.where(F.col("times") >= 8).orderBy(F.desc("times"), "gram").limit(ORDERED).toPandas()
    gram = top["gram"].to_numpy(np.int64).view(U64)
    rank = np.empty(len(gram), np.uint16)
    rank[np.lexsort((gram, top["times"].to_numpy(np.int64)))] = np.arange(1, len(gram) + 1)
    order = np.argsort(gram)
    return docs.sparkSession.sparkContext.broadcast((gram[order], rank[order]))


def bitmaps(h: np.ndarray, doc: np.ndarray, rows: int) -> np.ndarray:
    """A row of BITS bits for each document: bit b is set if an odd number of its columns hash to b."""
    at = doc * BITS + (mix(h + U64(0x5851F42D)) >> U64(40)).astype(np.int64) % BITS
    odd = (np.bincount(at, minlength=rows * BITS) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(rows, BITS), axis=1)


def _emit_rows(n: int, percent: int, ordered: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, place = ordered.value
        for b in slices(batches, "k_body"):
            h, doc, rows = shingle_sets(b.column("k_body"), n)
            size = np.bincount(doc, minlength=rows)
            starts = np.concatenate([[0], np.cumsum(size)])
            mark = lambda salt: np.add.reduceat(np.append(mix(h ^ U64(salt)), U64(0)), np.minimum(starts[:-1], len(h)))
            one, two = mark(0x1234567), mark(0x89ABCDE)
            one[size == 0] = two[size == 0] = 0
            bits = bitmaps(h, doc, rows)
            rank = np.zeros(len(h), np.uint16)
            if len(gram):
                at = np.minimum(np.searchsorted(gram, h), len(gram) - 1)
                rank = np.where(gram[at] == h, place[at], 0).astype(np.uint16)
            h, doc = by_document(h, doc, rows, rank)
            prefix = size - -(-percent * size // 100) + (size > 0)
            inside = np.arange(len(h)) - starts[doc] < prefix[doc]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(size), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), lists(h[inside].view(np.int64), prefix), pa.array(list(map(bytes, bits)), pa.binary())],
                ["id", "size", "mark_a", "mark_b", "prefix", "bits"],
            )

    return run


def _emit_sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "k_body"):
            h, doc, rows = shingle_sets(b.column("k_body"), n)
            yield pa.RecordBatch.from_arrays([b.column("id"), lists(h.view(np.int64), np.bincount(doc, minlength=rows))], ["id", "whole"])

    return run


def _size_ok(percent: int) -> Column:
    return F.expr(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")


def _overlap_ok(overlap: str, percent: int) -> Column:
    """100 o >= p (na + nb - o)."""
    return F.expr(f"({100 + percent}) * ({overlap}) >= {percent} * (na + nb)")


def _beyond(size: str, percent: int) -> str:
    """How many columns a row has beyond its first block."""
    return f"(ceil({percent} * {size} / 100) - 1)"


def _reach_ok(left: str, percent: int) -> Column:
    """The least number of columns from a common one on is enough for a link.

    In a linked pair this holds for the first common column in the global order.
    """
    return F.expr(f"{100 + percent} * {left} >= {percent} * (na + nb)")


def small(df: DataFrame) -> DataFrame:
    """``df`` for a join: sent to every task where it has at most BROADCAST_IDS rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def _tiles(percent: int):
    """Multiply two tiles of a column: pairs whose bitmaps leave a link possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, "tile"):
            ids, size, left, comp, side = (np.asarray(t.column(c), dtype=np.int64) for c in ("id", "size", "left", "component", "side"))
            bits = np.frombuffer(b"".join(t.column("bits").to_pylist()), np.uint64).reshape(len(ids), -1)
            one = side.max() == 0  # a tile with itself
            cols = np.arange(len(ids)) if one else np.flatnonzero(side == 1)
            rows = cols if one else np.flatnonzero(side == 0)
            found = []
            for at in range(0, len(rows), 64):
                i, j = rows[at : at + 64, None], cols[None, :]
                both = size[i] + size[j]
                need = -(-percent * both // (100 + percent))
                good = (comp[i] != comp[j]) & (100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j])) & (np.minimum(left[i], left[j]) >= need)
                if one:
                    good &= i < j
                x, y = np.nonzero(good)
                x, y = i[x, 0], j[0, y]
                apart = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64)
                near = apart <= size[x] + size[y] - 2 * -(-percent * (size[x] + size[y]) // (100 + percent))
                found.append((x[near], y[near]))
            x, y = (np.concatenate(k) for k in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
            swap = ids[x] > ids[y]
            x, y = np.where(swap, y, x), np.where(swap, x, y)
            yield pa.RecordBatch.from_arrays([pa.array(k) for k in (ids[x], ids[y], size[x], size[y])], ["a", "b", "na", "nb"])

    return run


class Product:
    """The links between rows with different sets, found block by block."""

    def __init__(self, docs: DataFrame, rows: DataFrame, n: int, percent: int):
        self.docs, self.n, self.percent = docs, n, percent
        self.spent: list[DataFrame] = []
        live = rows.where("size > 0 and id is not null")
        same = F.struct("size", "mark_a", "mark_b").alias("same")
        #: one row stands for all with its set; only sets of several rows are joined back, from a
        #: table, so that a set of very many rows can be split where they are too many to send
        stands = written(live.groupBy(same).agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1").select("same", "rep"), "stands")
        member = live.select("id", same).join(small(stands), "same", "left")
        self.members = written(member.select("id", F.coalesce("rep", "id").alias("rep")), "members")
        done_with(stands)
        others = small(self.members.where("id <> rep").select("id"))
        single = live.join(others, "id", "left_anti")
        index = single.select("id", F.posexplode("prefix").alias("at", "gram"), "size")
        # of a linked pair the smaller row has the first common column this far ahead
        ahead = F.max(F.expr(f"{100 + percent} * (size - at) >= {2 * percent} * size"))
        shared = index.groupBy("gram").agg(F.count("*").alias("n"), ahead.alias("ahead")).where("n > 1").select("gram", "ahead")
        own = index.select("gram", "id", "size", F.col("at").cast("int").alias("at")).join(shared, "gram")
        #: the columns of each row's first block that other rows have too
        self.blocks = written(own.groupBy("id", "size").agg(F.collect_list(F.struct("gram", "at", "ahead")).alias("block")), "blocks")
        self.bits = rows.select("id", "bits")

    def index(self) -> DataFrame:
        """(gram, id, size, left, held): columns that links can be found by.

        ``left``: columns of the row from this one on; ``held``: those of its first block
        that others have too.
        """
        x = self.blocks.select("id", "size", F.size("block").alias("held"), F.explode("block").alias("x")).where("x.ahead")
        return x.select(F.col("x.gram").alias("gram"), "id", "size", (F.col("size") - F.col("x.at")).cast("int").alias("left"), "held")

    def overlap(self, pairs: DataFrame) -> DataFrame:
        """Keep the pairs (a, b, na, nb) that link: the counts of the first block, the
        bounds, then the counts of the other columns on top."""
        p = self.percent
        side = lambda x: self.blocks.select(F.col("id").alias(x), F.col("block.gram").alias(f"block_{x}"))
        first = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("o", F.size(F.array_intersect("block_a", "block_b")))
        rest = f"greatest({_beyond('na', p)}, {_beyond('nb', p)})"
        near = written(first.where(_overlap_ok(f"o + {rest}", p)).select("a", "b", "na", "nb", "o"), "near")
        ids = small(near.select(F.col("a").alias("id")).union(near.select("b")).distinct())
        sets = self.docs.join(ids, "id").mapInArrow(_emit_sets(self.n), "id long, whole array<long>")  # where the ids are few the texts stay in place
        cut = sets.join(self.blocks.join(ids, "id").select("id", F.col("block.gram").alias("block")), "id")
        cut = written(cut.select("id", "block", F.array_except("whole", "block").alias("other")), "sets")
        self.spent += [near, cut]
        side = lambda x: cut.select(F.col("id").alias(x), F.col("block").alias(f"block_{x}"), F.col("other").alias(f"other_{x}"))
        both = near.join(side("a"), "a").join(side("b"), "b")
        more = "size(array_intersect(other_a, other_b)) + size(array_intersect(block_a, other_b)) + size(array_intersect(other_a, block_b))"
        return both.where(_overlap_ok(f"o + {more}", p)).select("a", "b")

    def star_pairs(self, index: DataFrame, turn: int) -> DataFrame:
        """Pairs of each row and the rows that stand for its column and size class.

        In the first round that is the row most of whose columns others have too, as what
        copies were made from has; in later ones any.
        """
        step = np.log(100 / self.percent)
        x = index.withColumn("level", F.floor(F.log("size") / F.lit(float(step)) + 1e-9).cast("int"))
        first = F.lit(0) if turn else -F.col("held") / F.col("size")
        chosen = [F.min(F.struct(first.alias("f"), F.xxhash64("id", F.lit(turn), F.lit(k)).alias("r"), "id", "size", "component", "left")) for k in range(CENTRES[turn])]
        centre = x.groupBy("gram", "level").agg(F.array(*chosen).alias("cs")).select("gram", "level", F.explode(F.array_distinct("cs")).alias("c"))
        centre = centre.withColumnRenamed("level", "c_level")
        met = x.join(centre, "gram").where("c_level = level or c_level = level - 1")
        return met.where("component <> c.component").select(
            F.least("id", "c.id").alias("a"), F.greatest("id", "c.id").alias("b"),
            F.when(F.col("id") < F.col("c.id"), F.col("size")).otherwise(F.col("c.size")).alias("na"),
            F.when(F.col("id") < F.col("c.id"), F.col("c.size")).otherwise(F.col("size")).alias("nb"), F.least("left", "c.left").alias("left"),
        ).where(_size_ok(self.percent) & _reach_ok("left", self.percent)).select("a", "b", "na", "nb").distinct()

    def cross_pairs(self, index: DataFrame) -> DataFrame:
        """Pairs of rows in different components that the first block leaves open."""
        p = self.percent
        rows = index.groupBy("gram").agg(F.count("*").alias("rows"))
        hot = small(written(rows.where(F.col("rows") > HOT).select("gram"), "hot"))
        cold = index.join(hot, "gram", "left_anti")
        here = cold.groupBy("id").agg(F.count("*").alias("here"))
        # columns that could be common but are not counted here
        rest = F.expr(f"{_beyond('size', p)} + held - here")
        x = cold.join(here, "id").select("gram", "id", "size", "component", "left", rest.alias("rest"))
        y = x.select("gram", F.col("id").alias("b"), F.col("size").alias("nb"), F.col("component").alias("cb"), F.col("left").alias("lb"), F.col("rest").alias("rb"))
        met = x.join(y, "gram").where("id < b and component <> cb").select(F.col("id").alias("a"), "b", F.col("size").alias("na"), "nb", F.least("left", "lb").alias("left"), F.greatest("rest", "rb").alias("rest"))
        counts = met.where(_size_ok(p)).groupBy("a", "b", "na", "nb").agg(F.count("*").alias("o"), F.max("left").alias("left"), F.max("rest").alias("rest"))
        near = counts.where(_reach_ok("left", p) & _overlap_ok("o + rest", p)).select("a", "b", "na", "nb")
        return near.unionByName(self.tile_pairs(index.join(hot, "gram", "left_semi"))).distinct()

    def tile_pairs(self, index: DataFrame) -> DataFrame:
        """The same for columns of many rows, tile by tile."""
        p = self.percent
        step = float(np.log(100 / p))
        x = index.withColumn("level", F.floor(F.log("size") / F.lit(step) + 1e-9).cast("int"))
        sizes = x.groupBy("gram", "level").agg(F.ceil(F.count("*") / F.lit(TILE)).cast("int").alias("k"))
        x = x.join(sizes, ["gram", "level"]).withColumn("t", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
        near = sizes.select("gram", F.col("level").alias("to"), F.col("k").alias("many"))
        met = x.join(near, "gram").where("abs(to - level) <= 1").withColumn("s", F.explode(F.expr("sequence(0, many - 1)")))
        # the tile of the lower class first, or of the lower number
        ahead = F.expr("level < to or (level = to and t <= s)")
        key = F.xxhash64("gram", F.least("level", "to"), F.greatest("level", "to"), F.when(ahead, F.col("t")).otherwise(F.col("s")), F.when(ahead, F.col("s")).otherwise(F.col("t")))
        rows = met.select(key.alias("tile"), F.when(ahead, 0).otherwise(1).alias("side"), "id", "size", "left", "component")
        rows = rows.join(self.bits, "id")
        spark = index.sparkSession
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
        return rows.repartition(parts, "tile").sortWithinPartitions("tile").mapInArrow(_tiles(p), "a long, b long, na long, nb long").distinct()

    def labels(self) -> DataFrame | None:
        """(id, component) of the representatives that link with another."""
        label, tested, index_read = None, None, None
        index = self.index().withColumn("component", F.col("id"))
        for turn in range(len(CENTRES) + 1):
            if label is not None:
                # columns whose rows are all in one component are done with
                index = index.drop("component").join(small(label), "id", "left").withColumn("component", F.coalesce("component", "id"))
            if turn:
                several = index.groupBy("gram").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("gram")
                was, index = index_read, written(index.join(several, "gram", "left_semi"), "open")
                done_with(was)
                index_read = index
            pairs = self.star_pairs(index, turn) if turn < len(CENTRES) else self.cross_pairs(index)
            if tested is not None:
                pairs = pairs.join(tested, ["a", "b"], "left_anti")
            pairs = written(pairs, "pairs")
            done = pairs.select("a", "b")
            tested = done if tested is None else tested.unionByName(done)
            if pairs.isEmpty():
                continue
            found = self.overlap(pairs)
            if label is not None:
                same = lambda x: label.select(F.col("id").alias(x), F.col("component").alias(f"c{x}"))
                found = found.join(same("a"), "a", "left").join(same("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
            step = components(found)
            done_with(*self.spent)
            self.spent = []
            if label is None:
                label = written(step.select(F.col("node").alias("id"), "component"), "labels")
            else:
                old = label.join(step.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("id", F.coalesce("to", "component").alias("component"))
                new = step.select(F.col("node").alias("id"), "component").join(label, "id", "left_anti")
                label = written(old.unionByName(new), "labels")
        return label


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs``: id, n_shingles, component_id (smallest id reachable by links)."""
    body = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("k_body"))
    if _unique(body):
        return _components(body, n, percent)
    # rows with one id and text are one node, and the nodes of an id are linked
    named = body.withColumn("mark", F.sha2(F.coalesce("k_body", F.lit("")), 256))
    nodes = written(named.where("id is not null").select("id", "mark").distinct().withColumn("node", F.monotonically_increasing_id()), "nodes")
    once = named.join(nodes, ["id", "mark"]).dropDuplicates(["node"]).select(F.col("node").alias("id"), "k_body")
    found = _components(once, n, percent).select(F.col("id").alias("node"), "n_shingles", F.col("component_id").alias("group"))
    found = written(nodes.join(found, "node"), "found")
    first = Window.partitionBy("group")
    links = found.select(F.col("id").alias("a"), F.min("id").over(first).alias("b"))
    label = components(links).select(F.col("node").alias("id"), "component")
    out = named.join(found.select("id", "mark", "n_shingles"), ["id", "mark"], "left").join(label, "id", "left")
    sizes = shingle_counts(named.where("id is null").select("id", "k_body"), n)
    return out.where("id is not null").select("id", "n_shingles", F.coalesce("component", "id").alias("component_id")).unionByName(sizes)


def shingle_counts(body: DataFrame, n: int) -> DataFrame:
    """Rows that take no part: (id, n_shingles, component_id = null)."""
    rows = body.mapInArrow(_emit_sets(n), "id long, whole array<long>")
    return rows.select("id", F.size("whole").cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))


def _unique(body: DataFrame) -> bool:
    return body.where("id is not null").groupBy("id").count().where("count > 1").isEmpty()


def _components(body: DataFrame, n: int, percent: int) -> DataFrame:
    ordered = frequent_columns(body, n)
    rows = written(body.mapInArrow(_emit_rows(n, percent, ordered), "id long, size long, mark_a long, mark_b long, prefix array<long>, bits binary"), "rows")
    product = Product(body.where("id is not null"), rows, n, percent)
    label = product.labels()
    of = product.members
    if label is not None:
        of = of.join(label.select(F.col("id").alias("rep"), "component"), "rep", "left").select("id", F.coalesce("component", "rep").alias("component"))
    else:
        of = of.select("id", F.col("rep").alias("component"))
    return rows.join(of, "id", "left").select("id", F.col("size").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each component: that with the smallest id.

    Rows with a null id stay. Where ids repeat, rows with the same id and text are one
    document; others are documents of their own, which go only for links of their texts.
    Columns come back under their names, whatever these are.
    """
    names = docs.columns
    inner = docs.toDF(*[f"c_{i}" for i in range(len(names))])
    own, text = F.col(f"c_{names.index(id_col)}").cast("long"), F.col(f"c_{names.index(text_col)}")
    body = inner.select(own.alias("id"), text.alias("k_body"))
    if _unique(body):
        gone = _components(body, n, percent).where("id is not null and component_id < id").select(F.col("id").alias("k_gone"))
        return inner.join(gone, own == F.col("k_gone"), "left_anti").toDF(*names)
    keyed = inner.withColumns({"k_id": own, "k_text": F.sha2(F.coalesce(text, F.lit("")), 256), "k_body": text})
    named = keyed.where("k_id is not null").dropDuplicates(["k_id", "k_text"])
    nodes = written(named.select("k_id", "k_text").withColumn("k_node", F.monotonically_increasing_id()), "nodes")
    found = _components(named.join(nodes, ["k_id", "k_text"]).select(F.col("k_node").alias("id"), "k_body"), n, percent)
    first = found.join(nodes, F.col("id") == F.col("k_node")).groupBy("component_id").agg(F.min(F.struct("k_id", "k_text")).alias("k")).select("k.*")
    kept = named.join(first, ["k_id", "k_text"], "left_semi").select(*inner.columns)
    return kept.unionByName(inner.where(own.isNull())).toDF(*names)
