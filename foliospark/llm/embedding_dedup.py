"""Embedding near-dedup by NN-descent: a neighbour graph refined until it settles.

Vectors are compared by cosine in double precision; null, zero and non-finite vectors
(or those with null components) link with nothing, nor do vectors of different lengths.

Plan. Equal vectors are one row with a count. The neighbour graph starts from blocks of
vectors that agree on random hyperplanes, and is refined by neighbours-of-neighbours
joins: the lists of a vector and those that list it meet in a block, and better
neighbours are kept. Lists whose last entry is still at the threshold are saturated and
enlarged. Edges at the threshold give components; further hyperplane passes look only
for edges between different components, and recall is audited: every vector with an id
divisible by AUDIT meets all others in blocks; a miss is added and the passes go on. What
the first audit found is kept: ``audit_recall`` is the part of such a vector's links that
the graph's components held by then.
Inside each component all links are then counted exactly, block against block, with
sums and spanning edges coming out but no list of pairs, so that no list length caps
the number of links.

Defined cases: rows that repeat a vec_id are one vector each for linking, and share
their component; a null vec_id links with nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.kernels import groups, ints
from foliospark.llm.shared import components, done_with, written

THRESHOLD = 0.95
LIST, LIST_MOST = 8, 64
TABLES, BLOCK = 24, 96
ROUNDS = 4
AUDIT = 20
EXACT = 512
#: Vectors that are asked together in the audit, and vectors that they meet at once.
ASKED, MET = 2048, 4096
#: Graph sims are single precision; edges this far below the threshold are still looked at exactly.
SLACK = 1e-4
_KEEP = 0.6


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        col = b.column("embedding").cast(pa.list_(pa.float64()))
        length = np.asarray(pa.compute.list_value_length(col).fill_null(0), dtype=np.int64)
        values = pa.compute.list_flatten(col)
        v = np.asarray(values.fill_null(np.nan), dtype=np.float64) + 0.0
        off = np.concatenate([[0], np.cumsum(length)])
        ids, out, vec, key = ints(b.column("vec_id")), [], [], []
        null = np.asarray(b.column("vec_id").is_null())
        for i in range(b.num_rows):
            x = v[off[i] : off[i + 1]]
            if null[i] or not len(x) or not np.isfinite(x).all() or not x.any():
                continue
            raw = (x / np.abs(x).max()).tobytes()  # scaled first: squares neither overflow nor vanish
            out.append(ids[i])
            vec.append(raw)
            key.append(hashlib.md5(raw).digest())
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64()), pa.array(vec, pa.binary()), pa.array(key, pa.binary())], ["id", "vec", "key"])


def unit(column: pa.Array, kind=np.float64) -> np.ndarray:
    """Rows of a binary column of doubles as unit vectors."""
    raw = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    v = np.frombuffer(b"".join(raw.to_pylist()), np.float64).reshape(len(raw), -1)
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(kind)


def single(v: np.ndarray) -> pa.Array:
    """Unit vectors in single precision, as the graph compares them: half as much to exchange."""
    return pa.array(list(map(bytes, v.astype(np.float32))), pa.binary())


def _singles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        dims = np.asarray(pa.compute.binary_length(b.column("vec")), dtype=np.int64)
        for dim in np.unique(dims):
            part = b.take(pa.array(np.flatnonzero(dims == dim)))
            yield pa.RecordBatch.from_arrays([part.column("id"), single(unit(part.column("vec")))], ["v", "vec"])


def _hash_planes(tables: int, bits: int, seed: int):
    """Rows for each table: the block key of the vector, its place in the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 512):
                b = whole.slice(a, 512)
                dims = np.asarray(pa.compute.binary_length(b.column("vec")), dtype=np.int64) // 8
                for dim in np.unique(dims):
                    rows = pa.array(np.flatnonzero(dims == dim))
                    part = b.take(rows)
                    v = unit(part.column("vec"))
                    short = single(v)
                    for t in range(tables):
                        planes = np.random.default_rng([seed, t, int(dim)]).standard_normal((int(dim), bits + 1))
                        side = v @ planes
                        code = ((side[:, :bits] > 0) << np.arange(bits)).sum(axis=1).astype(np.int64)
                        key = (int(dim) << 42) | (t << 34) | code
                        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(side[:, bits]), part.column("id"), part.column("label"), part.column("list"), short], ["k", "place", "id", "label", "list", "vec"])

    return run


_PLANE = "k long, place double, id long, label long, list int, vec binary"


def _meet(most: int, cross: float | None):
    """Within blocks: better neighbours of each, or only edges between different labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, "k", most):
            if t.num_rows < 2:
                continue
            ids = np.asarray(t.column("id"), dtype=np.int64)
            v = np.frombuffer(b"".join(t.column("vec").to_pylist()), np.float32).reshape(len(ids), -1)
            sims = v @ v.T
            sims[ids[:, None] == ids[None, :]] = -2
            if cross is not None:
                label = np.asarray(t.column("label"), dtype=np.int64)
                i, j = np.nonzero((sims >= cross) & (label[:, None] < label[None, :]))
                # one edge for each pair of labels in the block joins them
                pair = np.unique(np.column_stack([label[i], label[j]]), axis=0, return_index=True)[1] if len(i) else np.zeros(0, np.int64)
                i, j = i[pair], j[pair]
            else:
                keep = max(1, int(np.asarray(t.column("list"), dtype=np.int64).max()))
                k = min(keep, len(ids) - 1)
                j = np.argpartition(-sims, k - 1, axis=1)[:, :k]
                i = np.repeat(np.arange(len(ids)), k)
                j = j.ravel()
                good = sims[i, j] >= _KEEP
                i, j = i[good], j[good]
            yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[j]), pa.array(sims[i, j].astype(np.float32))], ["u", "v", "sim"])

    return run


_EDGE = "u long, v long, sim float"


def _parts(df: DataFrame) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)


def _met(rows: DataFrame, cross: float | None = None) -> DataFrame:
    return rows.repartition(_parts(rows), "k").sortWithinPartitions("k", "place").mapInArrow(_meet(BLOCK, cross), _EDGE)


class Graph:
    """The neighbour graph over distinct vectors and the links taken from it."""

    def __init__(self, vectors: DataFrame, threshold: float):
        self.threshold = threshold
        self.rows = written(vectors.mapInArrow(_prepare, "id long, vec binary, key binary"), "vectors")
        same = self.rows.groupBy("key").agg(F.min(F.struct("id", "vec")).alias("x"), F.countDistinct("id").alias("copies"))
        self.reps = written(same.select("key", F.col("x.id").alias("id"), F.col("x.vec").alias("vec"), "copies"), "distinct")
        self.n = self.reps.count()
        self.graph: DataFrame | None = None
        self.audited: DataFrame | None = None
        self.bits = int(np.clip(np.round(np.log2(max(self.n, 2) / 24)), 1, 30))

    def planes(self, seed: int, label: DataFrame | None = None) -> DataFrame:
        base = self.reps.select("id", "vec").withColumn("list", F.lit(LIST // 2))
        base = base.join(label, "id", "left").withColumn("label", F.coalesce("label", "id")) if label is not None else base.withColumn("label", F.col("id"))
        return base.select("id", "label", "list", "vec").mapInArrow(_hash_planes(TABLES, self.bits, seed), _PLANE)

    def top(self, edges: DataFrame, size: DataFrame | None) -> DataFrame:
        """(u, near): the best neighbours of each vector, as many as its list is long."""
        best = edges.groupBy("u").agg(F.sort_array(F.collect_set(F.struct("sim", "v")), asc=False).alias("near"))
        best = best.join(size, "u", "left") if size is not None else best.withColumn("list", F.lit(LIST))
        return best.select("u", F.coalesce("list", F.lit(LIST)).alias("list"), F.expr(f"slice(near, 1, coalesce(list, {LIST}))").alias("near"))

    def descend(self) -> DataFrame:
        """Refine until few lists change; gives all edges at the threshold."""
        graph = written(self.top(_met(self.planes(1)), None), "graph")
        pruned = None
        short = self.reps.select("id", "vec").mapInArrow(_singles, "v long, vec binary")
        for turn in range(ROUNDS):
            links = graph.select("u", "list", F.explode("near").alias("x")).select("u", "list", F.col("x.v").alias("v"), F.col("x.sim").alias("sim"))
            both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).union(links.select("u", F.col("u").alias("v"))).distinct()
            # who lists many is met in blocks of bounded size, in another order each time
            listed = both.join(short, "v").join(graph.select("u", "list"), "u", "left")
            rows = listed.select(F.col("u").alias("k"), (F.xxhash64("v", F.lit(turn)) / F.lit(float(1 << 63))).alias("place"), F.col("v").alias("id"), F.col("v").alias("label"), F.coalesce("list", F.lit(LIST)).alias("list"), "vec")
            found = _met(rows)
            saturated = graph.where(F.expr(f"size(near) >= list and near[size(near) - 1].sim >= {self.threshold - SLACK} and list < {LIST_MOST}"))
            size = graph.select("u", "list").join(saturated.select("u", F.lit(2).alias("times")), "u", "left").select("u", (F.col("list") * F.coalesce("times", F.lit(1))).alias("list"))
            nxt = written(self.top(links.select("u", "v", "sim").union(found.select("u", "v", "sim")), size), "graph")
            mark = lambda g: g.select(F.explode("near").alias("x")).agg(F.count("*"), F.sum(F.col("x.sim").cast("double"))).head()
            was, now = pruned or mark(graph), mark(nxt)
            done_with(graph)
            graph, pruned = nxt, now
            if now[0] <= was[0] * 1.001 and abs((now[1] or 0) - (was[1] or 0)) <= 0.001 * abs(was[1] or 1):
                break
        self.graph = graph
        edge = graph.select("u", F.explode("near").alias("x")).where(F.col("x.sim") >= self.threshold - SLACK)
        return edge.select(F.least("u", "x.v").alias("a"), F.greatest("u", "x.v").alias("b")).distinct()

    def audit(self, label: DataFrame) -> DataFrame:
        """The vectors with an id divisible by AUDIT against all: (u, v, sim, links), rows
        with v for links that join different labels, rows without for the numbers of links.

        Of equal vectors one stands for all, whichever of them is asked.
        """
        rows = self.reps.select("id", "vec", "key").join(label, "id", "left").withColumn("label", F.coalesce("label", "id"))
        asked = rows.join(self.rows.where(F.col("id") % AUDIT == 0).select("key").distinct(), "key", "left_semi").drop("key")
        n = max(1, -(-self.n // (AUDIT * ASKED)))
        asked = asked.withColumn("q", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).withColumn("role", F.lit(0))
        against = rows.drop("key").withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("role", F.lit(1))
        m = max(1, -(-self.n // MET))
        slot = lambda df, col: df.withColumn("k", (F.col("q") * m + F.col("s")).cast("long")).select("k", "role", "id", "label", "vec")
        left = slot(asked.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(m - 1)))), "s")
        right = slot(against.withColumn("s", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(m))), "s")
        both = left.unionByName(right)
        return both.repartition(_parts(both), "k").sortWithinPartitions("k", "role").mapInArrow(_ask(self.threshold), _EDGE + ", links long")

    def components(self) -> DataFrame:
        edges = written(self.descend(), "links")
        done_with(self.graph)
        found, seed, label, more = components(edges), 100, None, None
        while True:
            done_with(label)
            label = written(found.select(F.col("node").alias("id"), F.col("component").alias("label")), "labels")
            more = written(_met(self.planes(seed, label), self.threshold - SLACK).select(F.col("u").alias("a"), F.col("v").alias("b")), "cross")
            if more.isEmpty():
                done_with(more)
                audit = written(self.audit(label), "audit")
                if self.audited is None:
                    self.audited = audit.groupBy("u").agg(F.sum("links").alias("all"), F.count("v").alias("missed"))
                more = audit.where("v is not null").select(F.col("u").alias("a"), F.col("v").alias("b"))
                if more.isEmpty():
                    done_with(edges)
                    return label
            edges = written(edges.unionByName(more), "links")
            found, seed = components(edges), seed + 1

    def exact(self, label: DataFrame) -> DataFrame:
        """(id, links, to): exact links inside components; ``to`` holds spanning edges."""
        rows = self.reps.select("id", "vec", "copies").join(label, "id")
        sizes = label.groupBy("label").agg(F.count("*").alias("g"))
        rows = rows.join(sizes, "label").withColumn("blocks", F.ceil(F.col("g") / EXACT).cast("int"))
        rows = rows.withColumn("i", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        key = F.xxhash64("label", F.least("i", "other"), F.greatest("i", "other"))
        rows = rows.select(key.alias("k"), "label", (F.col("i") > F.col("other")).cast("int").alias("side"), (F.col("i") == F.col("other")).alias("own"), "id", "copies", "vec")
        return rows.repartition(_parts(rows), "k").sortWithinPartitions("k", "label").mapInArrow(_count(self.threshold), "id long, links long, to array<long>")


def _ask(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, "k"):
            role = np.asarray(t.column("role"), dtype=np.int64)
            q, r = t.filter(pa.array(role == 0)), t.filter(pa.array(role == 1))
            if not q.num_rows or not r.num_rows:
                continue
            for dim in set(pa.compute.binary_length(q.column("vec")).to_pylist()):
                qq, rr = (x.filter(pa.compute.equal(pa.compute.binary_length(x.column("vec")), dim)) for x in (q, r))
                if not rr.num_rows:
                    continue
                sims = unit(qq.column("vec")) @ unit(rr.column("vec")).T
                lq, lr = (np.asarray(x.column("label"), dtype=np.int64) for x in (qq, rr))
                a, b = (np.asarray(x.column("id"), dtype=np.int64) for x in (qq, rr))
                hit = (sims >= threshold) & (a[:, None] != b[None, :])
                i, j = np.nonzero(hit & (lq[:, None] != lr[None, :]))
                none = pa.nulls(len(a))
                yield pa.RecordBatch.from_arrays([pa.array(a), none.cast(pa.int64()), none.cast(pa.float32()), pa.array(hit.sum(axis=1))], ["u", "v", "sim", "links"])
                yield pa.RecordBatch.from_arrays([pa.array(a[i]), pa.array(b[j]), pa.array(sims[i, j].astype(np.float32)), pa.array(np.zeros(len(i), np.int64))], ["u", "v", "sim", "links"])

    return run


def spanning(hit: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a boolean adjacency (rows to columns of one set)."""
    n, seen, out = len(hit), np.zeros(len(hit), bool), []
    for s in range(n):
        if seen[s]:
            continue
        seen[s], front = True, [s]
        while front:
            u = front.pop()
            new = np.flatnonzero(hit[u] & ~seen)
            seen[new] = True
            out += [(u, int(v)) for v in new]
            front += new.tolist()
    return out


def _count(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, "k"):
            labels = np.asarray(t.column("label"), dtype=np.int64)
            for label in np.unique(labels):
                x = t.filter(pa.array(labels == label))
                dims = pa.compute.binary_length(x.column("vec"))
                for dim in set(dims.to_pylist()):
                    y = x.filter(pa.compute.equal(dims, dim))
                    ids, copies, side = (np.asarray(y.column(c), dtype=np.int64) for c in ("id", "copies", "side"))
                    v = unit(y.column("vec"))
                    hit = v @ v.T >= threshold
                    np.fill_diagonal(hit, False)
                    if not bool(y.column("own")[0].as_py()):
                        hit &= side[:, None] != side[None, :]
                    links = hit @ copies
                    to: list[list[int]] = [[] for _ in ids]
                    for a, b in spanning(hit):
                        to[a].append(int(ids[b]))
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links), pa.array(to, pa.list_(pa.int64()))], ["id", "links", "to"])

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept and audit_recall of every row of (vec_id, embedding).

    ``audit_recall`` is null for vectors that were not asked or have no links.
    """
    body = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    g = Graph(body, threshold)
    label = g.components()
    exact = written(g.exact(label), "exact")
    final = components(exact.select(F.col("id").alias("a"), F.explode("to").alias("b")))
    links = exact.groupBy("id").agg(F.sum("links").alias("links"))
    heard = g.audited.select(F.col("u").alias("id"), F.when(F.col("all") > 0, (F.col("all") - F.col("missed")) / F.col("all")).alias("recall"))
    rep = g.reps.select("key", "id", "copies").join(links, "id", "left").join(final.withColumnRenamed("node", "id"), "id", "left").join(heard, "id", "left")
    rep = rep.select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"), "recall")
    per = g.rows.select("id", "key").join(rep, "key").groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("component").alias("component"), F.min("recall").alias("recall"))
    per = written(per, "per-vector")
    done_with(g.rows, g.reps, label, exact)
    out = body.select("vec_id").join(per, body["vec_id"] == per["id"], "left")
    comp = F.coalesce("component", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), F.coalesce(comp == F.col("vec_id"), F.lit(True)).alias("kept"),
        F.when(F.col("vec_id") % AUDIT == 0, F.col("recall")).alias("audit_recall"),
    )
