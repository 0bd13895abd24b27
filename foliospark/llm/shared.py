"""What the operators of this subpackage share: tables in the shared folder, components."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


ROWS = 500
RELEASE_SECONDS = 3.0
_RELEASED = [0.0]
#: Spark's own setting: the shuffle files of an execution go when it ends.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (tests) a folder of its own
    is set; on a cluster no executor could read what another has written there.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        at = "file://" + os.path.join(tempfile.gettempdir(), "foliospark-checkpoints")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ROWS rows from now on: they hold whole texts on both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ROWS:
        spark.conf.set(key, ROWS)


def write_once(df: DataFrame, path: str, **options: str) -> None:
    """Write Parquet from a plan that nothing runs again: Spark drops its shuffle files
    when the write ends. Queries of the caller keep theirs."""
    conf = df.sparkSession.conf
    before = conf.get(CLEAN, "false")
    conf.set(CLEAN, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        conf.set(CLEAN, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back.

    Losing executors loses none of it.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    write_once(df, path, compression="zstd")
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    release(spark)
    return out


def done_with(*frames: DataFrame | None) -> None:
    """Delete tables of ``written`` that nothing reads any more; their room is needed."""
    for df in frames:
        if (at := getattr(df, "_written", None)) is not None:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            path = jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(conf).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop what nothing refers to any more: shuffle files of counts
    and looks at single rows, broadcasts.

    That takes a collection on the driver, so not for steps of less than RELEASE_SECONDS.
    """
    if time.monotonic() - _RELEASED[0] < RELEASE_SECONDS:
        return
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    _RELEASED[0] = time.monotonic()


def few(df: DataFrame, lists: str, most: int) -> DataFrame:
    """``df`` for a join: sent to every task where it holds at most ``most`` rows and list
    elements together (checked), so that texts on the other side stay where they are."""
    if not most:
        return df
    held = df.agg(F.sum(F.size(lists) + F.lit(4))).head()[0] or 0
    return F.broadcast(df) if held <= most else df


#: Edges whose components a task works out at once (sixteen megabytes).
CONTRACTED = 1 << 20


def contracted(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, least node of its component) that join what the given edges join."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        x, y = root[a], root[b]
        far = x != y
        a, b, x, y = a[far], b[far], x[far], y[far]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while ((up := root[root]) != root).any():
            root = up
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def flush() -> pa.RecordBatch:
        u, v = contracted(*(np.concatenate(x) for x in zip(*held, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    for b in batches:
        held.append(tuple(np.asarray(b.column(c), dtype=np.int64) for c in ("u", "v")))
        if sum(len(u) for u, _ in held) >= CONTRACTED:
            yield flush()
            held = []
    if held:
        yield flush()


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges: (node, component = smallest node).

    Each task first replaces its own edges by stars that join the same nodes, then a
    large-star and a small-star step run over all edges, group-bys whose minimum is
    combined before the shuffle. Every round is written to the shared folder; the loop
    ends when the edges are stars on the component minima.
    """
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    e = written(e.mapInArrow(_contract, "u long, v long").distinct(), "edges")
    for _ in range(rounds):
        least = e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        up = least.select(F.col("u").alias("w"), "n").join(e.select(F.col("v").alias("w")).distinct(), "w", "left_semi").limit(1)
        if least.where("n > 1").limit(1).select("u").unionByName(up.select(F.col("w").alias("u"))).isEmpty():
            break
        e_all = e.mapInArrow(_contract, "u long, v long").distinct()
        both = e_all.unionByName(e_all.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: strictly larger neighbours of u move to the least of u's neighbourhood
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours move to the least of them
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        nxt = written(small.where("u <> v").distinct(), "edges")
        done_with(e)
        e = nxt
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
