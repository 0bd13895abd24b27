"""A keyed table of versions: merged by key, read whole at any time, replays without effect.

Rows lie in buckets by a hash of the key; each bucket is a folder of Parquet files that is
never changed. A version is a small manifest that names the folder of every bucket and
the last epoch merged from each source. Writing a version is one rename that fails where
the version exists already: readers see the old rows or the new ones, and of two writers
one starts over from the other's version. A merge reads and writes only buckets it has
rows for.

    <path>/data/<merge>/bucket=<b>/...     rows
    <path>/versions/<number>.json          manifests

Defined cases: of several rows with one key the one with the greatest ``order`` stays, a
row without order being the smallest, and of equal ones that with the greatest other
columns (so that replays agree); an older row never replaces a newer one. Without an order
the rows of the later merge replace those before. A null key is a key. A merge of no rows
only notes its epoch.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 16
TRIES = 20


class Conflict(RuntimeError):
    """Another writer was faster."""


@dataclass(frozen=True)
class Version:
    """What the table is at one time."""

    number: int = 0
    schema: str | None = None
    buckets: int = 0
    folders: dict[str, str] = field(default_factory=dict)
    epochs: dict[str, int] = field(default_factory=dict)


class LedgerTable:
    def __init__(self, spark: SparkSession, path: str, key: str | tuple[str, ...] = "path", order: str | None = None, buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.order, self.buckets = spark, path.rstrip("/"), (key,) if isinstance(key, str) else key, order, buckets
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.fs = self._at("").getFileSystem(self.conf)

    def _at(self, inner: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{inner}" if inner else self.path)

    # versions

    def numbers(self) -> list[int]:
        """The versions there are."""
        at = self._at("versions")
        if not self.fs.exists(at):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(at)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def version(self, number: int | None = None) -> Version:
        """A version; the latest by default, an empty one where there is none."""
        there = self.numbers()
        if number is None and not there:
            return Version()
        stream = self.fs.open(self._at(f"versions/{(there[-1] if number is None else number):020d}.json"))
        try:
            return Version(**json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def commit(self, new: Version) -> None:
        """Make a version the latest one, or raise ``Conflict`` if its number is taken."""
        part = self._at(f"versions/.{uuid.uuid4().hex}")
        out = self.fs.create(part, True)
        out.write(bytearray(json.dumps(asdict(new)).encode()))
        out.close()
        files = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(part.toUri(), self.conf)
        options = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files.rename(self.fs.makeQualified(part), self.fs.makeQualified(self._at(f"versions/{new.number:020d}.json")), options)
        except Exception as e:
            self.fs.delete(part, False)
            if "FileAlreadyExistsException" in str(e):
                raise Conflict(f"version {new.number} of {self.path}") from e
            raise

    # rows

    def _rows(self, v: Version, buckets: list[str] | None = None) -> DataFrame | None:
        names = v.folders if buckets is None else [b for b in buckets if b in v.folders]
        folders = [f"{self.path}/{v.folders[b]}" for b in names]
        return self.spark.read.schema(StructType.fromJson(json.loads(v.schema))).parquet(*folders) if folders else None

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of a version, the latest by default."""
        v = self.version(number)
        if v.schema is None:
            raise ValueError(f"nothing was ever merged into {self.path}")
        rows = self._rows(v)
        return self.spark.createDataFrame([], StructType.fromJson(json.loads(v.schema))) if rows is None else rows

    def _newest(self, rows: DataFrame) -> DataFrame:
        """One row for each key; aggregated before the shuffle, so a hot key costs nothing."""
        rest = [c for c in rows.columns if c not in self.keys and c != "_side"]
        rank = F.struct(*([F.col(self.order).alias("_order")] if self.order else []), "_side", F.struct(F.lit(0).alias("_none"), *rest).alias("_rest"))
        one = rows.groupBy(*self.keys).agg(F.max(rank).alias("_r"))
        return one.select(*[F.col(c) if c in self.keys else F.col(f"_r._rest.{c}").alias(c) for c in rows.columns if c != "_side"])

    def merge(self, rows: DataFrame, source: str | None = None, epoch: int | None = None) -> bool:
        """Merge rows by key as one version; False where this epoch of the source was merged before."""
        return self._write(rows, None, source, epoch)

    def swap(self, rows: DataFrame, keys: DataFrame) -> bool:
        """Put ``rows``, any number for each key, in the place of all rows of ``keys``, as one version."""
        return self._write(rows, keys.select(*self.keys).distinct(), None, None)

    def _write(self, rows: DataFrame, gone: DataFrame | None, source: str | None, epoch: int | None) -> bool:
        for _ in range(TRIES):
            v = self.version()
            if source is not None and epoch is not None and epoch <= v.epochs.get(source, -1):
                return False
            try:
                self.commit(self._merged(v, rows, gone, source, epoch))
                return True
            except Conflict:
                continue
        raise Conflict(f"{TRIES} other writers in a row at {self.path}")

    def _merged(self, v: Version, rows: DataFrame, gone: DataFrame | None, source: str | None, epoch: int | None) -> Version:
        buckets = v.buckets or self.buckets
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(buckets)).cast("int")
        folder = f"data/{uuid.uuid4().hex}"
        held = rows.persist()
        try:
            hit = held.select(bucket.alias("b")) if gone is None else held.select(bucket.alias("b")).union(gone.select(bucket.alias("b")))
            touched = [str(r[0]) for r in hit.distinct().collect()]  # at most one row a bucket
            old = self._rows(v, touched)
            if gone is None:
                both = held.select("*", F.lit(1).alias("_side"))
                both = self._newest(both if old is None else both.unionByName(old.select("*", F.lit(0).alias("_side"))))
            else:
                both = held if old is None else held.unionByName(old.join(gone, list(self.keys), "left_anti").select(*held.columns))
            if touched:
                both.withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
            written = self._buckets_in(folder) if touched else set()
        finally:
            held.unpersist()
        epochs = v.epochs | ({source: epoch} if source is not None and epoch is not None else {})
        kept = {b: f for b, f in v.folders.items() if b not in touched}
        return Version(v.number + 1, v.schema or rows.schema.json(), buckets, kept | {b: f"{folder}/bucket={b}" for b in written}, epochs)

    def _buckets_in(self, folder: str) -> set[str]:
        """Buckets that a write left rows in; one whose rows are all gone has no folder."""
        return {s.getPath().getName()[7:] for s in self.fs.listStatus(self._at(folder)) if s.isDirectory()}

    def forget(self, keep: int = 1) -> int:
        """Delete what the last ``keep`` versions do not name; how many folders went. Not beside writers."""
        numbers = self.numbers()
        held = {f for n in numbers[-keep:] for f in self.version(n).folders.values()}
        for n in numbers[:-keep]:
            self.fs.delete(self._at(f"versions/{n:020d}.json"), False)
        gone = 0
        if self.fs.exists(self._at("data")):
            for merge in self.fs.listStatus(self._at("data")):
                inner = [s.getPath() for s in self.fs.listStatus(merge.getPath()) if s.isDirectory()]
                old = [p for p in inner if f"data/{merge.getPath().getName()}/{p.getName()}" not in held]
                for p in [merge.getPath()] if len(old) == len(inner) else old:
                    self.fs.delete(p, True)
                gone += len(old)
        return gone
