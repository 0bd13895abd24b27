"""Document files as a Spark data source: batch and stream, filters and columns pushed to the listing.

    register(spark)
    spark.read.format("document_files").load("/folder")
    spark.readStream.format("document_files").load("/folder")

Rows are (path, ext, mtime, size, content); a schema of fewer columns reads no more than
these, and without ``content`` no file is opened. Filters on ``ext``, ``mtime``, ``size``
and the end of ``path`` are applied to the listing, so that other files are not read
either. Files are dealt to partitions of near ``partitionBytes`` (32 MB); a larger file is
one of its own. Rows leave the worker by a few MB, or a larger file alone. With the option
``pieceBytes`` no file is held whole: each comes in rows of so many bytes at most, an empty
one in one row, with a sixth column ``start`` for the piece's place in its file; a large
file is then dealt to several partitions. Pieces are a file's bytes as they are stored.
Paths are local ones or URIs that Arrow's file systems know (file, hdfs, s3, gs). Hidden
files and office lock files are left out, as ``is_input`` has it, and with the option
``supported`` (default true) all that have no supported ending.

A stream's offset is a time: a micro-batch has the files changed after the last offset and
``lagSeconds`` (2) or longer ago, so that files being written settle first. Files that are
moved in with an older time than the offset are not seen.
"""

from __future__ import annotations

import time
from collections.abc import Iterable, Iterator
from contextlib import nullcontext
from dataclasses import dataclass, replace
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringEndsWith,
)
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from foliospark.sources.parse import SUPPORTED

SCHEMA = "path string, ext string, mtime timestamp, size long, content binary"
PARTITION_BYTES, LAG_SECONDS = 32 << 20, 2.0
#: Rows, and bytes of content, after which rows go out.
OUT_ROWS, OUT_BYTES = 1000, 4 << 20
_COMPARED = {GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, EqualTo: lambda a, b: a == b}


@dataclass
class File:
    path: str
    ext: str
    mtime: datetime
    size: int
    #: The bytes that one task reads; None: whole.
    start: int = 0
    length: int | None = None


@dataclass
class Files(InputPartition):
    """The files that one task reads."""

    files: list[File]


def listed(root: str, supported: bool) -> tuple[fs.FileSystem, list[File]]:
    """The input files under a folder, by path."""
    system, at = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)
    out = []
    for f in system.get_file_info(fs.FileSelector(at, recursive=True)):
        ext = f.extension.lower()
        if f.type == fs.FileType.File and not f.base_name.startswith((".", "~$")) and (ext in SUPPORTED or not supported):
            out.append(File(f.path, ext, f.mtime, f.size))
    return system, sorted(out, key=lambda f: f.path)


def stretches(files: list[File], most: int, piece: int) -> Iterator[File]:
    """The files cut to stretches of whole pieces, near ``most`` bytes each."""
    step = max(most // piece, 1) * piece
    for f in files:
        for start in range(0, max(f.size, 1), step):
            yield replace(f, start=start, length=min(step, f.size - start))


def dealt(files: list[File], most: int, piece: int | None = None) -> list[Files]:
    """Partitions of near ``most`` bytes each."""
    out: list[Files] = []
    held = 0
    for f in files if piece is None else stretches(files, most, piece):
        size = f.size if f.length is None else f.length
        if not out or held + size > most:
            out.append(Files([]))
            held = 0
        out[-1].files.append(f)
        held += size
    return out


def _piece_bytes(options: dict[str, str]) -> int | None:
    """The option ``pieceBytes``; None: files are read whole."""
    given = options.get("piecebytes", options.get("pieceBytes"))
    if given is not None and int(given) < 1:
        raise ValueError(f"pieceBytes must be 1 or more, not {given}")
    return None if given is None else int(given)


class _Reading:
    """What batch and stream readers share."""

    def __init__(self, options: dict[str, str], schema: StructType):
        self.root = options["path"]
        self.supported = options.get("supported", "true").lower() == "true"
        self.most = int(options.get("partitionbytes", options.get("partitionBytes", PARTITION_BYTES)))
        self.lag = float(options.get("lagseconds", options.get("lagSeconds", LAG_SECONDS)))
        self.piece = _piece_bytes(options)
        self.schema = to_arrow_schema(schema)

    def contents(self, system: fs.FileSystem, f: File) -> Iterator[tuple[int, bytes | None]]:
        """Start and bytes of each row of a file; no bytes are read unless they are asked for."""
        wanted = "content" in self.schema.names
        if f.length is None:
            if wanted:
                with system.open_input_stream(f.path) as raw:
                    yield 0, raw.read()
            else:
                yield 0, None
            return
        end = f.start + f.length
        with system.open_input_file(f.path) if wanted else nullcontext() as raw:
            for start in range(f.start, max(end, f.start + 1), self.piece):
                n = min(self.piece, end - start)
                got = raw.read_at(n, start) if wanted else None
                if wanted and len(got) < n:
                    raise EOFError(f"{f.path} has become shorter than {f.size} bytes")
                yield start, got

    def rows(self, files: list[File]) -> Iterator[pa.RecordBatch]:
        """The columns asked for, few rows at a time; content is read only among them.

        Spark would make one batch of 10,000 tuples, the contents of a whole partition.
        """
        system = fs.FileSystem.from_uri(self.root)[0] if "://" in self.root or self.root.startswith("file:") else fs.LocalFileSystem()
        held: list[dict] = []
        read = 0
        for f in files:
            for start, content in self.contents(system, f):
                held.append({"path": f.path, "ext": f.ext, "mtime": f.mtime, "size": f.size, "start": start, "content": content})
                read += len(content or b"")
                content = None
                if len(held) >= OUT_ROWS or read >= OUT_BYTES:
                    yield self.batch(held)
                    read = 0
        if held:
            yield self.batch(held)

    def batch(self, held: list[dict]) -> pa.RecordBatch:
        """The rows as a batch; the list is emptied, so that contents are not kept twice while the batch is sent."""
        out = pa.RecordBatch.from_arrays([pa.array([r[c.name] for r in held], c.type) for c in self.schema], schema=self.schema)
        held.clear()
        return out


class FileReader(_Reading, DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        super().__init__(options, schema)
        self.tests: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Keep those that the listing can answer; give back the others."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if type(f) in _COMPARED and name in ("ext", "mtime", "size") or isinstance(f, In) and name == "ext" or isinstance(f, StringEndsWith) and name in ("path", "ext"):
                self.tests.append((name, type(f), f.value))
            else:
                yield f

    def passes(self, f: File) -> bool:
        for name, kind, value in self.tests:
            own = getattr(f, name)
            if isinstance(value, datetime) and value.tzinfo is None:
                value = value.astimezone(UTC)
            if not (own in value if kind is In else own.endswith(value) if kind is StringEndsWith else _COMPARED[kind](own, value)):
                return False
        return True

    def partitions(self) -> list[Files]:
        return dealt([f for f in listed(self.root, self.supported)[1] if self.passes(f)], self.most, self.piece)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return self.rows(partition.files)


class FileStreamReader(_Reading, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"upto": 0}

    def latestOffset(self) -> dict:
        """Microseconds of the newest file that has settled."""
        settled = (time.time() - self.lag) * 1e6
        times = [int(f.mtime.timestamp() * 1e6) for f in listed(self.root, self.supported)[1]]
        return {"upto": max((t for t in times if t <= settled), default=0)}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        found = [f for f in listed(self.root, self.supported)[1] if start["upto"] < int(f.mtime.timestamp() * 1e6) <= end["upto"]]
        return dealt(found, self.most, self.piece)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return self.rows(partition.files)


class DocumentFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "document_files"

    def schema(self) -> str:
        return SCHEMA if _piece_bytes(self.options) is None else f"{SCHEMA}, start long"

    def reader(self, schema: StructType) -> FileReader:
        return FileReader(self.options, schema)

    def streamReader(self, schema: StructType) -> FileStreamReader:
        return FileStreamReader(self.options, schema)


def register(spark: SparkSession) -> None:
    """Make the source known to the session, with filters pushed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DocumentFiles)
