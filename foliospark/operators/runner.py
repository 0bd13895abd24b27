"""Run engines over a table of documents: every row gets a status, whatever an engine does.

An engine is a function (kind, content) -> text. Calls run in processes forked from the
worker, one call at a time in each, so that one that hangs, crashes or takes too much memory
costs its own row and nothing else: neither the task nor the rows beside it. A process that
ended, ran out of time or memory, or had ``CALLS`` calls is replaced by a new one.

A task makes one call at a time. Only while all calls under way wait (neither their process
nor one that it started computes) does it start a further one, up to ``WAITING``: engines
that hang cost their time limit once for many rows, and none computes beside another.

Statuses: ``ok``, ``fail`` (an exception, a crash, too much memory, no text), ``timeout``,
``unsupported`` (a kind that the engine does not take), ``missing`` (no content). A row
that repeats is run for each. ``wall_s`` is the time of the call and ``peak_mb`` the most
memory of its process during it, both also measured where a call fails of itself.
"""

from __future__ import annotations

import contextlib
import multiprocessing
import resource
import time
from collections.abc import Callable, Collection, Iterable, Iterator
from dataclasses import dataclass
from multiprocessing.connection import Connection
from multiprocessing.connection import wait as wait_for

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Call = Callable[[str, object], str | None]
RESULT = "id string, engine string, format string, status string, wall_s double, peak_mb double, text string, note string"
NOTE_CHARS = 300
#: Calls of a process, calls of a task that may wait at once, seconds until they are looked at, and rows and characters that go out together.
CALLS, WAITING, GLANCE = 1000, 16, 0.02
OUT_ROWS, OUT_CHARS = 256, 1 << 20


@dataclass(frozen=True)
class Engine:
    """An engine and what it may use: seconds of wall time, MB beyond what the worker has."""

    name: str
    call: Call
    kinds: Collection[str]
    seconds: float = 300.0
    memory_mb: int | None = None


def _peak() -> float:
    return round(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024, 1)


def _one(engine: Engine, kind: str, content: object) -> tuple:
    """(status, wall_s, peak_mb, text, note) of a call in this process."""
    with contextlib.suppress(OSError), open("/proc/self/clear_refs", "w") as f:
        f.write("5")  # the peak is counted from here
    limit = resource.getrlimit(resource.RLIMIT_AS)
    if engine.memory_mb is not None:
        with open("/proc/self/statm") as f:
            held = int(f.read().split()[0]) * resource.getpagesize()
        resource.setrlimit(resource.RLIMIT_AS, (held + (engine.memory_mb << 20), limit[1]))
    began = time.perf_counter()
    try:
        text = engine.call(kind, content)
        status, note = ("ok", None) if text else ("fail", "no text")
    except BaseException as e:  # whatever an engine does is its own row's status
        text, status, note = None, "fail", f"{type(e).__name__}: {e}"[:NOTE_CHARS]
    resource.setrlimit(resource.RLIMIT_AS, limit)  # the next content comes in without it
    return status, round(time.perf_counter() - began, 3), _peak(), text, note


def _inside(pipe: Connection, engine: Engine) -> None:
    """Calls as they come in, until the pipe ends or memory ran out."""
    with contextlib.suppress(EOFError):
        for _ in range(CALLS):
            out = _one(engine, *pipe.recv())
            pipe.send(out)
            if out[0] == "fail" and out[4].startswith("MemoryError"):
                break
    pipe.close()


def _waits(pid: int) -> bool:
    """Whether neither a process nor one that it started computes now."""
    try:
        with open(f"/proc/{pid}/stat") as f:
            state = f.read().rpartition(")")[2].split()[0]
        with open(f"/proc/{pid}/task/{pid}/children") as f:
            return state != "R" and all(map(_waits, map(int, f.read().split())))
    except OSError:
        return False


class _Caller:
    """A process for the calls of an engine, and the row that it is at."""

    def __init__(self, engine: Engine):
        fork = multiprocessing.get_context("fork")
        self.pipe, theirs = fork.Pipe()
        self.process = fork.Process(target=_alone, args=(self.pipe, theirs, engine), daemon=True)
        self.process.start()
        theirs.close()
        self.calls, self.row, self.began = 0, None, 0.0

    def start(self, row: object, kind: str, content: object) -> None:
        self.calls, self.row, self.began = self.calls + 1, row, time.perf_counter()
        with contextlib.suppress(OSError):  # it went: seen when it is read
            self.pipe.send((kind, content))

    def end(self) -> None:
        self.process.kill()
        self.process.join()
        self.pipe.close()

    def result(self) -> tuple:
        """What came back, or that the process ended without a word."""
        try:
            return self.pipe.recv()
        except (EOFError, OSError):
            self.process.join(1)
            return "fail", round(time.perf_counter() - self.began, 3), None, None, f"ended with code {self.process.exitcode}"


def _alone(mine: Connection, theirs: Connection, engine: Engine) -> None:
    """The side of the worker is closed here, else the end of the worker would not be seen."""
    mine.close()
    _inside(theirs, engine)


def run_rows(engine: Engine, rows: Iterable[tuple]) -> Iterator[tuple]:
    """(row, (status, wall_s, peak_mb, text, note)) of rows (row, kind, content), as the calls end."""
    idle: list[_Caller] = []
    busy: list[_Caller] = []

    def over(wait: float) -> Iterator[tuple]:
        """Calls that are over now or after a wait."""
        left = min(c.began for c in busy) + engine.seconds - time.perf_counter()
        ready = set(wait_for([c.pipe for c in busy], max(0.0, min(wait, left))))
        for c in list(busy):
            if c.pipe in ready:
                out = c.result()
                gone = out[0] == "fail" and (out[2] is None or out[4].startswith("MemoryError")) or c.calls >= CALLS
            elif time.perf_counter() - c.began >= engine.seconds:
                out, gone = ("timeout", engine.seconds, None, None, f"over {engine.seconds:g} s"), True
            else:
                continue
            busy.remove(c)
            if gone:
                c.end()
            else:
                idle.append(c)
            yield c.row, out

    try:
        for row, kind, content in rows:
            if kind is None or kind.lower() not in engine.kinds:
                yield row, ("unsupported", 0.0, None, None, f"does not take {kind}")
                continue
            if content is None:
                yield row, ("missing", 0.0, None, None, "no content")
                continue
            while busy and (len(busy) >= WAITING or not all(_waits(c.process.pid) for c in busy)):
                yield from over(GLANCE)
            c = idle.pop() if idle else _Caller(engine)
            busy.append(c)
            c.start(row, kind.lower(), content)
            yield from over(GLANCE)
        while busy:
            yield from over(engine.seconds)
    finally:
        for c in (*idle, *busy):
            c.end()


def run_one(engine: Engine, kind: str | None, content: object) -> tuple:
    """(status, wall_s, peak_mb, text, note) of one call."""
    return next(out for _, out in run_rows(engine, [(None, kind, content)]))


def run_engine(docs: DataFrame, engine: Engine, id_col: str = "id", kind: str = "format", content: str = "content") -> DataFrame:
    """RESULT rows: one for each document, in Arrow batches of the tasks that hold them."""
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(kind).alias("format"), F.col(content).alias("content"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for id_, k, raw in zip(b.column("id"), b.column("format"), b.column("content"), strict=True):
                yield (id_.as_py(), k.as_py()), k.as_py(), raw.as_py()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for (id_, k), (status, wall, peak, text, note) in run_rows(engine, each(batches)):
            held.append({"id": id_, "engine": engine.name, "format": k, "status": status, "wall_s": wall, "peak_mb": peak, "text": text, "note": note})
            size += len(text or "")
            if len(held) >= OUT_ROWS or size >= OUT_CHARS:
                yield pa.RecordBatch.from_pylist(held, schema)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    schema = pa.schema([(c, pa.float64() if c in ("wall_s", "peak_mb") else pa.string()) for c in ("id", "engine", "format", "status", "wall_s", "peak_mb", "text", "note")])
    return rows.mapInArrow(run, RESULT)


def run_engines(docs: DataFrame, engines: list[Engine], done: DataFrame | None = None, **columns: str) -> DataFrame:
    """Results of all engines over all documents; pairs (engine, id) of ``done`` are left out before any call."""
    out = None
    for e in engines:
        left = docs
        if done is not None:
            ids = done.where(F.col("engine") == e.name).select(F.col("id").alias("_done")).distinct()
            left = docs.join(ids, F.col(columns.get("id_col", "id")).cast("string") == F.col("_done"), "left_anti")
        rows = run_engine(left, e, **columns)
        out = rows if out is None else out.unionByName(rows)
    return out
