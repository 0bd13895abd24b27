"""The watch loop as one stateful stream: polls of files in, conversions due, a ledger out.

Each path has a state: the last poll and what it showed, and its ledger entry. A file is
due when two following polls show the same time and size and the ledger has no equal entry,
or has one that waits for text recognition, recognition is there and fewer than
MOST_ATTEMPTS attempts were made. What is due in a micro-batch is converted, the results
are merged into the ledger table by path, and come back to the state with the next
micro-batch. The state starts from the ledger, so a new checkpoint repeats no finished work.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, GroupedData, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from foliospark.operators.ledger import MOST_ATTEMPTS
from foliospark.sources.ledger_table import LedgerTable
from foliospark.streaming.watch import source_of

POLL = "path string, poll long, mtime double, size long, server_ok boolean"
RESULT = "path string, poll long, mtime double, size long, ok boolean, needs_ocr boolean, used_ocr boolean, ocr_attempts int"
DUE = "path string, poll long, mtime double, size long, server_ok boolean, tries int"
ENTRY = "path string, poll long, mtime double, size long, signature string, needs_ocr boolean, ocr_attempts int"
_SEEN = "poll long, mtime double, size long"
_DONE = "poll long, mtime double, size long, same boolean, needs_ocr boolean, ocr_attempts int"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Watch(StatefulProcessor):
    """One path: polls and results in, what is due out."""

    def __init__(self, signature: str):
        self.signature = signature

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen, self.done = handle.getValueState("seen", _SEEN), handle.getValueState("done", _DONE)

    def handleInitialState(self, key, entry, timer_values) -> None:
        same = entry.signature == self.signature
        self.done.update((entry.poll, entry.mtime, entry.size, same, bool(entry.needs_ocr), int(entry.ocr_attempts or 0)))

    def handleInputRows(self, key, rows, timer_values) -> Iterator[Row]:
        seen = tuple(self.seen.get()) if self.seen.exists() else None
        done = tuple(self.done.get()) if self.done.exists() else None
        # results of a poll belong before the polls after it
        for r in sorted(rows, key=lambda r: (r.poll, r.ok is None)):
            if r.ok is not None:
                if r.ok and (done is None or r.poll > done[0]):
                    done = (r.poll, r.mtime, r.size, True, r.needs_ocr, r.ocr_attempts)
                continue
            if seen is not None and r.poll <= seen[0] or done is not None and r.poll <= done[0]:
                continue  # shown before, late, or older than the entry
            redo = done is not None and bool(r.server_ok) and done[4] and done[5] < MOST_ATTEMPTS
            if not (done is not None and done[3] and not redo and done[1:3] == (r.mtime, r.size)) and seen is not None and seen[1:] == (r.mtime, r.size):
                yield Row(path=key[0], poll=r.poll, mtime=r.mtime, size=r.size, server_ok=bool(r.server_ok), tries=done[5] if done is not None and done[3] and done[4] else 0)
            seen = (r.poll, r.mtime, r.size)
        if seen is not None:
            self.seen.update(seen)
        if done is not None:
            self.done.update(done)

    def close(self) -> None:
        pass


def due_files(polls: DataFrame, results: DataFrame, entries: GroupedData, signature: str) -> DataFrame:
    """Stream of polls and of earlier results to what is due; ``entries`` are the ledger's, grouped by path."""
    none = lambda kind: F.lit(None).cast(kind)
    a = polls.select("path", "poll", "mtime", "size", "server_ok", none("boolean").alias("ok"), none("boolean").alias("needs_ocr"), none("int").alias("ocr_attempts"))
    b = results.select("path", "poll", "mtime", "size", none("boolean").alias("server_ok"), "ok", "needs_ocr", "ocr_attempts")
    return a.unionByName(b).groupBy("path").transformWithState(Watch(signature), DUE, "Append", "None", initialState=entries)


def watch_loop(
    spark: SparkSession, polls: DataFrame, convert: Callable[[DataFrame], DataFrame], root: str, signature: str, state: str = "state", trigger: dict | None = None
) -> StreamingQuery:
    """Start the loop over a stream of polls (path, poll, mtime, size, server_ok).

    ``convert`` gives the due rows (DUE) with ok, needs_ocr and used_ocr. Under ``root`` lie
    the checkpoint (``state``; another name starts a new one), the results (``results``) and the ledger table (``ledger``).
    A run ends when the polls there are at its start are through, or as ``trigger`` says;
    results of a run reach the state in the next one, or in the next micro-batch of an
    endless one. A micro-batch that is run again writes its results in the same place and
    changes nothing in the ledger. Failures leave no entry: the file stays due.
    """
    ledger = LedgerTable(spark, f"{root}/ledger", "path", order="poll")
    if not ledger.fs.exists(ledger.jvm.org.apache.hadoop.fs.Path(f"{root}/results")):  # a stream needs a folder
        spark.createDataFrame([], RESULT).coalesce(1).write.parquet(f"{root}/results/none/0")
    results = spark.readStream.schema(RESULT).parquet(f"{root}/results/*/*")
    entries = (ledger.read() if ledger.numbers() else spark.createDataFrame([], ENTRY)).groupBy("path")

    def step(batch: DataFrame, epoch: int) -> None:
        source = source_of(batch)
        done = convert(batch)
        tries = F.when(F.col("needs_ocr"), F.col("tries") + F.col("used_ocr").cast("int")).otherwise(0)
        at = f"{root}/results/{source}/{epoch}"
        done.select("path", "poll", "mtime", "size", "ok", "needs_ocr", "used_ocr", tries.cast("int").alias("ocr_attempts")).write.mode("overwrite").parquet(at)
        kept = batch.sparkSession.read.schema(RESULT).parquet(at).where("ok")
        LedgerTable(batch.sparkSession, f"{root}/ledger", "path", order="poll").merge(
            kept.select("path", "poll", "mtime", "size", F.lit(signature).alias("signature"), "needs_ocr", "ocr_attempts"), source, epoch
        )

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    try:
        return due_files(polls, results, entries, signature).writeStream.foreachBatch(step).option("checkpointLocation", f"{root}/{state}").trigger(**(trigger or {"availableNow": True})).start()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
