"""Continuous work: files that settle, an idempotent ledger, running counts, event windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from foliospark.operators.ledger import MOST_ATTEMPTS
from foliospark.sources.ledger_table import LedgerTable


def settled(observations: DataFrame) -> DataFrame:
    """Stream of (poll, path, mtime, size) to the files whose last two polls agree.

    State is one (mtime, size, reported) per path; a file is given once for each version.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else (None, None, False)
        out = []
        for row in pd.concat(list(frames)).sort_values("poll").itertuples():
            same = (row.mtime, row.size) == (last[0], last[1])
            if same and not last[2]:
                out.append((key[0], row.mtime, row.size))
            last = (float(row.mtime), int(row.size), bool(same))
        state.update(last)
        yield pd.DataFrame(out, columns=["path", "mtime", "size"])

    return observations.groupBy("path").applyInPandasWithState(
        step, "path string, mtime double, size long", "mtime double, size long, reported boolean", "append", GroupStateTimeout.NoTimeout
    )


def redo(failures: DataFrame) -> DataFrame:
    """Stream of (path, seq, failed) to the retries that are due: MOST_ATTEMPTS for each path."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tries = state.get[0] if state.exists else 0
        out = []
        for row in pd.concat(list(frames)).sort_values("seq").itertuples():
            if not row.failed:
                tries = 0
            elif tries < MOST_ATTEMPTS:
                tries += 1
                out.append((key[0], int(row.seq), tries))
        state.update((tries,))
        yield pd.DataFrame(out, columns=["path", "seq", "attempt"])

    return failures.groupBy("path").applyInPandasWithState(step, "path string, seq long, attempt int", "tries int", "append", GroupStateTimeout.NoTimeout)


def landing(spark: SparkSession, folder: str) -> DataFrame:
    """Stream of files as they land: path, modificationTime, length, content."""
    return spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").load(folder)


def source_of(batch: DataFrame) -> str:
    """The id of the stream that a ``foreachBatch`` function is called by; empty outside of one."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or ""


def ledger_sink(path: str, key: str = "path", order: str | None = None) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: merges a batch into a ledger table by key.

    A batch that is run again changes nothing; a stream with a new checkpoint, whose epochs
    start anew, is another source and adds to what is there.
    """

    def save(batch: DataFrame, epoch: int) -> None:
        LedgerTable(batch.sparkSession, path, key, order).merge(batch, source_of(batch), epoch)

    return save


def status_counts(results: DataFrame) -> DataFrame:
    """Running counts by status (update mode)."""
    return results.groupBy("status").count()


def recent(results: DataFrame, n: int = 50, order: str = "seq") -> DataFrame:
    """The last n rows of a snapshot."""
    return results.orderBy(F.desc(order)).limit(n)


def _marked(events: DataFrame, late: str) -> DataFrame:
    """Streams get a watermark, which needs a time with a zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts and sums by event type in time windows, with a watermark on streams."""
    marked = _marked(events, late)
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = marked.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user: events no further apart than the gap."""
    marked = _marked(events, late)
    out = marked.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")
