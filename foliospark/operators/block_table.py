"""Blocks of many documents, kept up to date: only files that changed are parsed again.

Two tables lie under a folder: the rows of each document, and the stamp (time and size) of
each file as it was parsed. A refresh parses the files whose stamp is new and swaps their
rows, and those of files that are gone, in the buckets they lie in; other buckets are not
read or written. Stamps are written last: a refresh that breaks off is done over, with the
same result. Readers see a version as a whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.sources.ledger_table import LedgerTable
from foliospark.sources.writers import stored

STAMP = "path string, mtime double, size long"


class BlockTable:
    def __init__(self, spark: SparkSession, root: str, parse: Callable[[DataFrame], DataFrame], buckets: int = 16):
        """``parse`` makes rows with a column ``path`` of file rows (path, mtime, size, ...)."""
        self.spark, self.parse = spark, parse
        self.rows, self.stamps = LedgerTable(spark, f"{root}/rows", "path", buckets=buckets), LedgerTable(spark, f"{root}/stamps", "path", buckets=buckets)

    def read(self) -> DataFrame:
        return self.rows.read()

    def changes(self, files: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(files to parse, paths that are gone): anti joins against the stamps, before any parsing."""
        known = self.stamps.read() if self.stamps.numbers() else self.spark.createDataFrame([], STAMP)
        return files.join(known, ["path", "mtime", "size"], "left_anti"), known.select("path").join(files.select("path"), "path", "left_anti")

    def refresh(self, files: DataFrame) -> dict[str, int]:
        """Bring the tables up to the files there are; how many were parsed and how many are gone."""
        changed, gone = self.changes(files)
        stamps = stored(changed.select("path", F.col("mtime").cast("double").alias("mtime"), F.col("size").cast("long").alias("size")), "stamps")
        gone = stored(gone, "gone")
        counts = {"parsed": stamps.count(), "gone": gone.count()}
        if any(counts.values()) or not self.rows.numbers():
            keys = stamps.select("path").unionByName(gone)
            self.rows.swap(stored(self.parse(changed), "parsed"), keys)
            self.stamps.swap(stamps, keys)
        return counts
