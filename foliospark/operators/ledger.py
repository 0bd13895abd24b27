"""Incremental work: a ledger of what was done, and what that leaves to do."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PIPELINE = 3
MOST_ATTEMPTS = 2


def signature(options: dict) -> str:
    """A hash of the options that change results; the chunk size counts only with chunks."""
    used = {k: v for k, v in options.items() if k != "chunk_size" or options.get("rag_chunks")}
    return hashlib.md5(json.dumps(used | {"pipeline": PIPELINE}, sort_keys=True, default=str).encode()).hexdigest()


def todo(files: DataFrame, ledger: DataFrame, sig: str, server_ok: bool = False) -> DataFrame:
    """``files`` with ``skip``: same signature, time and size, and no redo that is due."""
    done = ledger.select("path", F.col("mtime").alias("_m"), F.col("size").alias("_s"), F.col("signature").alias("_g"), F.coalesce("needs_ocr", F.lit(False)).alias("_o"), F.coalesce("ocr_attempts", F.lit(0)).alias("_a"))
    same = (F.col("_g") == sig) & (F.col("_m") == F.col("mtime")) & (F.col("_s") == F.col("size"))
    redo = F.lit(server_ok) & F.col("_o") & (F.col("_a") < MOST_ATTEMPTS)
    out = files.join(done, "path", "left").withColumn("skip", F.coalesce(same & ~redo, F.lit(False)))
    return out.drop("_m", "_s", "_g", "_o", "_a")


def remaining(files: DataFrame, ledger: DataFrame, sig: str) -> DataFrame:
    """Files that the ledger has no equal entry for: an anti join ahead of any parsing."""
    return files.join(ledger.where(F.col("signature") == sig).select("path", "mtime", "size"), ["path", "mtime", "size"], "left_anti")


def updated(ledger: DataFrame, results: DataFrame, sig: str) -> DataFrame:
    """The ledger after a batch: successes replace their entry, failures leave none new.

    ``results`` has path, mtime, size, ok, needs_ocr and used_ocr. The count of attempts
    grows with each recognition that left the file in need, and starts anew with another
    signature.
    """
    old = ledger.select("path", F.col("signature").alias("_g"), F.coalesce("ocr_attempts", F.lit(0)).alias("_a"))
    base = results.where("ok").join(old, "path", "left")
    before = F.when(F.col("_g") == sig, F.coalesce("_a", F.lit(0))).otherwise(0)
    tries = F.when(F.col("needs_ocr"), before + F.col("used_ocr").cast("int")).otherwise(0)
    new = base.select("path", "mtime", "size", F.lit(sig).alias("signature"), F.current_timestamp().alias("finished_at"), "needs_ocr", tries.cast("int").alias("ocr_attempts"))
    return ledger.join(new.select("path"), "path", "left_anti").unionByName(new)


def attempts(events: DataFrame) -> DataFrame:
    """Running count of attempts of each path, starting anew when the signature changes."""
    w = Window.partitionBy("path").orderBy("seq")
    turn = (F.coalesce(F.lag("signature").over(w), F.lit("")) != F.col("signature")).cast("int")
    out = events.withColumn("_turn", turn).withColumn("era", F.sum("_turn").over(w))
    era = Window.partitionBy("path", "era").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return out.withColumn("attempts", F.sum(F.col("failed").cast("int")).over(era)).drop("_turn")


def already_done(work: DataFrame, results: DataFrame) -> DataFrame:
    """Pairs (engine, id) of the work that have no result yet."""
    return work.join(results.select("engine", "id").distinct(), ["engine", "id"], "left_anti")


def overwritten(results: DataFrame, fresh: DataFrame) -> DataFrame:
    """Results with those of the fresh (engine, id) replaced."""
    return results.join(fresh.select("engine", "id").distinct(), ["engine", "id"], "left_anti").unionByName(fresh)


def degraded_notes(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files with a note where the ledger has them as in need of text recognition."""
    kept = ledger.where("needs_ocr").select("path", F.lit("needs text recognition").alias("note"))
    return files.join(kept, "path", "left")


def batch_summary(results: DataFrame) -> DataFrame:
    """One row: total, succeeded, failed, skipped, degraded, elapsed."""
    return results.agg(
        F.count("*").alias("total"), F.count_if(F.col("ok") & ~F.col("skipped")).alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"),
        F.count_if("skipped").alias("skipped"), F.count_if("degraded").alias("degraded"), F.sum("duration").alias("elapsed"),
    )


def report_rows(results: DataFrame) -> DataFrame:
    """path, status and note of a batch: skipped before degraded before ok or fail."""
    status = F.when(F.col("skipped"), "skipped").when(F.col("ok") & F.col("degraded"), "degraded").when(F.col("ok"), "ok").otherwise("fail")
    return results.select("path", status.alias("status"), F.coalesce("error", "note").alias("note"), "duration")
