"""Queries over the ledger of incremental work; orders stand in for files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators.ledger import already_done, attempts, batch_summary, degraded_notes, overwritten, remaining, report_rows, todo, updated
from foliospark.operators.qa import ready_files
from foliospark.plans.registry import query, table


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").cast("string").alias("path"), F.col("o_orderkey").cast("double").alias("mtime"), F.col("o_custkey").alias("size"), "o_orderkey", "o_orderstatus")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thirds of the files; some since changed, some with other options, some in need."""
    f = files(spark, sf_dir).where(F.col("o_orderkey") % 3 != 0)
    k = F.col("o_orderkey")
    return f.select("path", F.when(k % 5 == 0, F.col("mtime") + 1).otherwise(F.col("mtime")).alias("mtime"), "size", F.when(k % 7 == 0, "old").otherwise("sig").alias("signature"), F.lit(None).cast("timestamp").alias("finished_at"), (k % 11 == 0).alias("needs_ocr"), (k % 4).cast("int").alias("ocr_attempts"))


_SKIP = "o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0"


@query("q_ledger_skip", f"SELECT CAST(o_orderkey AS VARCHAR) AS path, ({_SKIP} AND NOT (o_orderkey % 11 = 0 AND o_orderkey % 4 < 2)) AS skip FROM orders")
def q_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return todo(files(spark, sf_dir), ledger(spark, sf_dir), "sig", server_ok=True).select("path", "skip")


@query("q_ledger_remaining", f"SELECT CAST(o_orderkey AS VARCHAR) AS path FROM orders WHERE NOT ({_SKIP})")
def q_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remaining(files(spark, sf_dir), ledger(spark, sf_dir), "sig").select("path")


def all_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return files(spark, sf_dir).withColumns({"ok": k % 13 != 0, "skipped": k % 10 == 0, "degraded": k % 6 == 0, "needs_ocr": k % 6 == 0, "used_ocr": k % 12 == 0, "duration": (k % 100) / 10, "error": F.when(k % 13 == 0, "broken"), "note": F.lit(None).cast("string")})


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of half of the files; the others are without."""
    return all_results(spark, sf_dir).where(F.col("o_orderkey") % 2 == 0)


@query(
    "q_ledger_update",
    """
    WITH l AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'old' ELSE 'sig' END AS signature, o_orderkey % 11 = 0 AS needs_ocr, CAST(o_orderkey % 4 AS INTEGER) AS a FROM orders WHERE o_orderkey % 3 <> 0),
    r AS (SELECT o_orderkey AS k, o_orderkey % 6 = 0 AS needs_ocr, CASE WHEN o_orderkey % 12 = 0 THEN 1 ELSE 0 END AS used FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 13 <> 0)
    SELECT CAST(k AS VARCHAR) AS path, signature, needs_ocr, a AS ocr_attempts FROM l WHERE k NOT IN (SELECT k FROM r)
    UNION ALL
    SELECT CAST(r.k AS VARCHAR), 'sig', r.needs_ocr, CAST(CASE WHEN r.needs_ocr THEN (CASE WHEN l.signature = 'sig' THEN coalesce(l.a, 0) ELSE 0 END) + used ELSE 0 END AS INTEGER) FROM r LEFT JOIN l ON l.k = r.k
    """,
)
def q_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return updated(ledger(spark, sf_dir), results(spark, sf_dir), "sig").select("path", "signature", "needs_ocr", "ocr_attempts")


@query(
    "q_batch_summary",
    """
    SELECT count(*) AS total, count(*) FILTER (WHERE k % 13 <> 0 AND k % 10 <> 0) AS succeeded, count(*) FILTER (WHERE k % 13 = 0) AS failed, count(*) FILTER (WHERE k % 10 = 0) AS skipped,
           count(*) FILTER (WHERE k % 6 = 0) AS degraded, round(sum(CAST(k % 100 AS DOUBLE) / 10), 3) AS elapsed FROM (SELECT o_orderkey AS k FROM orders)
    """,
)
def q_summary_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch_summary(all_results(spark, sf_dir)).withColumn("elapsed", F.round("elapsed", 3))


@query(
    "q_report_rows",
    """
    SELECT CAST(o_orderkey AS VARCHAR) AS path, CASE WHEN o_orderkey % 10 = 0 THEN 'skipped' WHEN o_orderkey % 13 <> 0 AND o_orderkey % 6 = 0 THEN 'degraded' WHEN o_orderkey % 13 <> 0 THEN 'ok' ELSE 'fail' END AS status,
           CASE WHEN o_orderkey % 13 = 0 THEN 'broken' END AS note FROM orders
    """,
)
def q_report_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_rows(all_results(spark, sf_dir)).select("path", "status", "note")


@query("q_degraded_notes", "SELECT CAST(o_orderkey AS VARCHAR) AS path, CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 11 = 0 THEN 'needs text recognition' END AS note FROM orders")
def q_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return degraded_notes(files(spark, sf_dir), ledger(spark, sf_dir)).select("path", "note")


_WORK = "SELECT o_orderstatus AS engine, CAST(o_orderkey AS VARCHAR) AS id, o_custkey % 2 = 0 AS done FROM orders"


def _work(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("engine"), F.col("o_orderkey").cast("string").alias("id"), (F.col("o_custkey") % 2 == 0).alias("done"))


@query("q_already_done", f"SELECT engine, id FROM ({_WORK}) WHERE NOT done")
def q_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _work(spark, sf_dir)
    return already_done(w, w.where("done")).select("engine", "id")


@query("q_overwritten", f"SELECT engine, id, CASE WHEN done THEN 'new' ELSE 'old' END AS state FROM ({_WORK})")
def q_overwritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _work(spark, sf_dir)
    old = w.select("engine", "id", F.lit("old").alias("state"))
    return overwritten(old, w.where("done").select("engine", "id", F.lit("new").alias("state")))


@query(
    "q_ready_files",
    """
    SELECT CAST(user_id AS VARCHAR) AS path, event_id AS poll, coalesce(lag(event_type) OVER w = event_type, FALSE) AS ready
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)
    """,
)
def q_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("path"), F.col("event_id").alias("poll"), F.lit(0.0).alias("mtime"), F.col("event_type").alias("size"))
    return ready_files(e).select("path", "poll", "ready")


@query(
    "q_attempts",
    """
    WITH e AS (SELECT user_id, event_id, event_type, CASE WHEN coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id), '') <> event_type THEN 1 ELSE 0 END AS turn, CASE WHEN value > 50 THEN 1 ELSE 0 END AS failed FROM events),
    r AS (SELECT *, sum(turn) OVER (PARTITION BY user_id ORDER BY event_id) AS era FROM e)
    SELECT CAST(user_id AS VARCHAR) AS path, event_id AS seq, CAST(sum(failed) OVER (PARTITION BY user_id, era ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS attempts FROM r
    """,
)
def q_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("path"), F.col("event_id").alias("seq"), F.col("event_type").alias("signature"), (F.col("value") > 50).alias("failed"))
    return attempts(e).select("path", "seq", "attempts")
