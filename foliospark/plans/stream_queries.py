"""Event windows in batch form, for comparison (the same functions run on streams); the watch loop and its ledger as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators.ledger import MOST_ATTEMPTS
from foliospark.plans.registry import query, table
from foliospark.sources.ledger_table import LedgerTable
from foliospark.sources.writers import stored, work_folder
from foliospark.streaming.loop import POLL, RESULT, watch_loop
from foliospark.streaming.watch import ledger_sink, recent, sessions, status_counts, tumbling


@query(
    "q_event_windows",
    "SELECT time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
)
def q_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tumbling(table(spark, sf_dir, "events")).select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query(
    "q_event_sliding",
    """
    SELECT s AS start, event_type, count(*) AS n, round(sum(value), 4) AS total
    FROM (SELECT time_bucket(INTERVAL '30 minutes', ts, TIMESTAMP '1970-01-01') - INTERVAL '30 minutes' * k AS s, event_type, value FROM events, (VALUES (0), (1)) v(k)) GROUP BY 1, 2
    """,
)
def q_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tumbling(table(spark, sf_dir, "events"), "1 hour", slide="30 minutes").select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query(
    "q_event_sessions",
    """
    WITH e AS (SELECT user_id, ts, value, CASE WHEN ts < lag(ts) OVER w + INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS "end", count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k
    """,
)
def q_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(table(spark, sf_dir, "events")).select("user_id", "start", "end", "n", F.round("total", 4).alias("total"))


@query("q_status_counts", "SELECT event_type AS status, count(*) AS count FROM events GROUP BY 1")
def q_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status_counts(table(spark, sf_dir, "events").withColumnRenamed("event_type", "status"))


@query("q_recent", "SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 50")
def q_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recent(table(spark, sf_dir, "events"), 50, "event_id").select("event_id", "event_type")


#: Polls of the watched folder; the stream starts from a new checkpoint at RESTART.
POLLS, SERVER_FROM, RESTART = 6, 2, 3


def watched_polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, poll, mtime, size, server_ok): a file for each user, which grows with some of its events."""
    e = table(spark, sf_dir, "events")
    n = e.agg(F.max("event_id")).head()[0] + 1
    grown = F.col("event_id") % 61 == 0
    sizes = F.array(*[F.count_if(grown & (F.floor(F.col("event_id") * POLLS / n) <= p)) for p in range(POLLS)])
    each = e.groupBy("user_id").agg(sizes.alias("sizes")).select("user_id", F.posexplode("sizes").alias("poll", "k"))
    return each.select(
        F.concat(F.lit("file-"), F.col("user_id").cast("string")).alias("path"), F.col("poll").cast("long").alias("poll"),
        (F.col("k") + 100.0).alias("mtime"), (F.col("k") + 1).cast("long").alias("size"), (F.col("poll") >= SERVER_FROM).alias("server_ok"),
    )


def convert(due: DataFrame) -> DataFrame:
    """Results of the files that are due: every seventh fails, every third needs recognition."""
    u = F.regexp_extract("path", r"(\d+)$", 1).cast("long")
    return due.withColumns({"ok": u % 7 != 0, "needs_ocr": u % 3 == 0, "used_ocr": (u % 3 == 0) & F.col("server_ok")})


@query(
    "q_watch_loop",
    f"""
    WITH RECURSIVE e AS (SELECT user_id AS u, event_id, event_id * {POLLS} // (SELECT max(event_id) + 1 FROM events) AS p FROM events),
    o AS (SELECT u, r.p, count(*) FILTER (WHERE e.p <= r.p AND event_id % 61 = 0) AS k, r.p >= {SERVER_FROM} AS server FROM e, range({POLLS}) r(p) GROUP BY u, r.p),
    w AS (
        SELECT u, CAST(-1 AS BIGINT) AS p, CAST(NULL AS BIGINT) AS seen, CAST(NULL AS BIGINT) AS done, CAST(NULL AS BIGINT) AS last, FALSE AS needs, 0 AS tries, 0 AS n FROM (SELECT DISTINCT u FROM e)
        UNION ALL
        SELECT u, p, k, CASE WHEN good THEN k ELSE done END, CASE WHEN good THEN p ELSE last END, CASE WHEN good THEN u % 3 = 0 ELSE needs END,
               CASE WHEN NOT good THEN tries WHEN u % 3 = 0 THEN tries + CASE WHEN server THEN 1 ELSE 0 END ELSE 0 END, n + CASE WHEN due THEN 1 ELSE 0 END
        FROM (SELECT *, due AND u % 7 <> 0 AS good FROM (
            SELECT w.u, o.p, k, server, done, last, needs, tries, n,
                   coalesce(NOT (done = k AND NOT (server AND needs AND tries < {MOST_ATTEMPTS})), TRUE) AND coalesce(CASE WHEN o.p <> {RESTART} THEN seen END = k, FALSE) AS due
            FROM w JOIN o ON o.u = w.u AND o.p = w.p + 1)))
    SELECT 'file-' || u AS path, last AS poll, CAST(done + 100 AS DOUBLE) AS mtime, done + 1 AS size, CASE WHEN done IS NOT NULL THEN needs END AS needs_ocr, CAST(CASE WHEN done IS NOT NULL THEN tries END AS INTEGER) AS ocr_attempts, CAST(n AS BIGINT) AS conversions
    FROM w WHERE p = {POLLS - 1} AND n > 0
    """,
)
def q_watch_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From landing to ledger: a run of the stream for each poll, one of them from a new checkpoint."""
    root = work_folder(spark, "watch")
    held = stored(watched_polls(spark, sf_dir), "watched-polls")
    for p in range(POLLS):
        half = "first" if p < RESTART else "second"
        held.where(F.col("poll") == p).write.parquet(f"{root}/{half}/{p}")
        polls = spark.readStream.schema(POLL).parquet(f"{root}/{half}/*")
        watch_loop(spark, polls, convert, root, "sig", state=f"state-{half}").awaitTermination()
    ledger = LedgerTable(spark, f"{root}/ledger").read().select("path", "poll", "mtime", "size", "needs_ocr", "ocr_attempts")
    made = spark.read.schema(RESULT).parquet(f"{root}/results/*/*").groupBy("path").agg(F.count("*").alias("conversions"))
    return made.join(ledger, "path", "left")


@query("q_ledger_table", "SELECT CAST(user_id AS VARCHAR) AS path, max(event_id) AS seq, arg_max(event_type, event_id) AS status FROM events GROUP BY user_id")
def q_ledger_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a path, whatever the order of batches, replays and a stream that starts again from a new checkpoint."""
    root = work_folder(spark, "ledger-table")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("path"), F.col("event_id").alias("seq"), F.col("event_type").alias("status"))
    save = ledger_sink(f"{root}/ledger", "path", "seq")

    def twice(batch: DataFrame, epoch: int) -> None:
        save(batch, epoch)
        save(batch, epoch)

    for part in (3, 0, 2, 1):  # later events first
        rows.where(F.col("seq") % 4 == part).write.mode("append").parquet(f"{root}/in")
        for state in ("state", "state-new") if part == 2 else ("state",):
            stream = spark.readStream.schema(rows.schema).parquet(f"{root}/in")
            stream.writeStream.foreachBatch(twice).option("checkpointLocation", f"{root}/{state}").trigger(availableNow=True).start().awaitTermination()
    return LedgerTable(spark, f"{root}/ledger").read()
