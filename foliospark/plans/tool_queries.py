"""Queries through the SQL table functions, and engines run over documents."""

from __future__ import annotations

import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions.tables import register
from foliospark.operators.blocks import line_blocks
from foliospark.operators.runner import Engine, run_engines
from foliospark.plans import structure_queries  # noqa: F401  registers the SQL that two ways of asking share
from foliospark.plans.registry import ORACLES, conversation_blocks, query, table


@query("q_sql_outline", ORACLES["q_outline"])
def q_sql_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark)
    return spark.sql("SELECT * FROM doc_outline(TABLE({blocks}))", blocks=conversation_blocks(spark, sf_dir))


@query("q_sql_section", ORACLES["q_section_text"])
def q_sql_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark)
    return spark.sql("SELECT * FROM doc_section(TABLE({blocks}), 'the')", blocks=conversation_blocks(spark, sf_dir))


@query("q_sql_search", ORACLES["q_search_topk"])
def q_sql_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark)
    sql = "SELECT doc_id, ord, score FROM doc_hits(TABLE({blocks}), 'the of') ORDER BY score DESC, doc_id, ord LIMIT 50"
    return spark.sql(sql, blocks=line_blocks(table(spark, sf_dir, "documents")))


@query("q_sql_chunks")
def q_sql_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark)
    return spark.sql("SELECT * FROM doc_chunks(TABLE({blocks}), 400)", blocks=conversation_blocks(spark, sf_dir))


def fragile(kind: str, text: str) -> str | None:
    """An engine that upper-cases, and does what it should not on some texts."""
    n = len(text)
    if n % 7 == 1:
        raise ValueError("bad text")
    if n % 67 == 2:
        time.sleep(60)
    if n % 31 == 3:
        os._exit(9)
    if n % 53 == 4:
        return str(len(bytearray(1 << 30)))
    return text.upper()


@query(
    "q_run_engines",
    """
    WITH d AS (SELECT doc_id, coalesce(lang, 'und') AS format, length(text) AS n FROM documents)
    SELECT CAST(doc_id AS VARCHAR) AS id, 'fragile' AS engine,
           CASE WHEN format NOT IN ('en', 'de', 'fr') THEN 'unsupported' WHEN n % 7 = 1 THEN 'fail' WHEN n % 67 = 2 THEN 'timeout' WHEN n % 31 = 3 OR n % 53 = 4 OR n = 0 THEN 'fail' ELSE 'ok' END AS status FROM d
    UNION ALL SELECT CAST(doc_id AS VARCHAR), 'plain', CASE WHEN format = 'en' AND n > 0 THEN 'ok' WHEN format = 'en' THEN 'fail' ELSE 'unsupported' END FROM d WHERE doc_id % 2 = 1
    """,
)
def q_run_engines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two engines over all documents, one of which hangs, crashes and takes too much memory; half of the other's work is done already."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("und")).alias("format"), "text")
    engines = [Engine("fragile", fragile, ("en", "de", "fr"), seconds=1.0, memory_mb=256), Engine("plain", lambda kind, text: text, ("en",))]
    done = d.where(F.pmod("doc_id", F.lit(2)) == 0).select(F.lit("plain").alias("engine"), F.col("doc_id").cast("string").alias("id"))
    return run_engines(d.repartition(spark.sparkContext.defaultParallelism), engines, done, id_col="doc_id", content="text").select("id", "engine", "status")
