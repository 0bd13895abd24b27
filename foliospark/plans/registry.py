"""Where queries and their reference SQL are registered, and the inputs they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Functions over literal rows and the SQL of the literal result; tests run them, they are no queries.
CASES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name``, with the SQL that gives the same rows where there is one."""

    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql_value(v: object) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (int, float)):
        return repr(v)
    if isinstance(v, list):
        return "[" + ", ".join(map(_sql_value, v)) + "]"
    return "'" + str(v).replace("'", "''") + "'"


def values_sql(columns: dict[str, str], rows: list[tuple]) -> str:
    """SQL of literal rows; ``columns`` maps names to SQL types."""
    names = ", ".join(f"c{i}" for i in range(len(columns)))
    cast = ", ".join(f"CAST(c{i} AS {t}) AS {n}" for i, (n, t) in enumerate(columns.items()))
    body = ", ".join("(" + ", ".join(map(_sql_value, r)) + ")" for r in rows)
    return f"SELECT {cast} FROM (VALUES {body}) AS v({names})"


def cases(name: str, schema: str, rows: list[tuple], columns: dict[str, str], expected: list[tuple]):
    """Note a function over literal rows whose reference is the literal result, for the tests."""

    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(spark.createDataFrame(rows, schema))

        CASES[name] = (run, values_sql(columns, expected))
        return fn

    return add


def conversation_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents of blocks: user turns are headings of levels 1 to 3."""
    is_head = F.col("role") == "user"
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("ord"), F.when(is_head, "heading").otherwise("text").alias("kind"),
        F.when(is_head, (F.col("turn") % 3 + 1).cast("int")).alias("level"), (F.floor(F.col("turn") / 4) + 1).cast("int").alias("page"), F.col("text"),
    )


CONVERSATION_BLOCKS = """
    SELECT conv_id AS doc_id, CAST(turn + 1 AS INTEGER) AS ord, CASE WHEN role = 'user' THEN 'heading' ELSE 'text' END AS kind,
           CASE WHEN role = 'user' THEN CAST(turn % 3 + 1 AS INTEGER) END AS level, CAST(turn // 4 + 1 AS INTEGER) AS page, text
    FROM conversations
"""

#: Token estimate of an SQL text expression.
TOKENS_SQL = r"(length(regexp_replace({0}, '[^\x{{4e00}}-\x{{9fff}}\x{{3000}}-\x{{303f}}]', '', 'g')) + (length(regexp_replace({0}, '[\x{{4e00}}-\x{{9fff}}\x{{3000}}-\x{{303f}}]', '', 'g')) + 3) // 4)"
