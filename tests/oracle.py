"""Compare a query with its reference SQL, run by DuckDB over the same Parquet files."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb
from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*' if os.path.isdir(path) else path}')")
    return con


def plain(v: object) -> object:
    """A value in a form that both engines give."""
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return 0.0 if v == 0 else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)) or hasattr(v, "tolist") and not isinstance(v, (str, bytes)):
        x = list(v) if isinstance(v, (list, tuple)) else v.tolist()
        return tuple(map(plain, x)) if isinstance(x, (list, tuple)) else plain(x)
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ").split("+")[0]
    return v


def rows_of(names: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def spark_rows(df: DataFrame) -> list[tuple]:
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], list[tuple]]:
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    return names, rows_of(names, got.fetchall())


def difference(spark: SparkSession, con: duckdb.DuckDBPyConnection, run, sql: str, sf_dir: str) -> str | None:
    """What differs, or None."""
    df = run(spark, sf_dir)
    names, want = duck_rows(con, sql)
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    got = spark_rows(df)
    more, less = Counter(got) - Counter(want), Counter(want) - Counter(got)
    if not more and not less:
        return None
    return f"{len(got)} rows and {len(want)}; only here {list(more)[:2]}, only there {list(less)[:2]}"
