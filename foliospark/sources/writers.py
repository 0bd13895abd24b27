"""Results out: JSON lines, JSON trees, CSV, in a folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``; on one machine without it, under the temporary folder."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        at = "file://" + os.path.join(tempfile.gettempdir(), "foliospark-work")
    return f"{at}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in a new work folder and read back, for rows that are read more than once."""
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_jsonl(rows: DataFrame, path: str, mode: str = "append") -> None:
    """One JSON object a line; a later call adds its rows to the folder."""
    rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode(mode).text(path)


def write_csv(rows: DataFrame, path: str, mode: str = "error") -> None:
    """CSV with a header in each file; quotes are doubled, as ``read_csv`` expects."""
    rows.write.mode(mode).option("header", "true").option("escape", '"').option("quoteAll", "true").csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV of ``write_csv``; fields may span lines."""
    return spark.read.schema(schema).option("header", "true").option("escape", '"').option("multiLine", "true").csv(path)


def write_trees(trees: DataFrame, path: str, key: str, tree: str = "tree", mode: str = "error") -> None:
    """(key, tree as JSON text) to one file a key, ``<path>/<key>=<value>/``.

    For trees that others read file by file. Collections of many documents go to
    ``write_jsonl``, which makes as many files as there are partitions.
    """
    trees.select(F.col(key), F.col(tree).alias("value")).repartition(key).write.mode(mode).partitionBy(key).text(path)
