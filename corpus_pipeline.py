"""A training-data pipeline in five stages, each calling one operator of foliospark.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's ``docs``. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.mixing import sampled
from foliospark.llm.ngram_join import one_of_each
from foliospark.llm.packing import pack
from foliospark.llm.quality import Limits, Rules
from foliospark.llm.shared import bounded_batches, shared_dir, write_once
from foliospark.llm.substring import SENT, remove_repeats

#: No SQL expresses BPE ids and the packing plan; tests hold the stages against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without lines too frequent in their host.

    Copies count once here: the next stage keeps one document of each group of them.
    """
    bounded_batches(spark)
    return Rules(docs, limits=Limits(copies_once=True)).cleaned()


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest id."""
    return one_of_each(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller id has are cut out."""
    out = remove_repeats(docs, sent=SENT)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample that meets the source, language and topic targets."""
    return sampled(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces and their places in sequences."""
    return pack(docs)


STAGES = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substrings),
    ("mixing", mixing),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        write_once(stage(spark, docs, sf_dir), f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
    return docs
