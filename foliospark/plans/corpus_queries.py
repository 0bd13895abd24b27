"""Queries over corpora: manifests, dedup, sampling, page picks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators.corpus import deduped_inputs, eligible_page, finished_shards, first_wins, layout_guess, page_runs, round_robin, unique_ids, validated
from foliospark.operators.evaluate import counts
from foliospark.plans.registry import query, table

_KINDS = ("pdf", "html", "docx", "exe", "png")


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as rows of a manifest; some of them faulty."""
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("doc_id") % 5 + 1).cast("int"))
    truth = F.element_at(F.array(*map(F.lit, "ABCDX")), (F.col("doc_id") % 7 % 5 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("id"), "doc_id", kind.alias("format"), truth.alias("truth_type"), "lang", "source", (F.col("n_chars") * 500).alias("size"), (F.col("doc_id") % 40).cast("int").alias("pages"), F.md5(F.col("text").cast("binary")).alias("sha256"), F.col("doc_id").alias("ord"),
    )


_MANIFEST = """
    SELECT CAST(doc_id AS VARCHAR) AS id, doc_id, ['pdf', 'html', 'docx', 'exe', 'png'][doc_id % 5 + 1] AS format, ['A', 'B', 'C', 'D', 'X'][doc_id % 7 % 5 + 1] AS truth_type,
           lang, source, n_chars * 500 AS size, CAST(doc_id % 40 AS INTEGER) AS pages, md5(text) AS sha256, doc_id AS ord FROM documents
"""
_REASON = """CASE WHEN format NOT IN ('pdf', 'scan-pdf', 'docx', 'xlsx', 'pptx', 'html', 'png', 'jpg', 'tiff') THEN 'format' WHEN truth_type NOT IN ('A', 'B', 'C', 'D') THEN 'truth type'
             WHEN size <= 0 THEN 'missing' WHEN size > 8388608 THEN 'too large' WHEN pages > 30 THEN 'too many pages' END"""


@query("q_manifest_validate", f"SELECT id, {_REASON} AS reason FROM ({_MANIFEST})")
def q_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validated(manifest(spark, sf_dir)).select("id", "reason")


@query("q_manifest_reasons", f"SELECT coalesce({_REASON}, 'ok') AS reason, count(*) AS count FROM ({_MANIFEST}) GROUP BY 1")
def q_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts(validated(manifest(spark, sf_dir)).withColumn("reason", F.coalesce("reason", F.lit("ok"))), "reason")


@query("q_distribution", "SELECT lang, source, count(*) AS count FROM documents GROUP BY lang, source")
def q_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts(table(spark, sf_dir, "documents"), "lang", "source")


@query("q_first_wins", "SELECT min(doc_id) AS doc_id, md5(text) AS sha256 FROM documents GROUP BY md5(text)")
def q_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_wins(manifest(spark, sf_dir)).select("doc_id", "sha256")


@query("q_unique_ids", "SELECT doc_id, CASE WHEN row_number() OVER w > 1 THEN source || '_' || row_number() OVER w ELSE source END AS id FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)")
def q_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unique_ids(manifest(spark, sf_dir).withColumn("id", F.col("source"))).select("doc_id", "id")


@query("q_dedupe_inputs", "SELECT source AS path, min(doc_id) AS ord FROM documents GROUP BY source")
def q_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduped_inputs(manifest(spark, sf_dir).withColumn("path", F.col("source")))


@query(
    "q_stratified",
    f"""
    SELECT id, round FROM (SELECT id, format, lang, CAST(row_number() OVER (PARTITION BY format, lang ORDER BY md5('0/' || id), id) AS INTEGER) AS round FROM ({_MANIFEST}))
    ORDER BY round, format, lang LIMIT 100
    """,
)
def q_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_robin(manifest(spark, sf_dir), "format", "lang", budget=100).select("id", "round")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.floor(F.col("doc_id") / 8).alias("doc_id"), (F.col("doc_id") % 8 + 1).cast("int").alias("page"), eligible_page(F.col("text"), F.col("doc_id") % 8 + 1, F.lit(8)).alias("eligible"))


@query(
    "q_page_runs",
    """
    WITH p AS (SELECT doc_id // 8 AS doc_id, doc_id % 8 + 1 AS page FROM documents WHERE length(text) >= 200 AND doc_id % 8 + 1 <> 1 AND len(regexp_extract_all(text, '\\.{4,}')) < 3),
    r AS (SELECT doc_id, page, lead(page, 2) OVER (PARTITION BY doc_id ORDER BY page) AS z FROM p)
    SELECT doc_id, CAST(min(page) AS INTEGER) AS first_page FROM r WHERE z = page + 2 GROUP BY doc_id
    """,
)
def q_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_runs(_pages(spark, sf_dir), 3)


@query(
    "q_layout_guess",
    """
    SELECT l_orderkey AS doc_id, CASE WHEN count(*) FILTER (WHERE l_quantity > 25) >= 4 AND count(*) FILTER (WHERE l_quantity > 25) >= 0.25 * count(*) THEN 2 ELSE 1 END AS columns
    FROM lineitem GROUP BY l_orderkey
    """,
)
def q_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return layout_guess(li.select(F.col("l_orderkey").alias("doc_id"), F.col("l_quantity").alias("x"), F.lit(50.0).alias("page_width")))


@query("q_finished_shards", f"SELECT m.id FROM ({_MANIFEST}) m WHERE m.source <> 'src0' AND EXISTS (SELECT 1 FROM documents d WHERE d.doc_id % 3 = 0 AND d.source = m.source AND md5(d.text) = m.sha256)")
def q_finished(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = manifest(spark, sf_dir).withColumn("path", F.col("source")).withColumn("truth_src", F.when(F.col("source") != "src0", F.col("source")))
    files = m.where(F.col("doc_id") % 3 == 0).select("path", "sha256")
    return finished_shards(m, files).select("id")


#: Ids of orders: customers give most, some are named like a renamed one.
_CLASH = """
    SELECT o_orderkey AS ord, CASE WHEN o_orderkey % 7 = 0 THEN 'c' || o_custkey % 20 || '_' || (2 + o_orderkey % 19) WHEN o_orderkey % 97 = 0 THEN 'c' || o_custkey % 20 || '_2_' || (2 + o_orderkey % 3)
        ELSE 'c' || o_custkey % 20 END AS id FROM orders
"""


@query(
    "q_unique_ids_clash",
    rf"""
    WITH o AS ({_CLASH}), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord) AS k FROM o),
    n AS (SELECT id, count(*) AS n FROM o GROUP BY id),
    t AS (SELECT DISTINCT regexp_extract(id, '^(.*)_([1-9][0-9]*)$', 1) AS base, CAST(regexp_extract(id, '^(.*)_([1-9][0-9]*)$', 2) AS BIGINT) AS i FROM o WHERE regexp_matches(id, '_[1-9][0-9]*$')),
    c AS (SELECT id, unnest(range(2, n + 2 + (SELECT count(*) FROM t WHERE t.base = n.id))) AS i FROM n),
    f AS (SELECT id, i, row_number() OVER (PARTITION BY id ORDER BY i) AS k FROM c WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.base = c.id AND t.i = c.i))
    SELECT ord, CASE WHEN k.k = 1 THEN k.id ELSE k.id || '_' || f.i END AS id FROM k LEFT JOIN f ON f.id = k.id AND f.k = k.k - 1
    """,
)
def q_unique_clash(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k, base = F.col("o_orderkey"), F.concat(F.lit("c"), (F.col("o_custkey") % 20).cast("string"))
    named = F.when(k % 7 == 0, F.concat(base, F.lit("_"), (2 + k % 19).cast("string"))).when(k % 97 == 0, F.concat(base, F.lit("_2_"), (2 + k % 3).cast("string"))).otherwise(base)
    return unique_ids(o.select(k.alias("ord"), named.alias("id")))
