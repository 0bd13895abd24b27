"""Queries over evaluation results; line items stand in for scored documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions.metrics import kendall
from foliospark.operators.evaluate import by_channel, common_ids, digit_dense, grouped_report, on_common, pairwise, rescored_delta, score, summarise, times, to_retry, truths_from_blocks, worst
from foliospark.operators.render import render_markdown
from foliospark.plans.registry import query, table
from foliospark.sources.parse import html_nodes


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each (engine, document): engines are ship modes of a line number."""
    li = table(spark, sf_dir, "lineitem")
    k = F.col("l_partkey")
    pick = lambda names, c: F.element_at(F.array(*map(F.lit, names)), (c % len(names) + 1).cast("int"))
    return li.select(
        F.col("l_orderkey").cast("string").alias("id"), F.concat(F.lit("e"), F.col("l_linenumber").cast("string")).alias("engine"), pick(("pdf", "html", "png", "scan-pdf"), F.col("l_orderkey")).alias("format"),
        pick(("en", "de", "zh"), F.col("l_orderkey")).alias("lang"), pick(("law", "web"), F.col("l_orderkey")).alias("domain"), pick(("A", "B"), F.col("l_orderkey")).alias("truth_type"),
        pick(("ok", "ok", "ok", "degraded", "fail", "timeout", "unsupported"), k).alias("status"), F.col("l_quantity").alias("wall_s"), (k % 101 / 100).alias("char_sim"), F.col("l_discount").alias("cer"),
        F.when(k % 3 == 0, F.col("l_tax")).alias("heading_f1"), (k % 60).cast("int").alias("digit_n_truth"),
    )


_R = """
    SELECT CAST(l_orderkey AS VARCHAR) AS id, 'e' || l_linenumber AS engine, ['pdf', 'html', 'png', 'scan-pdf'][l_orderkey % 4 + 1] AS format, ['en', 'de', 'zh'][l_orderkey % 3 + 1] AS lang,
           ['law', 'web'][l_orderkey % 2 + 1] AS domain, ['A', 'B'][l_orderkey % 2 + 1] AS truth_type, ['ok', 'ok', 'ok', 'degraded', 'fail', 'timeout', 'unsupported'][l_partkey % 7 + 1] AS status,
           l_quantity AS wall_s, CAST(l_partkey % 101 AS DOUBLE) / 100 AS char_sim, l_discount AS cer, CASE WHEN l_partkey % 3 = 0 THEN l_tax END AS heading_f1, CAST(l_partkey % 60 AS INTEGER) AS digit_n_truth FROM lineitem
"""
_DONE = "status IN ('ok', 'degraded')"
_SUMMARY = f"""count(*) AS n, round(100.0 * count(*) FILTER (WHERE {_DONE}) / count(*), 6) AS ok_percent, count(*) FILTER (WHERE status = 'degraded') AS n_degraded,
    round(avg(char_sim) FILTER (WHERE {_DONE}), 6) AS char_sim, round(avg(heading_f1) FILTER (WHERE {_DONE}), 6) AS heading_f1, round(quantile_cont(wall_s, 0.5), 6) AS median_s,
    round(CASE WHEN count(wall_s) >= 20 THEN list_sort(list(wall_s))[greatest(CAST(floor(count(wall_s) * 0.95) AS BIGINT), 1)] ELSE max(wall_s) END, 1) AS p95_s"""


def _rounded(df: DataFrame, *keys: str) -> DataFrame:
    six = [F.round(c, 6).alias(c) for c in ("ok_percent", "char_sim", "heading_f1", "median_s")]
    return df.select(*keys, "n", "n_degraded", "p95_s", *six)


@query("q_report_summary", f"SELECT engine, {_SUMMARY} FROM ({_R}) GROUP BY engine")
def q_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(summarise(results(spark, sf_dir), "engine"), "engine")


@query(
    "q_report_channels",
    f"SELECT engine, CASE WHEN format IN ('scan-pdf', 'jpg', 'png', 'tiff') THEN 'ocr' ELSE 'text-layer' END AS channel, {_SUMMARY} FROM ({_R}) GROUP BY 1, 2",
)
def q_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(by_channel(results(spark, sf_dir)), "engine", "channel")


@query(
    "q_report_grouping_sets",
    f"""
    SELECT engine, format, lang, domain, truth_type, count(*) AS n, count(*) FILTER (WHERE {_DONE}) AS n_done, round(avg(char_sim) FILTER (WHERE {_DONE}), 6) AS char_sim, round(quantile_cont(wall_s, 0.5), 6) AS median_s,
           CASE WHEN grouping(format) = 0 THEN 'format' WHEN grouping(lang) = 0 THEN 'lang' WHEN grouping(domain) = 0 THEN 'domain' WHEN grouping(truth_type) = 0 THEN 'truth_type' ELSE 'all' END AS dimension
    FROM ({_R}) GROUP BY GROUPING SETS ((engine), (engine, format), (engine, lang), (engine, domain), (engine, truth_type))
    """,
)
def q_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grouped_report(results(spark, sf_dir))
    return g.select("engine", "format", "lang", "domain", "truth_type", "n", "n_done", F.round("char_sim", 6).alias("char_sim"), F.round("median_s", 6).alias("median_s"), "dimension")


_COMMON = f"SELECT id FROM ({_R}) WHERE {_DONE} GROUP BY id HAVING count(DISTINCT engine) = (SELECT count(DISTINCT engine) FROM ({_R}))"


@query("q_common_subset", _COMMON)
def q_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    return common_ids(results(spark, sf_dir))


@query("q_on_common", f"SELECT engine, count(*) AS n FROM ({_R}) WHERE id IN ({_COMMON}) GROUP BY engine")
def q_on_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on_common(results(spark, sf_dir)).groupBy("engine").agg(F.count("*").alias("n"))


@query(
    "q_pairwise",
    f"""
    WITH d AS (SELECT * FROM ({_R}) WHERE {_DONE})
    SELECT a.engine, count(*) AS n, round(avg(a.char_sim), 6) AS char_sim, round(avg(b.char_sim), 6) AS base_char_sim, round(quantile_cont(a.wall_s, 0.5), 6) AS median_s
    FROM d a JOIN d b ON a.id = b.id AND b.engine = 'e1' WHERE a.engine <> 'e1' GROUP BY a.engine
    """,
)
def q_pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairwise(results(spark, sf_dir), "e1")
    return p.select("engine", "n", *[F.round(c, 6).alias(c) for c in ("char_sim", "base_char_sim", "median_s")])


@query("q_worst_n", f"SELECT id, engine, char_sim FROM ({_R}) WHERE engine = 'e1' AND char_sim IS NOT NULL ORDER BY char_sim, id LIMIT 30")
def q_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return worst(results(spark, sf_dir).where("engine = 'e1'")).select("id", "engine", "char_sim")


@query("q_distinct_docs", f"SELECT format, count(DISTINCT id) AS n FROM ({_R}) GROUP BY format")
def q_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(spark, sf_dir).groupBy("format").agg(F.count_distinct("id").alias("n"))


@query(
    "q_digit_dense",
    f"SELECT id, engine FROM ({_R}) r WHERE id IN (SELECT id FROM ({_R}) WHERE digit_n_truth >= 30) AND id NOT IN (SELECT CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderstatus = 'P')",
)
def q_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    truths = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.when(F.col("o_orderstatus") == "P", F.create_map(F.lit("math_stripped"), F.lit("true"))).alias("note"))
    return digit_dense(results(spark, sf_dir), truths).select("id", "engine")


@query("q_retry", f"SELECT engine, count(*) AS n, CAST(count(DISTINCT id) AS INTEGER) AS n_ids FROM ({_R}) WHERE status IN ('fail', 'timeout') GROUP BY engine")
def q_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_retry(results(spark, sf_dir)).select("engine", "n", F.size("ids").alias("n_ids"))


@query(
    "q_rescore_delta",
    """
    WITH r AS (SELECT CAST(o_custkey % 101 AS DOUBLE) / 100 AS was, CAST(o_custkey % 101 AS DOUBLE) / 200 + 0.25 AS now FROM orders)
    SELECT count(*) AS n, round(avg(now - was), 6) AS mean_change, round(max(abs(now - was)), 6) AS largest_change FROM r
    """,
)
def q_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("engine"), F.col("o_orderkey").cast("string").alias("id"), (F.col("o_custkey") % 101 / 100).alias("char_sim"))
    d = rescored_delta(r, r.withColumn("char_sim", F.col("char_sim") * 0.5 + 0.25))
    return d.select("n", F.round("mean_change", 6).alias("mean_change"), F.round("largest_change", 6).alias("largest_change"))


@query(
    "q_cell_f1",
    """
    WITH p AS (SELECT l_orderkey AS doc_id, CAST(l_quantity AS INTEGER) AS cell, count(*) AS n FROM lineitem GROUP BY 1, 2),
    t AS (SELECT l_orderkey AS doc_id, CAST(floor(l_quantity * 1.02) AS INTEGER) AS cell, count(*) AS n FROM lineitem GROUP BY 1, 2),
    j AS (SELECT coalesce(p.doc_id, t.doc_id) AS doc_id, sum(least(coalesce(p.n, 0), coalesce(t.n, 0))) AS tp, sum(coalesce(p.n, 0)) AS np, sum(coalesce(t.n, 0)) AS nt FROM p FULL JOIN t ON p.doc_id = t.doc_id AND p.cell = t.cell GROUP BY 1)
    SELECT doc_id, round(2.0 * tp / (np + nt), 6) AS f1 FROM j
    """,
)
def q_cell_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiset F score by counts on both sides, found in one pass: linear in the cells, not in their pairs."""
    side = lambda cell, p, t: F.struct(cell.cast("int").alias("cell"), F.lit(p).alias("p"), F.lit(t).alias("t"))
    cells = F.explode(F.array(side(F.col("l_quantity"), 1, 0), side(F.floor(F.col("l_quantity") * 1.02), 0, 1)))
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), cells.alias("c"))
    both = li.groupBy("doc_id", F.col("c.cell").alias("cell")).agg(F.sum("c.p").alias("n_p"), F.sum("c.t").alias("n_t"))
    s = both.groupBy("doc_id").agg(F.sum(F.when(F.col("cell").isNotNull(), F.least("n_p", "n_t")).otherwise(0)).alias("tp"), F.sum("n_p").alias("np"), F.sum("n_t").alias("nt"))
    return s.select("doc_id", F.round(2 * F.col("tp") / (F.col("np") + F.col("nt")), 6).alias("f1"))


@query(
    "q_order_tau",
    """
    SELECT a.conv_id, round(CAST(sum(sign(length(b.text) - length(a.text))) AS DOUBLE) / nullif(sum(abs(sign(length(b.text) - length(a.text)))), 0), 6) AS tau
    FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn < b.turn GROUP BY a.conv_id
    """,
)
def q_tau(spark: SparkSession, sf_dir: str) -> DataFrame:
    xs = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.length("text").alias("n")))), lambda x: x["n"]).alias("xs"))
    ties = F.size(F.array_distinct("xs")) == 1
    return xs.where(F.size("xs") > 1).select("conv_id", F.when(~ties, F.round(kendall(F.col("xs")), 6)).alias("tau"))


@query("q_score_documents")
def q_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown of pages scored against the heading and text that their articles hold."""
    # dealt out once, by page: texts are small for what their metrics take, so tasks are not put together by size
    nodes = html_nodes(table(spark, sf_dir, "pages")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    md = render_markdown(nodes).select(F.col("doc_id").alias("id"), F.lit("own").alias("engine"), F.col("text").alias("markdown"))
    truth = nodes.where("type in ('heading', 'paragraph')").select("doc_id", "ord", F.col("type").alias("kind"), "level", F.col("content").alias("text"), "grid")
    t = truths_from_blocks(truth).withColumnRenamed("doc_id", "id")
    return score(md, t).drop("markdown").withColumn("id", F.col("id").cast("string"))


@query(
    "q_order_statistics",
    """
    SELECT 'all' AS flag, round(quantile_cont(l_extendedprice, 0.5), 6) AS median_s, round(list_sort(list(l_extendedprice))[CAST(floor(count(*) * 0.95) AS BIGINT)], 1) AS p95_s FROM lineitem
    UNION ALL SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 6), round(list_sort(list(l_extendedprice))[CAST(floor(count(*) * 0.95) AS BIGINT)], 1) FROM lineitem GROUP BY l_returnflag
    """,
)
def q_order_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact median and 95th percentile of one group of all rows, and of three groups."""
    li = table(spark, sf_dir, "lineitem")
    whole = times(li, (), "l_extendedprice").select(F.lit("all").alias("flag"), "median_s", "p95_s")
    each = times(li, ("l_returnflag",), "l_extendedprice").withColumnRenamed("l_returnflag", "flag")
    return whole.unionByName(each).withColumn("median_s", F.round("median_s", 6))
