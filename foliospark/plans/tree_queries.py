"""Queries over structure trees: conversations as trees of headings and nested lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators.render import json_trees
from foliospark.operators.tree import flatten_tree, gather_text, text_chars, tidy_tree, tree_json, tree_page_stats, walk
from foliospark.plans.registry import query, table
from foliospark.sources.files import read_tree_lines
from foliospark.sources.parse import html_nodes
from foliospark.sources.writers import stored, work_folder, write_jsonl


def conversation_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, tree as JSON text): user turns are headings, other turns lists of their lines.

    Items are numbered or carry a bullet sign by turns and hold a paragraph; some headings are file names.
    """
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("d"), F.col("turn").alias("t"), "role", "text")
    mark = lambda k: F.when((F.col("d") + k) % 3 == 0, "• ").when((F.col("d") % 2 == 0) | (k % 2 == 1), F.concat(F.lit("("), k.cast("string"), F.lit(") "))).otherwise("")
    page = (F.floor(F.col("t") / 4) + 1).cast("int")
    none = lambda kind: F.lit(None).cast(kind)
    item = lambda s, i: F.struct(
        F.lit("list item").alias("type"), F.when((i + 1) % 2 == 1, page + 1).alias("page number"), F.concat(mark(i + 1), s).alias("content"),
        F.array(F.struct(F.lit("paragraph").alias("type"), F.left(s, F.lit(20)).alias("content"))).alias("kids"),
    )
    lines = F.split("text", "\n")
    user = F.col("role") == "user"
    node = F.struct(
        F.when(user, "heading").otherwise("list").alias("type"), F.when(user, (F.col("t") % 3 + 1).cast("int")).otherwise(none("int")).alias("heading level"), page.alias("page number"),
        F.when(user, F.when(F.col("d") % 5 == 0, "scan.pdf").otherwise(F.col("text"))).alias("content"),
        F.when(~user, F.size(lines)).alias("number of list items"), F.when(~user, F.transform(lines, item)).alias("list items"),
    )
    kids = F.transform(F.array_sort(F.collect_list(F.struct("t", node.alias("node")))), lambda x: x["node"])
    docs = c.groupBy("d").agg(F.max(page).alias("pages"), kids.alias("kids"))
    return docs.select(F.col("d").alias("doc_id"), F.to_json(F.struct(F.concat(F.lit("conv-"), F.col("d").cast("string")).alias("file name"), F.col("pages").alias("number of pages"), "kids")).alias("tree"))


def conversation_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node rows of the trees, after they were written as JSON lines and read back without a schema."""
    path = work_folder(spark, "conversation-trees")
    write_jsonl(conversation_trees(spark, sf_dir).select("doc_id", F.parse_json("tree").alias("tree")), path)
    return stored(walk(read_tree_lines(spark, path)), "conversation-nodes")


# Nodes (d, t, k, j, depth, ...) of the trees from the table: k is the item, j tells a list (0), an item (1) and what is in it (2).
_NODES = """
    c AS (SELECT conv_id AS d, turn AS t, role, text, CAST(turn // 4 + 1 AS INTEGER) AS page FROM conversations),
    s AS (SELECT d, t, page, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM c WHERE role <> 'user'),
    i AS (SELECT d, t, k, s, page, CASE WHEN k % 2 = 1 THEN page + 1 END AS own, CASE WHEN (d + k) % 3 = 0 THEN '• ' WHEN d % 2 = 0 OR k % 2 = 1 THEN '(' || k || ') ' ELSE '' END || s AS content FROM s),
    h AS (SELECT d, t, CAST(t % 3 + 1 AS INTEGER) AS level, page, CASE WHEN d % 5 = 0 THEN 'scan.pdf' ELSE text END AS content FROM c WHERE role = 'user'),
    n AS (
        SELECT DISTINCT d, CAST(-1 AS BIGINT) AS t, 0 AS k, 0 AS j, 0 AS depth, '' AS slot, CAST(NULL AS VARCHAR) AS type, CAST(NULL AS INTEGER) AS level, CAST(NULL AS INTEGER) AS page, CAST(NULL AS VARCHAR) AS content FROM c
        UNION ALL SELECT d, t, 0, 0, 1, 'kids', 'heading', level, page, content FROM h
        UNION ALL SELECT DISTINCT d, t, 0, 0, 1, 'kids', 'list', NULL, page, NULL FROM i
        UNION ALL SELECT d, t, k, 1, 2, 'list items', 'list item', NULL, own, content FROM i
        UNION ALL SELECT d, t, k, 2, 3, 'kids', 'paragraph', NULL, NULL, left(s, 20) FROM i)
"""
# The nodes after tidying: lists with two numbered items, one of them long, are cut.
_TIDY = r"""
    b AS (SELECT *, regexp_replace(content, '^•[ ]+(\S)', '\1') AS body FROM i),
    f AS (SELECT *, regexp_matches(trim(body), '^\(\s*\d{1,3}\s*\)\s') AS num FROM b),
    u AS (SELECT *, count(*) FILTER (WHERE num) OVER l >= 2 AND count(*) FILTER (WHERE num AND length(trim(body)) > 80) OVER l >= 1 AS cut FROM f WINDOW l AS (PARTITION BY d, t)),
    r AS (SELECT *, count(*) FILTER (WHERE cut AND num) OVER (PARTITION BY d, t ORDER BY k) AS run FROM u),
    m AS (
        SELECT d, t, k, j, depth, slot, CASE WHEN type = 'heading' AND content = 'scan.pdf' THEN 'paragraph' ELSE type END AS type, CASE WHEN content = 'scan.pdf' THEN NULL ELSE level END AS level, page, content
        FROM n WHERE depth < 2 AND NOT EXISTS (SELECT 1 FROM r WHERE cut AND r.d = n.d AND r.t = n.t)
        UNION ALL SELECT d, t, min(k), 0, 1, 'kids', 'list', NULL, min(page), NULL FROM r WHERE cut AND NOT num GROUP BY d, t, run
        UNION ALL SELECT d, t, k, 1, CASE WHEN cut AND num THEN 1 ELSE 2 END, CASE WHEN cut AND num THEN 'kids' ELSE 'list items' END, CASE WHEN cut AND num THEN 'paragraph' ELSE 'list item' END,
                         NULL, CASE WHEN cut AND num THEN coalesce(own, page) ELSE own END, body FROM r
        UNION ALL SELECT d, t, k, 2, CASE WHEN cut AND num THEN 2 ELSE 3 END, 'kids', 'paragraph', NULL, NULL, left(s, 20) FROM r)
"""


def _placed(nodes: str) -> str:
    """Places and intervals of nodes that have a depth and an order."""
    return f"""
    p AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY t, k, j) - 1 AS pre FROM {nodes}),
    q AS (SELECT *, coalesce((SELECT min(y.pre) FROM p y WHERE y.d = p.d AND y.pre > p.pre AND y.depth <= p.depth), (SELECT max(y.pre) + 1 FROM p y WHERE y.d = p.d)) - 1 AS upto,
          (SELECT max(y.pre) FROM p y WHERE y.d = p.d AND y.pre < p.pre AND y.depth = p.depth - 1) AS parent FROM p)
    """


_ROW = "SELECT d AS doc_id, CAST(pre AS INTEGER) AS pre, CAST(upto AS INTEGER) AS upto, CAST(parent AS INTEGER) AS parent, CAST(depth AS INTEGER) AS depth, slot, type, level, page, content FROM q"
_COLS = ("doc_id", "pre", "upto", "parent", "depth", "slot", "type", "level", "page", "content")


@query("q_tree_walk", f"WITH {_NODES}, {_placed('n')} {_ROW}")
def q_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_nodes(spark, sf_dir).select(*_COLS)


@query("q_tree_tidy", f"WITH {_NODES}, {_TIDY}, {_placed('m')} {_ROW}")
def q_tidy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy_tree(conversation_nodes(spark, sf_dir)).select(*_COLS)


@query(
    "q_tree_json",
    f"""
    WITH {_NODES},
    l AS (SELECT d, t, '{{"number of list items":' || count(*) || ',"page number":' || min(page) || ',"type":"list","list items":[' ||
            string_agg('{{"content":' || CAST(to_json(content) AS VARCHAR) || CASE WHEN own IS NULL THEN '' ELSE ',"page number":' || own END || ',"type":"list item","kids":[{{"content":' || CAST(to_json(left(s, 20)) AS VARCHAR) || ',"type":"paragraph"}}]}}', ',' ORDER BY k) || ']}}' AS x
          FROM i GROUP BY d, t
          UNION ALL SELECT d, t, '{{"content":' || CAST(to_json(content) AS VARCHAR) || ',"heading level":' || level || ',"page number":' || page || ',"type":"heading"}}' FROM h)
    SELECT l.d AS doc_id, '{{"file name":"conv-' || l.d || '","number of pages":' || max(c.page) || ',"kids":[' || string_agg(x, ',' ORDER BY t) || ']}}' AS tree
    FROM l JOIN (SELECT d, max(page) AS page FROM c GROUP BY d) c ON c.d = l.d GROUP BY l.d
    """,
)
def q_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_json(conversation_nodes(spark, sf_dir))


@query(
    "q_tree_blocks",
    f"""
    WITH {_NODES},
    b AS (SELECT d, t, 0 AS k, 'heading' AS kind, level, page, trim(content) AS text FROM h UNION ALL SELECT d, t, k, 'text', NULL, coalesce(own, page), '- ' || trim(content) FROM i WHERE trim(content) <> '')
    SELECT d AS doc_id, CAST(row_number() OVER (PARTITION BY d ORDER BY t, k) AS INTEGER) AS ord, kind, level, page, text FROM b WHERE text <> ''
    """,
)
def q_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten_tree(conversation_nodes(spark, sf_dir))


@query("q_tree_page_stats", f"WITH {_NODES} SELECT d AS doc_id, page, CAST(count(*) AS INTEGER) AS elements, CAST(sum(coalesce(length(trim(content)), 0)) AS INTEGER) AS chars FROM n WHERE type IS NOT NULL AND page IS NOT NULL GROUP BY d, page")
def q_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_page_stats(conversation_nodes(spark, sf_dir))


@query(
    "q_tree_text",
    f"""
    WITH {_NODES}, {_placed('n')}
    SELECT a.d AS doc_id, CAST(a.pre AS INTEGER) AS of, coalesce(string_agg(trim(b.content), ' ' ORDER BY b.pre) FILTER (WHERE trim(b.content) <> ''), '') AS text
    FROM q a JOIN q b ON a.d = b.d AND b.pre BETWEEN a.pre AND a.upto WHERE a.depth IN (1, 2) GROUP BY a.d, a.pre
    """,
)
def q_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = conversation_nodes(spark, sf_dir)
    return gather_text(n, n.where(F.col("depth").isin(1, 2)))


@query("q_tree_chars", rf"WITH {_NODES} SELECT d AS doc_id, CAST(sum(coalesce(length(regexp_replace(content, '[^\p{{L}}\p{{N}}]', '', 'g')), 0)) AS BIGINT) AS chars FROM n GROUP BY d")
def q_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_chars(conversation_nodes(spark, sf_dir))


@query("q_page_trees")
def q_page_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node rows of all pages after their trees were written and walked; a test holds them against the parsed nodes."""
    path = work_folder(spark, "page-trees")
    trees = json_trees(html_nodes(table(spark, sf_dir, "pages")))
    write_jsonl(trees.select("doc_id", F.parse_json("tree").alias("tree")), path)
    return walk(read_tree_lines(spark, path)).select(*_COLS)
