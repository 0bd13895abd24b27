"""Queries that put single functions and renderings to work over whole tables.

Where a table lacks a case (bullet signs, file names as headings, wide characters), it is
made of the table's own values, the same way in the query and in its SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import text as X
from foliospark.functions.metrics import cell_f1, heading_score, number_stats
from foliospark.operators.blocks import flatten
from foliospark.operators.qa import empty_image, needs_ocr
from foliospark.operators.render import csv_lines, render_html, render_markdown, render_text
from foliospark.plans.registry import query, table


def flat_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as flat nodes: headings, lists of lines, tables of two columns."""
    c = table(spark, sf_dir, "conversations")
    t, user, rows = F.col("turn"), F.col("role") == "user", F.col("turn") % 4 == 3
    lines = F.split("text", "\n")
    return c.select(
        F.col("conv_id").alias("doc_id"), t.cast("int").alias("ord"), F.when(user, "heading").when(rows, "table").otherwise("list").alias("type"),
        F.when(user, (t % 3 + 1).cast("int")).alias("level"), (F.floor(t / 4) + 1).cast("int").alias("page"), F.when(user, F.replace("text", F.lit("\n"), F.lit(" "))).alias("content"),
        F.when(~user & ~rows, lines).alias("items"), F.when(~user & rows, F.transform(lines, lambda x: F.array(F.left(x, F.lit(10)), F.concat(F.lit('a|b, "'), F.substring(x, F.lit(11), F.lit(9)))))).alias("grid"),
    )


_FLAT = """
    v AS (SELECT conv_id AS d, turn AS t, role = 'user' AS u, turn % 4 = 3 AS r, CAST(turn % 3 + 1 AS INTEGER) AS level, CAST(turn // 4 + 1 AS INTEGER) AS page, replace(text, chr(10), ' ') AS content, string_split(text, chr(10)) AS l FROM conversations),
    g AS (SELECT *, CASE WHEN NOT u AND r THEN list_transform(l, lambda x: [left(x, 10), 'a|b, "' || substr(x, 11, 9)]) END AS grid FROM v),
    k AS (SELECT *, lag(page) OVER (PARTITION BY d ORDER BY t) <> page AS turned,
          array_to_string(list_transform(grid, lambda x: '| ' || replace(x[1], '|', '\\|') || ' | ' || replace(x[2], '|', '\\|') || ' |'), chr(10)) AS m FROM g)
"""


def _rendered(head: str, mark: str) -> str:
    body = f"CASE WHEN u THEN {head} WHEN r THEN regexp_replace(m, '^([^\\n]*)', '\\1' || chr(10) || '| --- | --- |') ELSE array_to_string(list_transform(l, lambda x: '- ' || x), chr(10)) END"
    piece = f"CASE WHEN turned THEN '{mark}' || chr(10) || chr(10) || {body} ELSE {body} END" if mark else body
    return f"WITH {_FLAT} SELECT d AS doc_id, string_agg({piece}, chr(10) || chr(10) ORDER BY t) || chr(10) AS text FROM k GROUP BY d".replace("\\\\", "\\")


@query("q_flat_markdown", _rendered("repeat('#', level) || ' ' || content", "---"))
def q_flat_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render_markdown(flat_nodes(spark, sf_dir), "---")


@query("q_flat_text", _rendered("content", ""))
def q_flat_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render_text(flat_nodes(spark, sf_dir))


_ESCAPED = """replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')"""


@query(
    "q_flat_html",
    f"""
    WITH {_FLAT.replace(chr(92) * 2, chr(92))},
    p AS (SELECT d, t, CASE WHEN u THEN '<h' || level || '>' || {_ESCAPED.format('content')} || '</h' || level || '>'
        WHEN r THEN '<table>' || array_to_string(list_transform(grid, lambda x: '<tr><td>' || {_ESCAPED.format('x[1]')} || '</td><td>' || {_ESCAPED.format('x[2]')} || '</td></tr>'), chr(10)) || '</table>'
        ELSE '<ul>' || array_to_string(list_transform(l, lambda x: '<li>' || {_ESCAPED.format('x')} || '</li>'), '') || '</ul>' END AS piece FROM k)
    SELECT d AS doc_id, '<!DOCTYPE html>' || chr(10) || '<html><head><meta charset="utf-8"><title></title></head><body>' || chr(10) || string_agg(piece, chr(10) ORDER BY t) || chr(10) || '</body></html>' || chr(10) AS text FROM p GROUP BY d
    """,
)
def q_flat_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render_html(flat_nodes(spark, sf_dir))


@query(
    "q_flat_csv",
    f"""
    WITH {_FLAT.replace(chr(92) * 2, chr(92))}, n AS (SELECT *, dense_rank() OVER (PARTITION BY d ORDER BY t) AS nr FROM k WHERE grid IS NOT NULL),
    x AS (SELECT d, nr, page, unnest(grid) AS c, generate_subscripts(grid, 1) AS r FROM n)
    SELECT d AS doc_id, CAST(nr AS INTEGER) AS "table", page, CAST(r AS INTEGER) AS r, (CASE WHEN regexp_matches(c[1], '[",]') THEN '"' || replace(c[1], '"', '""') || '"' ELSE c[1] END) || ',"' || replace(c[2], '"', '""') || '"' AS line FROM x
    """,
)
def q_flat_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return csv_lines(flat_nodes(spark, sf_dir))


@query(
    "q_flat_blocks",
    rf"""
    WITH {_FLAT.replace(chr(92) * 2, chr(92))},
    b AS (SELECT d, t, 0 AS k, 'heading' AS kind, level, page, trim(content) AS text FROM k WHERE u
          UNION ALL SELECT d, t, 0, 'table', NULL, page, regexp_replace(m, '^([^\n]*)', '\1' || chr(10) || '| --- | --- |') FROM k WHERE grid IS NOT NULL
          UNION ALL SELECT d, t, generate_subscripts(l, 1), 'text', NULL, page, '- ' || trim(unnest(l)) FROM k WHERE NOT u AND NOT r)
    SELECT d AS doc_id, CAST(row_number() OVER (PARTITION BY d ORDER BY t, k) AS INTEGER) AS ord, kind, level, page, text FROM b WHERE text NOT IN ('', '- ')
    """,
)
def q_flat_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten(flat_nodes(spark, sf_dir))


@query(
    "q_bullet_lines",
    rf"""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents),
    m AS (SELECT doc_id, k, CASE k % 4 WHEN 0 THEN '• ' WHEN 1 THEN '▪◦ ' WHEN 2 THEN '•' ELSE '' END || s AS s FROM l)
    SELECT doc_id, CAST(k AS INTEGER) AS k, regexp_replace(s, '^[{X.BULLETS}]+[ \t\x{{a0}}]+([^\s\x{{a0}}])', '\1') AS text FROM m
    """,
)
def q_bullet_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "s")).withColumn("k", F.col("p") + 1)  # noqa: E741
    mark = F.when(F.col("k") % 4 == 0, "• ").when(F.col("k") % 4 == 1, "▪◦ ").when(F.col("k") % 4 == 2, "•").otherwise("")
    return l.select("doc_id", "k", X.strip_list_bullet(F.concat(mark, "s")).alias("text"))


@query(
    "q_list_flags",
    r"""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents),
    m AS (SELECT doc_id, k, trim(CASE WHEN k % 2 = 1 THEN '(' || k || ') ' ELSE '' END || s, ' ' || chr(9) || chr(10) || chr(13)) AS s FROM l),
    n AS (SELECT *, regexp_matches(s, '^\(\s*\d{1,3}\s*\)\s') AS num FROM m)
    SELECT doc_id, list(num AND c >= 2 AND g ORDER BY k) AS flags FROM (SELECT *, count(*) FILTER (WHERE num) OVER w AS c, coalesce(bool_or(num AND length(s) > 80) OVER w, FALSE) AS g FROM n WINDOW w AS (PARTITION BY doc_id)) GROUP BY doc_id
    """,
)
def q_list_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("items", F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.when(i % 2 == 0, F.concat(F.lit("("), (i + 1).cast("string"), F.lit(") "))).otherwise(""), x)))
    return d.select("doc_id", X.list_paragraph_flags("items").alias("flags"))


@query(
    "q_noise_titles",
    f"""
    WITH t AS (SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN 'scan_' || conv_id || '.PDF' WHEN 1 THEN ' Must  not ' WHEN 2 THEN left(text, 1) WHEN 3 THEN '章' ELSE left(text, 30) END AS s FROM conversations),
    q AS (SELECT *, trim(regexp_replace(s, '\\s+', ' ', 'g')) AS f FROM t)
    SELECT conv_id, turn, (length(f) = 1 AND f <> '章') OR upper(f) IN {X.REQUIREMENT_WORDS} OR regexp_matches(f, '{X.FILE_NAME}') AS noise FROM q
    """,
)
def q_noise_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, own = F.col("turn") % 5, F.col("text")
    s = F.when(t == 0, F.concat(F.lit("scan_"), F.col("conv_id").cast("string"), F.lit(".PDF"))).when(t == 1, " Must  not ").when(t == 2, F.left(own, F.lit(1))).when(t == 3, "章").otherwise(F.left(own, F.lit(30)))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.heading_is_noise(s).alias("noise"))


@query(
    "q_canon_prices",
    r"""
    WITH p AS (SELECT l_orderkey, l_linenumber, format('{:,.2f}', l_extendedprice) AS s, l_linenumber % 2 = 0 AS swap, l_linenumber % 3 = 0 AS neg, CAST(CAST(l_extendedprice AS DECIMAL(18, 2)) AS VARCHAR) AS plain FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE WHEN swap THEN CASE WHEN neg THEN '−' ELSE '' END || translate(s, ',.', '.,') ELSE CASE WHEN neg THEN '−' ELSE '' END || s END AS tok,
           CASE WHEN neg THEN '-' ELSE '' END || regexp_replace(regexp_replace(plain, '0+$', ''), '\.$', '') AS number FROM p
    """,
)
def q_canon_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.format_number("l_extendedprice", 2)
    tok = F.concat(F.when(F.col("l_linenumber") % 3 == 0, "−").otherwise(""), F.when(F.col("l_linenumber") % 2 == 0, F.translate(s, ",.", ".,")).otherwise(s))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", tok.alias("tok"), X.canon_number(tok).alias("number"))


@query(
    "q_cjk_spaces",
    """
    WITH t AS (SELECT doc_id, (length(text) - length(replace(text, ' the ', ''))) // 5 AS n, length(text) AS len FROM documents)
    SELECT doc_id, CAST(n AS INTEGER) AS spaces, CASE WHEN len > 0 THEN round(2.0 * n / len, 9) ELSE 0.0 END AS ratio FROM t
    """,
)
def q_cjk_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = F.replace("text", F.lit(" the "), F.lit(" 中 文 "))
    return table(spark, sf_dir, "documents").select("doc_id", X.cjk_inner_spaces(wide).cast("int").alias("spaces"), F.round(X.cjk_ratio(wide), 9).alias("ratio"))


@query(
    "q_markdown_parts",
    f"""
    WITH {_FLAT.replace(chr(92) * 2, chr(92))}
    SELECT d AS doc_id, list(trim(regexp_replace(content, '\\s+', ' ', 'g')) ORDER BY t) FILTER (WHERE u) AS headings, CAST(count(*) FILTER (WHERE grid IS NOT NULL) AS INTEGER) AS n_tables,
           CAST(coalesce(sum(len(grid)), 0) AS BIGINT) AS n_rows FROM k GROUP BY d
    """,
)
def q_markdown_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    md = render_markdown(flat_nodes(spark, sf_dir)).withColumn("tables", X.md_tables("text"))
    rows = F.aggregate("tables", F.lit(0).cast("long"), lambda n, t: n + F.size(t))
    return md.select("doc_id", X.md_headings("text").alias("headings"), F.size("tables").alias("n_tables"), rows.alias("n_rows"))


_F1 = "CASE WHEN p + r > 0 THEN round(2 * p * r / (p + r), 6) ELSE 0.0 END"


@query(
    "q_heading_scores",
    f"""
    WITH h AS (SELECT conv_id AS d, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS s, turn % 4 = 0 AS same FROM conversations WHERE role = 'user'),
    c AS (SELECT d, count(*) AS n, count(*) FILTER (WHERE same) AS tp FROM h GROUP BY d), x AS (SELECT d, tp / n AS p, tp / (n + 1) AS r FROM c)
    SELECT d AS doc_id, {_F1} AS f1 FROM x
    """,
)
def q_heading_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other heading is another one in the truth, which has one more."""
    h = table(spark, sf_dir, "conversations").where("role = 'user'")
    both = F.array_sort(F.collect_list(F.struct("turn", "text")))
    docs = h.groupBy(F.col("conv_id").alias("doc_id")).agg(both.alias("h"))
    pred = F.transform("h", lambda x: x["text"])
    truth = F.concat(F.transform("h", lambda x: F.when(x["turn"] % 4 == 0, x["text"]).otherwise(F.concat(F.lit("0123456789 "), F.sha2(x["text"], 512)))), F.array(F.lit("only in the truth 42")))
    held = docs.select("doc_id", F.transform(pred, X.norm_text).alias("p"), F.transform(truth, X.norm_text).alias("t"))
    return held.select("doc_id", F.round(heading_score(F.col("p"), F.col("t")), 6).alias("f1"))


@query(
    "q_cell_scores",
    f"""
    WITH {_FLAT.replace(chr(92) * 2, chr(92))},
    c AS (SELECT d, t, unnest(flatten(grid)) AS c, generate_subscripts(flatten(grid), 1) AS i FROM k WHERE grid IS NOT NULL),
    a AS (SELECT d, c, count(*) AS n FROM c WHERE c <> '' GROUP BY d, c), b AS (SELECT d, CASE WHEN i % 3 = 0 THEN 'other' ELSE c END AS c, count(*) AS n FROM c WHERE c <> '' OR i % 3 = 0 GROUP BY 1, 2),
    tp AS (SELECT a.d, sum(least(a.n, b.n)) AS tp FROM a JOIN b ON a.d = b.d AND a.c = b.c GROUP BY a.d),
    x AS (SELECT s.d, coalesce(tp, 0) / s.n AS p, coalesce(tp, 0) / y.n AS r FROM (SELECT d, sum(n) AS n FROM a GROUP BY d) s JOIN (SELECT d, sum(n) AS n FROM b GROUP BY d) y ON y.d = s.d LEFT JOIN tp ON tp.d = s.d)
    SELECT d AS doc_id, {_F1} AS f1 FROM x
    """,
)
def q_cell_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cells of a conversation's tables against the same with every third changed."""
    t = flat_nodes(spark, sf_dir).where("type = 'table'")
    changed = F.transform("grid", lambda r, i: F.transform(r, lambda c, j: F.when((i * 2 + j + 1) % 3 == 0, "other").otherwise(c)))
    docs = t.groupBy("doc_id").agg(F.collect_list("grid").alias("p"), F.collect_list(changed).alias("t"))
    return docs.select("doc_id", F.round(cell_f1(F.col("p"), F.col("t")), 6).alias("f1"))


@query(
    "q_digit_scores",
    """
    WITH a AS (SELECT l_orderkey AS d, l_partkey % 50 AS v, count(*) AS n FROM lineitem GROUP BY 1, 2), b AS (SELECT l_orderkey AS d, l_suppkey % 50 AS v, count(*) AS n FROM lineitem GROUP BY 1, 2),
    tp AS (SELECT a.d, sum(least(a.n, b.n)) AS tp FROM a JOIN b ON a.d = b.d AND a.v = b.v GROUP BY a.d), n AS (SELECT l_orderkey AS d, count(*) AS n FROM lineitem GROUP BY 1),
    x AS (SELECT n.d, n.n, coalesce(tp, 0) / n.n AS p FROM n LEFT JOIN tp ON tp.d = n.d)
    SELECT d AS doc_id, round_even(p, 4) AS digit_precision, round_even(p, 4) AS digit_recall, CAST(n AS INTEGER) AS digit_n_truth FROM x
    """,
)
def q_digit_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers written in two texts of each order."""
    said = lambda c: F.concat_ws(" ; ", F.collect_list(F.concat(F.lit("no "), (F.col(c) % 50).cast("string"), F.lit(" x"))))
    texts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(said("l_partkey").alias("p"), said("l_suppkey").alias("t"))
    held = texts.select("doc_id", X.numbers("p").alias("p"), X.numbers("t").alias("t"))
    return held.withColumn("s", number_stats(F.col("p"), F.col("t"))).select("doc_id", "s.digit_precision", "s.digit_recall", "s.digit_n_truth")


_KINDS = "['adapter', 'image', 'pdf', 'scan'][o_orderkey % 4 + 1]"


@query(
    "q_ocr_orders",
    f"""
    WITH o AS (SELECT o_orderkey AS k, {_KINDS} AS kind, CASE WHEN o_custkey % 3 > 0 THEN o_custkey % 100 END AS density FROM orders)
    SELECT k, CASE WHEN kind = 'adapter' THEN FALSE WHEN kind = 'image' THEN TRUE ELSE coalesce(density < 50, FALSE) END AS auto, kind <> 'adapter' AS forced, FALSE AS offline FROM o
    """,
)
def q_ocr_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    kind = F.element_at(F.array(*map(F.lit, ("adapter", "image", "pdf", "scan"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    density = F.when(F.col("o_custkey") % 3 > 0, (F.col("o_custkey") % 100).cast("double"))
    return o.select(F.col("o_orderkey").alias("k"), needs_ocr(kind, "auto", True, density).alias("auto"), needs_ocr(kind, "force", True, density).alias("forced"), needs_ocr(kind, "auto", False, density).alias("offline"))


@query(
    "q_captured_errors",
    """
    WITH o AS (SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'xref table at ' || o_custkey WHEN 2 THEN 'no password for ' || o_custkey ELSE 'Damaged page ' || o_custkey END AS e FROM orders)
    SELECT k, e AS error, k % 4 IN (1, 3) AS structural FROM o
    """,
)
def q_captured_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    said = F.when(k % 4 == 1, F.concat(F.lit("xref table at "), c)).when(k % 4 == 2, F.concat(F.lit("no password for "), c)).otherwise(F.concat(F.lit("Damaged page "), c))
    out = F.when(k % 4 == 0, "started\nno Error: here").otherwise(F.concat(F.lit("started\n  Error:  "), said, F.lit(" \nError: second")))
    return table(spark, sf_dir, "orders").select(k.alias("k"), X.first_error(out).alias("error"), X.is_structural_error(X.first_error(out)).alias("structural"))


@query(
    "q_scan_kinds",
    r"""
    WITH d AS (SELECT doc_id, length(text) AS n, 1 + doc_id % 40 AS pages, text FROM documents)
    SELECT doc_id, CASE WHEN n / pages < 50 THEN 'scan-pdf' ELSE 'pdf' END AS kind, doc_id % 2 = 0 AND doc_id % 5 <> 0 AND doc_id % 7 <> 0 AND length(regexp_replace(CASE WHEN doc_id % 3 = 0 THEN ' .,- ' ELSE text END, '[^\p{L}\p{N}]', '', 'g')) = 0 AS empty FROM d
    """,
)
def q_scan_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    seen = F.when(i % 3 == 0, " .,- ").otherwise(F.col("text"))
    empty = empty_image(i % 5 != 0, i % 7 == 0, F.when(i % 2 == 0, "image").otherwise("pdf"), seen)
    return table(spark, sf_dir, "documents").select("doc_id", X.scan_kind(F.length("text"), 1 + i % 40).alias("kind"), empty.alias("empty"))


@query(
    "q_numbered_titles",
    """
    WITH o AS (SELECT o_orderkey AS k, o_orderkey % 6 AS m, o_orderkey % 2 = 0 AS bare, o_orderkey % 30 + 1 AS n, o_orderkey % 14 = 9 AS sentence FROM orders)
    SELECT k, CASE WHEN m = 5 OR (sentence AND NOT bare) THEN NULL ELSE [2, 3, 4, 4, 2][m + 1] END AS level, CASE WHEN m = 5 OR (sentence AND NOT bare) THEN NULL ELSE bare AND (m IN (0, 4) OR n < 10) END AS bare FROM o
    """,
)
def q_numbered_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    n, m = (k % 30 + 1).cast("string"), k % 6
    mark = F.when(m == 0, F.concat(F.lit("Chapter "), n)).when(m == 1, F.concat(F.lit("Section "), n)).when(m == 2, F.concat(F.lit("Art. "), n)).when(m == 3, F.concat(F.lit("§ "), n)).when(m == 4, F.concat(F.lit("第"), n, F.lit("章")))
    title = F.concat(F.coalesce(mark, F.concat(n, F.lit(" bottles"))), F.when(k % 2 == 0, "").when(k % 14 == 9, " General rules. And more").otherwise(" General rules"))
    found = X.numbered_heading(title)
    return table(spark, sf_dir, "orders").select(k.alias("k"), found["level"].alias("level"), found["bare"].alias("bare"))
