"""Queries on files in and out, filters by specification, and the streaming ledger.

Files are written from whole tables into the shared folder and read back, so that the
tables themselves are the reference.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.functions.rowwise import by_row
from foliospark.operators.block_table import BlockTable
from foliospark.operators.blocks import line_blocks
from foliospark.operators.evaluate import markdown_table
from foliospark.operators.ledger import MOST_ATTEMPTS
from foliospark.operators.tidy import tidy_html, tidy_markdown
from foliospark.plans.registry import CONVERSATION_BLOCKS, conversation_blocks, query, table
from foliospark.sources.files import MAGIC, attribute_filter, first_n, is_input, page_filter, parse_selection, read_jsonl, read_trees, scan, sniffed
from foliospark.sources.document_files import register
from foliospark.sources.html_tree import decode
from foliospark.sources.ledger_table import LedgerTable
from foliospark.sources.parse import SUPPORTED
from foliospark.sources.writers import read_csv, work_folder, write_csv, write_jsonl, write_trees
from foliospark.streaming.watch import ledger_sink, redo

_DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@query("q_page_filter", f"SELECT doc_id, ord, page, text FROM ({CONVERSATION_BLOCKS}) WHERE page IN (1, 3, 5, 6, 7)")
def q_page_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_filter(conversation_blocks(spark, sf_dir), "1, 3,5-7").select("doc_id", "ord", "page", "text")


@query("q_page_filter_unreadable", f"SELECT doc_id, ord FROM ({CONVERSATION_BLOCKS})")
def q_page_filter_unreadable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_filter(conversation_blocks(spark, sf_dir), "1,x-").select("doc_id", "ord")


@query("q_selection", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey + 1 IN (2, 5, 6, 7, 11)")
def q_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = parse_selection("2，7-5, 11,6", 25)
    return table(spark, sf_dir, "nation").where((F.col("n_nationkey") + 1).isin(*chosen)).select("n_nationkey", "n_name")


@query("q_attribute_filter", "SELECT doc_id, lang, source FROM documents WHERE lang IN ('en', 'de') AND source IN ('src1', 'src2', 'src7')")
def q_attribute_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(attribute_filter("lang=en|de, source=src1|src2|src7")).select("doc_id", "lang", "source")


@query("q_first_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def q_first_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_n(table(spark, sf_dir, "orders"), 25, F.desc("o_totalprice"), "o_orderkey").select("o_orderkey", "o_totalprice")


_NAMES = ("", ".", "~$", "a.")
_ENDS = ("pdf", "PNG", "docx", "txt", "html", "", "md", "Xlsx")


def _path_sql(key: str, text: str) -> str:
    names = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_NAMES))
    ends = " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(_ENDS))
    return f"concat('in/', {text}, '/', CASE {key} % {len(_NAMES)} {names} END, {key}, '.', CASE {key} % {len(_ENDS)} {ends} END)"


@query(
    "q_input_files",
    f"SELECT doc_id, path FROM (SELECT doc_id, {_path_sql('doc_id', 'coalesce(source, chr(63))')} AS path FROM documents) "
    f"WHERE lower(regexp_extract(path, '\\.([^./]+)$', 1)) IN ({', '.join(repr(s) for s in SUPPORTED)}) AND NOT regexp_matches(regexp_extract(path, '([^/]+)$', 1), '^(\\.|~\\$)')",
)
def q_input_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.expr(_path_sql("doc_id", "coalesce(source, '?')"))
    return table(spark, sf_dir, "documents").select("doc_id", p.alias("path")).where(is_input(F.col("path")))


_HEAD = "left(content, 512)"
_MARKS = " ".join(f"WHEN starts_with({_HEAD}, '{m}') THEN '{k}'" for m, k in MAGIC if m.isprintable() and m.isascii())


@query(
    "q_sniffed",
    f"""
    WITH s AS (SELECT 'p' || page_id AS path, html AS content FROM pages UNION ALL SELECT 'd' || doc_id AS path, text AS content FROM documents
               UNION ALL SELECT 'b' || item_id || '.tex' AS path, text AS content FROM benchmark)
    SELECT path, CASE WHEN path LIKE '%.tex' THEN 'latex' {_MARKS} WHEN regexp_matches({_HEAD}, '(?is)^\\s*<\\?xml') THEN 'xml' WHEN regexp_matches({_HEAD}, '(?is)<html|<!doctype html') THEN 'html'
                      WHEN contains({_HEAD}, '\\documentclass') THEN 'latex' ELSE 'text' END AS kind FROM s
    """,
)
def q_sniffed(spark: SparkSession, sf_dir: str) -> DataFrame:
    take = lambda t, mark, key, text, end="": table(spark, sf_dir, t).select(F.concat(F.lit(mark), F.col(key), F.lit(end)).alias("path"), F.encode(text, "UTF-8").alias("content"))
    both = take("pages", "p", "page_id", "html").unionByName(take("documents", "d", "doc_id", "text")).unionByName(take("benchmark", "b", "item_id", "text", ".tex"))
    return both.select("path", sniffed(F.col("path"), F.col("content")).alias("kind"))


@query("q_decode", "SELECT page_id, length(html) AS n_chars, md5(html) AS digest FROM pages")
def q_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages in UTF-8 without and with a mark, and in UTF-16 of both orders."""
    plain = F.encode("html", "UTF-8")
    marked = [plain, F.concat(F.unhex(F.lit("EFBBBF")), plain), F.concat(F.unhex(F.lit("FFFE")), F.encode("html", "UTF-16LE")), F.concat(F.unhex(F.lit("FEFF")), F.encode("html", "UTF-16BE"))]
    raw = marked[0]
    for i, form in enumerate(marked[1:], 1):
        raw = F.when(F.col("page_id") % len(marked) == i, form).otherwise(raw)
    got = table(spark, sf_dir, "pages").select("page_id", by_row(lambda b: None if b is None else decode(b), T.StringType())(raw).alias("html"))
    return got.select("page_id", F.length("html").cast("long").alias("n_chars"), F.md5(F.encode("html", "UTF-8")).alias("digest"))


@query("q_jsonl_round_trip", "SELECT doc_id, text, lang, source, n_chars FROM documents UNION ALL SELECT item_id AS doc_id, text, NULL AS lang, 'benchmark' AS source, NULL AS n_chars FROM benchmark")
def q_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appends to one folder, a comment and a half-written line between them."""
    path = work_folder(spark, "results-jsonl")
    write_jsonl(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars"), path)
    spark.range(1).select(F.explode(F.array(F.lit("# note"), F.lit(""), F.lit('{"doc_id": 1, "te'))).alias("value")).coalesce(1).write.mode("append").text(path)
    write_jsonl(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text", F.lit("benchmark").alias("source")), path)
    return read_jsonl(spark, path, _DOCUMENTS)


@query("q_csv_round_trip", "SELECT conv_id, turn, role, text FROM conversations")
def q_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_folder(spark, "conversations-csv")
    write_csv(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), path)
    return read_csv(spark, path, "conv_id long, turn long, role string, text string")


@query(
    "q_tree_round_trip",
    "SELECT r_name AS region, n_name AS title, CAST(row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) - 1 AS INTEGER) AS ord FROM region JOIN nation ON n_regionkey = r_regionkey",
)
def q_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tree for each region, its nations below it, written as files and read as VARIANT."""
    path = work_folder(spark, "region-trees")
    both = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    kids = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", F.col("n_name").alias("content")))), lambda k: F.struct(k["content"].alias("content")))
    trees = both.groupBy("r_regionkey", "r_name").agg(kids.alias("kids")).select("r_regionkey", F.to_json(F.struct(F.col("r_name").alias("title"), "kids")).alias("tree"))
    write_trees(trees, path, "r_regionkey")
    read = read_trees(spark, path)
    parts = read.select(F.variant_get("tree", "$.title", "string").alias("region"), F.posexplode(F.variant_get("tree", "$.kids", "array<struct<content:string>>")).alias("ord", "kid"))
    return parts.select("region", F.col("kid.content").alias("title"), "ord")


@query("q_scan", "SELECT CAST(r_regionkey AS BIGINT) AS region, 'html' AS ext FROM region")
def q_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of two kinds in subfolders; only those with a supported ending count."""
    root = work_folder(spark, "scan")
    region = table(spark, sf_dir, "region").select("r_regionkey", F.to_json(F.struct("r_name")).alias("value"))
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    region.repartition("r_regionkey").write.partitionBy("r_regionkey").text(f"{root}/kept")
    fs = jvm.org.apache.hadoop.fs.Path(root).getFileSystem(conf)
    for status in list(fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{root}/kept/*/*.txt"))):
        fs.rename(status.getPath(), jvm.org.apache.hadoop.fs.Path(status.getPath().getParent(), "page.HTML"))
    region.write.json(f"{root}/left")
    found = scan(spark, root, content=False)
    return found.select(F.regexp_extract("path", r"r_regionkey=(\d+)", 1).cast("long").alias("region"), "ext")


@query(
    "q_report_markdown",
    """
    WITH g AS (SELECT o_orderstatus AS s, count(*) AS n, count(DISTINCT o_custkey) AS c FROM orders GROUP BY 1)
    SELECT CAST(ord AS INTEGER) AS ord, line FROM (
        SELECT 0 AS ord, '| status | orders | customers |' AS line UNION ALL SELECT 1, '|---|---|---|'
        UNION ALL SELECT 1 + row_number() OVER (ORDER BY s), '| ' || s || ' | ' || n || ' | ' || c || ' |' FROM g)
    """,
)
def q_report_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("orders"), F.countDistinct("o_custkey").alias("customers"))
    return markdown_table(g, "status")


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet*")


@query("q_stream_ledger", "SELECT event_id, event_type FROM events")
def q_stream_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of a stream whose every batch is saved twice, as after a restart."""
    path = work_folder(spark, "stream-ledger")
    save = ledger_sink(f"{path}/ledger", "event_id")

    def twice(batch: DataFrame, epoch: int) -> None:
        save(batch, epoch)
        save(batch, epoch)

    run = _stream(spark, sf_dir).select("event_id", "event_type").writeStream.foreachBatch(twice).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return LedgerTable(spark, f"{path}/ledger", "event_id").read().select("event_id", "event_type")


@query(
    "q_stream_redo",
    f"""
    WITH e AS (SELECT user_id, event_id, event_type = 'error' AS failed FROM events),
    r AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM e),
    k AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY event_id) AS attempt FROM r WHERE failed)
    SELECT CAST(user_id AS VARCHAR) AS path, event_id AS seq, CAST(attempt AS INTEGER) AS attempt FROM k WHERE attempt <= {MOST_ATTEMPTS}
    """,
)
def q_stream_redo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retries that are due after failures (error events) of each path (a user)."""
    path = work_folder(spark, "stream-redo")
    seen = _stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("path"), F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("failed"))
    run = redo(seen).writeStream.format("parquet").option("path", f"{path}/due").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema("path string, seq long, attempt int").parquet(f"{path}/due")


@query("q_tidy_markdown")
def q_tidy_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a Markdown list of its lines, tidied."""
    listed = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "(?m)^(?=.)", "- • ").alias("text"))
    return tidy_markdown(listed)


@query(
    "q_tidy_html",
    "SELECT page_id, regexp_replace(html, '<li>[•▪] ', '<li>', 'g') AS html, CAST(len(regexp_extract_all(html, '<li>[•▪] ')) AS BIGINT) AS changed FROM "
    "(SELECT page_id, replace(html, '<li>', '<li>▪ ') AS html FROM pages)",
)
def q_tidy_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with a bullet sign put into its list items, tidied."""
    return tidy_html(table(spark, sf_dir, "pages").select("page_id", F.replace("html", F.lit("<li>"), F.lit("<li>▪ ")).alias("html")), "page_id")


#: Lines and bytes are counted piece by piece, whatever the files' size.
_PIECE = 1 << 20
_FOLDER = "SELECT lang, count(*) AS n, CAST(sum(octet_length(encode(replace(coalesce(text, ''), chr(10), ' '))) + 1) AS BIGINT) AS bytes FROM documents GROUP BY lang"


def _as_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as lines of files in a folder for each language."""
    line = F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" "))
    return table(spark, sf_dir, "documents").select("doc_id", "lang", line.alias("value"))


def _in_folders(files: DataFrame) -> DataFrame:
    raw = F.col("content")
    lines = F.length(raw) - F.length(F.replace(F.decode(raw, "ISO-8859-1"), F.lit("\n"), F.lit("")))
    return files.groupBy(F.regexp_extract("path", r"/lang=([^/]*)/", 1).alias("lang")).agg(F.sum(lines).alias("n"), F.sum(F.length(raw)).alias("bytes"))


@query("q_document_files", _FOLDER)
def q_document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files through the data source: those of another ending and empty ones are filtered in the listing."""
    root = work_folder(spark, "document-files")
    _as_files(spark, sf_dir).drop("doc_id").write.partitionBy("lang").text(root)
    register(spark)
    found = spark.read.format("document_files").option("supported", "false").option("pieceBytes", _PIECE).schema("path string, size long, content binary").load(root)
    return _in_folders(found.where(F.col("path").endswith(".txt") & (F.col("size") > 0)))


@query("q_document_stream", _FOLDER)
def q_document_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files as a stream: two runs over a folder that grows in between."""
    root = work_folder(spark, "document-stream")
    register(spark)
    texts = _as_files(spark, sf_dir)
    for half in (0, 1):
        texts.where(F.pmod("doc_id", F.lit(2)) == half).drop("doc_id").write.mode("append").partitionBy("lang").text(f"{root}/in")
        stream = spark.readStream.format("document_files").option("supported", "false").option("lagSeconds", "0").option("pieceBytes", _PIECE).load(f"{root}/in").where("ext = 'txt'")
        run = stream.select("path", "content").writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    return _in_folders(spark.read.schema("path string, content binary").parquet(f"{root}/out"))


@query(
    "q_block_table",
    """
    WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN doc_id % 10 = 0 THEN 'changed ' || text ELSE text END AS text FROM documents WHERE doc_id % 17 <> 0),
    l AS (SELECT path, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS ord FROM d)
    SELECT path, CAST(ord AS INTEGER) AS ord, text FROM l WHERE text <> ''
    """,
)
def q_block_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of all documents after a tenth of them changed and some went; only those are parsed again."""
    d = table(spark, sf_dir, "documents")
    files = lambda text: d.select("doc_id", F.col("doc_id").cast("string").alias("path"), F.lit(0.0).alias("mtime"), F.octet_length(text).cast("long").alias("size"), text.alias("text"))
    blocks = BlockTable(spark, work_folder(spark, "block-table"), lambda x: line_blocks(x, "path").withColumnRenamed("doc_id", "path"))
    blocks.refresh(files(F.col("text")))
    blocks.refresh(files(F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("changed "), F.col("text"))).otherwise(F.col("text"))).where("doc_id % 17 <> 0"))
    return blocks.read().select("path", "ord", "text")
