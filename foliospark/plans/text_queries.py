"""Queries over the text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import text as X
from foliospark.functions.metrics import cell_f1, cer, char_sim, digit_stats, heading_f1, order_tau, similarity
from foliospark.functions.rtl import restore_text, votes
from foliospark.operators.blocks import line_blocks
from foliospark.plans.registry import TOKENS_SQL, cases, query, table

_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents"


@query("q_doc_tokens", f"SELECT doc_id, count(*) AS n_blocks, CAST(sum({TOKENS_SQL.format('line')}) AS BIGINT) AS tokens FROM ({_LINES}) GROUP BY doc_id")
def doc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_blocks"), F.sum(X.estimate_tokens("line")).cast("long").alias("tokens"))


@query(
    "q_line_blocks",
    """
    WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents),
    u AS (SELECT doc_id, unnest(range(1, len(a) + 1)) AS i, a FROM l)
    SELECT doc_id, CAST(i AS INTEGER) AS ord, 'text' AS kind, a[i] AS text FROM u WHERE a[i] <> ''
    """,
)
def q_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_blocks(table(spark, sf_dir, "documents")).select("doc_id", F.col("ord").cast("int").alias("ord"), "kind", "text")


_COMPAT = [(1, "⼀个⼤⼈ ﬁle ⺟"), (2, "，x²½"), (3, "ﬀﬃ\uf900"), (4, "plain")]


@cases("q_compat_normalize", "id int, text string", _COMPAT, {"id": "INTEGER", "text": "VARCHAR", "n_fixed": "INTEGER"}, [(1, "一个大人 file 母", 5), (2, "，x²½", 0), (3, "ffffi\u8c48", 3), (4, "plain", 0)])
def compat(df: DataFrame) -> DataFrame:
    return df.select("id", X.normalize_compat("text").alias("text"), X.compat_residual("text").alias("n_fixed"))


@query("q_compat_documents", "SELECT doc_id, CAST(0 AS INTEGER) AS residual, text FROM documents")
def compat_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.compat_residual("text").alias("residual"), X.normalize_compat("text").alias("text"))


@cases(
    "q_list_bullets", "id int, text string", [(1, "• First point"), (2, "•x"), (3, "- minus"), (4, "3. plain"), (5, "•"), (6, "▪● two"), (7, "two")],
    {"id": "INTEGER", "text": "VARCHAR"}, [(1, "First point"), (2, "•x"), (3, "- minus"), (4, "3. plain"), (5, "•"), (6, "two"), (7, "two")],
)
def bullets(df: DataFrame) -> DataFrame:
    return df.select("id", X.strip_list_bullet("text").alias("text"))


_LONG = "x" * 90


@cases(
    "q_list_paragraphs", "id int, items array<string>", [(1, [f"(1) {_LONG}", f"(2) {_LONG}", "plain"]), (2, ["(1) short", "(2) short"]), (3, [f"(1) {_LONG}", "plain"]), (4, ["(1) short", f"(2) {_LONG}"])],
    {"id": "INTEGER", "flags": "BOOLEAN[]"}, [(1, [True, True, False]), (2, [False, False]), (3, [False, False]), (4, [True, True])],
)
def list_paragraphs(df: DataFrame) -> DataFrame:
    return df.select("id", X.list_paragraph_flags("items").alias("flags"))


_NOISE = ["a", "√", "MUST", "should not", "rfc-index.xml", "記", "背景", "DIRECTIVES", "§ 1 Grundsatz", "", "x y.pdf"]


@cases(
    "q_heading_noise", "id int, text string", list(enumerate(_NOISE)), {"id": "INTEGER", "noise": "BOOLEAN"},
    list(enumerate([True, True, True, True, True, False, False, False, False, False, False])),
)
def noise(df: DataFrame) -> DataFrame:
    return df.select("id", X.heading_is_noise("text").alias("noise"))


@query("q_heading_noise_lines", f"SELECT doc_id, count(*) AS n FROM ({_LINES}) WHERE length(trim(line)) = 1 GROUP BY doc_id")
def noise_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.where(X.heading_is_noise("line") & (F.length(F.trim("line")) == 1)).groupBy("doc_id").agg(F.count("*").alias("n"))


_NUMBERED = [
    ("第一編　総則", 2, False), ("第二章", 2, True), ("第3节 方法", 3, False), ("第5条", 4, True), ("Chapter IV", 2, True), ("Title 2: Scope", 2, False), ("Section 3 Definitions", 3, False),
    ("Article 5", 4, True), ("Article premier", 4, True), ("Artículo 7 Ámbito", 4, False), ("§ 12 Fristen", 4, False), ("第五条 規定。本文", None, None), ("Partly cloudy", None, None),
    ("Article 5 applies. See below", None, None), ("Kapitel 2 " + "x" * 60, None, None),
]


@cases(
    "q_numbered_headings", "id int, text string", [(i, t) for i, (t, _, _) in enumerate(_NUMBERED)], {"id": "INTEGER", "level": "INTEGER", "bare": "BOOLEAN"},
    [(i, level, bare) for i, (_, level, bare) in enumerate(_NUMBERED)],
)
def numbered(df: DataFrame) -> DataFrame:
    return df.select("id", X.numbered_heading("text").alias("n")).select("id", "n.level", "n.bare")


_NORM = [
    ("# Title **bold** ![i](u) [link](u)", "Title bold link"), ("a $x^2$ b", "a b"), ("it costs $5 and $6", "it costs $5 and $6"), ("T < Tc and q > p", "T < Tc and q p"), ("x <b>y</b> z", "x y z"),
    ("| a | b |\n|---|---|\n| 1 | 2 |", "a b 1 2"), ("- one\n- two\n3. three", "one two three"), ("看 起来", "看起来"), ("$$\n\\frac{1}{2}\n$$ rest", "rest"), ("﻿  a  b ", "a b"),
]


@cases("q_norm_text", "id int, text string", [(i, a) for i, (a, _) in enumerate(_NORM)], {"id": "INTEGER", "text": "VARCHAR"}, [(i, b) for i, (_, b) in enumerate(_NORM)])
def norm(df: DataFrame) -> DataFrame:
    return df.select("id", X.norm_text("text").alias("text"))


@query("q_norm_ws", r"SELECT doc_id, trim(regexp_replace(replace(text, chr(173), ''), '[\s\x{a0}\x{200b}]+', ' ', 'g')) AS text FROM documents")
def q_norm_ws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.norm_ws("text").alias("text"))


@query("q_words", r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{3040}-\x{30ff}]|[^\s\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{3040}-\x{30ff}]+')) AS INTEGER) AS n_words FROM documents")
def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(X.tokens("text")).alias("n_words"))


@query("q_letters_digits", r"SELECT doc_id, CAST(length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) AS INTEGER) AS n, CAST(length(regexp_replace(text, '\s', '', 'g')) AS INTEGER) AS visible FROM documents")
def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.letters_and_digits("text").alias("n"), F.length(F.regexp_replace("text", r"\s", "")).alias("visible"))


_CANON = [
    ("132,704,932.32", "132704932.32"), ("1,234", "1234"), ("1.234", "1.234"), ("1.234.567", "1234567"), ("1.234,56", "1234.56"), ("-0.00", "0"), ("007", "7"), ("9,54", "9.54"),
    ("−18.220", "-18.22"), ("１２，３４５", "12345"), ("1'234'567", "1234567"), ("1,2.3,4", None), ("5.", "5"),
]


@cases("q_canon_numbers", "id int, tok string", [(i, a) for i, (a, _) in enumerate(_CANON)], {"id": "INTEGER", "number": "VARCHAR"}, [(i, b) for i, (_, b) in enumerate(_CANON)])
def canon(df: DataFrame) -> DataFrame:
    return df.select("id", X.canon_number("tok").alias("number"))


@query("q_number_strings", r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[0-9][0-9,.]*[0-9]|[0-9]')) AS INTEGER) AS n, array_to_string(regexp_extract_all(text, '[0-9][0-9,.]*[0-9]|[0-9]'), ' ') AS found FROM documents")
def number_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_extract_all("text", F.lit(r"([0-9][0-9,.]*[0-9]|[0-9])"), F.lit(1))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(found).alias("n"), F.array_join(found, " ").alias("found"))


@query("q_numbers")
def q_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.numbers("text").alias("numbers")).where(F.size("numbers") > 0)


_REDACT = "text"
for _p, _to in X.REDACTIONS:
    _REDACT = f"regexp_replace({_REDACT}, '{_p}', '{_to}', 'g')"


@query("q_redact", f"SELECT doc_id, {_REDACT} AS text FROM documents")
def q_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.redact("text").alias("text"))


@query("q_hashes", "SELECT doc_id, sha256(text) AS sha256, left(sha1(text), 8) AS short, md5(text) AS md5 FROM documents")
def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.left(F.sha1(F.col("text").cast("binary")), F.lit(8)).alias("short"), F.md5(F.col("text").cast("binary")).alias("md5"))


@query("q_slugs", r"SELECT p_partkey, left(regexp_replace(regexp_replace(lower(p_name || ' / ' || p_brand), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 60) AS slug FROM part")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", X.slug(F.concat("p_name", F.lit(" / "), "p_brand")).alias("slug"))


@query("q_clip", "SELECT doc_id, CASE WHEN length(text) > 2000 THEN left(text, 2000) || chr(10) || chr(10) || '[cut]' ELSE text END AS text FROM documents")
def q_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.clip("text", 2000).alias("text"))


@cases(
    "q_human_size", "id int, n long", [(1, 0), (2, 1023), (3, 1536), (4, 5 << 20), (5, 3 << 30)], {"id": "INTEGER", "size": "VARCHAR"},
    [(1, "0 B"), (2, "1023 B"), (3, "1.5 KB"), (4, "5.0 MB"), (5, "3.0 GB")],
)
def sizes(df: DataFrame) -> DataFrame:
    return df.select("id", X.human_size("n").alias("size"))


@cases(
    "q_errors", "id int, text string", [(1, "start\n  Error: xref table damaged \nError: two"), (2, "fine"), (3, "Error: no password")],
    {"id": "INTEGER", "error": "VARCHAR", "structural": "BOOLEAN"}, [(1, "xref table damaged", True), (2, None, False), (3, "no password", False)],
)
def errors(df: DataFrame) -> DataFrame:
    return df.select("id", X.first_error("text").alias("error"), X.is_structural_error(X.first_error("text")).alias("structural"))


_MD = "# One #\n\ntext\n\n  ## Two **b**\n| a | b |\n|---|---|\n| 1 | x\\y |\n\n| only |\nend\n"


@cases(
    "q_md_parts", "id int, md string", [(1, _MD), (2, "plain")], {"id": "INTEGER", "headings": "VARCHAR[]", "tables": "VARCHAR"},
    [(1, ["One", "Two b"], '[[["a","b"],["1","x\\\\y"]],[["only"]]]'), (2, [], "[]")],
)
def md_parts(df: DataFrame) -> DataFrame:
    return df.select("id", X.md_headings("md").alias("headings"), F.to_json(X.md_tables("md")).alias("tables"))


_PAIRS = [
    ("a b c d", "a b c e", 1 - 1 / 7, 0.25), ("今天天气好", "今天天气很好", 1 - 1 / 6, 1 / 6), ("", "", 1.0, 0.0), ("x", "", 0.0, 1.0), ("same text", "same text", 1.0, 0.0),
]


@cases("q_similarity", "id int, p string, t string", [(i, p, t) for i, (p, t, _, _) in enumerate(_PAIRS)], {"id": "INTEGER", "char_sim": "DOUBLE", "cer": "DOUBLE"}, [(i, round(a, 6), round(b, 6)) for i, (_, _, a, b) in enumerate(_PAIRS)])
def sims(df: DataFrame) -> DataFrame:
    return df.select("id", F.round(char_sim("p", "t"), 6).alias("char_sim"), F.round(cer("p", "t"), 6).alias("cer"))


@query("q_benchmark_similarity")  # no SQL: DuckDB's distance counts bytes
def benchmark_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select("item_id", "text")
    nxt = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("u"))
    return b.join(nxt, "item_id").select("item_id", F.round(similarity(F.col("text"), F.col("u")), 9).alias("sim"))


@cases(
    "q_digit_stats", "id int, p string, t string", [(1, "5 5", "5"), (2, "132,701,932.32", "132,704,932.32"), (3, "no", "no"), (4, "1 2 3", "3 2 4")],
    {"id": "INTEGER", "digit_f1": "DOUBLE", "digit_precision": "DOUBLE", "digit_recall": "DOUBLE", "digit_n_truth": "INTEGER", "digit_n_pred": "INTEGER"},
    [(1, 0.6667, 0.5, 1.0, 1, 2), (2, 0.0, 0.0, 0.0, 1, 1), (3, 1.0, 1.0, 1.0, 0, 0), (4, 0.6667, 0.6667, 0.6667, 3, 3)],
)
def digits(df: DataFrame) -> DataFrame:
    return df.select("id", digit_stats("p", "t").alias("d")).select("id", "d.*")


@cases(
    "q_heading_f1", "id int, p array<string>, t array<string>", [(1, ["Introduction", "Methods"], ["Introduction", "Methods"]), (2, [], []), (3, ["Introductlon"], ["Introduction", "End"]), (4, ["a"], [])],
    {"id": "INTEGER", "f1": "DOUBLE"}, [(1, 1.0), (2, 1.0), (3, 0.666667), (4, 0.0)],
)
def q_heading_f1(df: DataFrame) -> DataFrame:
    return df.select("id", F.round(heading_f1("p", "t"), 6).alias("f1"))


@cases(
    "q_cell_f1_tables", "id int, p array<array<array<string>>>, t array<array<array<string>>>",
    [(1, [[["a", "b"], ["1", "1"]]], [[["a", "b"], ["1", "1"]]]), (2, [[["a", "b"]]], [[["a", "c"]]]), (3, [], []), (4, [[["1", "1"]]], [[["1"]]])],
    {"id": "INTEGER", "f1": "DOUBLE"}, [(1, 1.0), (2, 0.5), (3, 1.0), (4, 0.666667)],
)
def q_cell_f1(df: DataFrame) -> DataFrame:
    return df.select("id", F.round(cell_f1(F.col("p"), F.col("t")), 6).alias("f1"))


_P = ["the first paragraph here", "the second paragraph there", "a third paragraph at last"]


@cases(
    "q_order_tau_cases", "id int, p string, t array<string>", [(1, " ".join(_P), _P), (2, " ".join(_P[::-1]), _P), (3, "nothing of it", _P), (4, " ".join([_P[1], _P[0], _P[2]]), _P)],
    {"id": "INTEGER", "tau": "DOUBLE"}, [(1, 1.0), (2, -1.0), (3, None), (4, 0.333333)],
)
def taus(df: DataFrame) -> DataFrame:
    return df.select("id", F.round(order_tau("p", "t"), 6).alias("tau"))


_HE = "שלום עולם, זה מבחן."
_RTL = [(1, "plain"), (2, "שלום עולם"), (3, ".ןחבמ הז ,םלוע םולש"), (4, ",הזה רפסה תא בתכ ימ ?םולח ןאכ שי םא")]


@cases(
    "q_rtl_votes", "id int, text string", _RTL, {"id": "INTEGER", "visual": "INTEGER", "logical": "INTEGER"}, [(1, 0, 0), (2, 0, 2), (3, 5, 0), (4, 5, 0)],
)
def q_votes(df: DataFrame) -> DataFrame:
    return df.select("id", votes("text").alias("v")).select("id", "v.visual", "v.logical")


@cases(
    "q_rtl_restore", "id int, text string, kind string", [(1, ".ןחבמ הז ,םלוע םולש", "text"), (2, "# םולש", "md"), (3, "plain (a)", "text"), (4, "<p>םולש</p>", "html")],
    {"id": "INTEGER", "text": "VARCHAR"}, [(1, "שלום עולם, זה מבחן."), (2, "# שלום"), (3, "plain (a)"), (4, "<p>שלום</p>")],
)
def q_restore(df: DataFrame) -> DataFrame:
    return df.select("id", restore_text("text", "kind").alias("text"))
