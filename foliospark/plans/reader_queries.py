"""Queries over readers: literal files with their literal results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.plans.registry import cases, query, table
from foliospark.sources.parse import parse_documents
from foliospark.sources.synthetic import docx, pptx, xlsx
from foliospark.sources.truth import parse_truth

_PAGES = [
    (1, "<title>T</title><p>a&amp;b<br>c<p>d<ul><li>x<li>y<ul><li>z</ul></ul><table><caption>Cap</caption><tr><th>h<td>1<tr><td>&nbsp;<td></table>"),
    (2, "<h1>H</h1><div style='display:none'>no</div><template>no</template><pre>  k\n    l</pre><p hidden>no<p>yes"),
    (3, '<p>E <math alttext="x^2"><mi>x</mi><annotation encoding="application/x-tex">{\\displaystyle x^{2}}</annotation></math><img class="mwe-math" alt="x^{2}"> end'),
]
_TYPES = {"id": "INTEGER", "ord": "INTEGER", "type": "VARCHAR", "level": "INTEGER", "content": "VARCHAR", "items": "VARCHAR[]", "grid": "VARCHAR"}


def _nodes(df: DataFrame) -> DataFrame:
    return parse_documents(df).select("id", F.explode("nodes").alias("n")).select("id", "n.ord", "n.type", "n.level", "n.content", "n.items", F.to_json("n.grid").alias("grid"))


@cases(
    "q_html_cases", "id int, content string", _PAGES, _TYPES,
    [(1, 0, "heading", 1, "T", None, None), (1, 1, "paragraph", None, "a&b\nc", None, None), (1, 2, "paragraph", None, "d", None, None), (1, 3, "list", None, None, ["x", "y", "z"], None),
     (1, 4, "paragraph", None, "Cap", None, None), (1, 5, "table", None, None, None, '[["h","1"]]'), (2, 0, "heading", 1, "H", None, None), (2, 1, "paragraph", None, "  k\n    l", None, None),
     (2, 2, "paragraph", None, "yes", None, None), (3, 0, "paragraph", None, "E $x^{2}$ end", None, None)],
)
def q_html(df: DataFrame) -> DataFrame:
    return _nodes(df.withColumn("ext", F.lit("html")))


_FILES = [
    (1, "docx", docx([("Title", "Report"), (None, "Text."), ("List Bullet", "one"), ("List Bullet", "two"), ("Heading 2", "Part"), [["a", "b"], ["c", ""]]])),
    (2, "xlsx", xlsx({"First": [["k", "v", None], ["x", 2.0, None], [None, None, None]], "Empty": []})),
    (3, "pptx", pptx([("Hello", ["one", "two"], "say it"), ("End", [], "")])),
    (4, "docx", b"broken"),
]


@cases(
    "q_office_cases", "id int, ext string, content binary", [(i, e, bytearray(b)) for i, e, b in _FILES], _TYPES | {"page": "INTEGER"},
    [(1, 0, "heading", 1, "Report", None, None, 1), (1, 1, "paragraph", None, "Text.", None, None, 1), (1, 2, "list", None, None, ["one", "two"], None, 1), (1, 3, "heading", 2, "Part", None, None, 1),
     (1, 4, "table", None, None, None, '[["a","b"],["c",""]]', 1), (2, 0, "heading", 1, "First", None, None, 1), (2, 1, "table", None, None, None, '[["k","v"],["x","2"]]', 1), (2, 2, "heading", 1, "Empty", None, None, 2),
     (3, 0, "heading", 2, "Hello", None, None, 1), (3, 1, "paragraph", None, "one", None, None, 1), (3, 2, "paragraph", None, "two", None, None, 1), (3, 3, "paragraph", None, "Notes: say it", None, None, 1), (3, 4, "heading", 2, "End", None, None, 2)],
)
def q_office(df: DataFrame) -> DataFrame:
    parsed = parse_documents(df)
    return parsed.select("id", F.explode("nodes").alias("n")).select("id", "n.ord", "n.type", "n.level", "n.content", "n.items", F.to_json("n.grid").alias("grid"), "n.page")


@cases("q_office_errors", "id int, ext string, content binary", [(4, "docx", bytearray(b"broken")), (5, "odd", bytearray(b""))], {"id": "INTEGER", "failed": "BOOLEAN", "pages": "INTEGER"}, [(4, True, 1), (5, True, 1)])
def q_errors(df: DataFrame) -> DataFrame:
    return parse_documents(df).select("id", F.col("error").isNotNull().alias("failed"), "pages")


_LATEX = r"""\documentclass{article}\title{A \textbf{T}itle}\begin{document}
\section{One} Some \emph{text} with $x^2$ and caf\'e. % comment

\begin{table}\caption{Cap}\begin{tabular}{ll} a & b \\ \hline 1 & 2 \\ \end{tabular}\end{table}
\subsection{Two} More --- text \cite{x}.
\end{document}"""
_XML = "<doc><norm><metadaten><langue>Gesetz</langue><enbez>§ 1</enbez><titel>Ziel</titel></metadaten><textdaten><text><Content><P>Satz.</P><DL><DT>1.</DT><DD>eins</DD></DL></Content></text></textdaten></norm></doc>"
_JP = "<Law><LawNum>第一号</LawNum><LawBody><LawTitle>法</LawTitle><MainProvision><Chapter><ChapterTitle>第一章</ChapterTitle><Article><ArticleTitle>第一条</ArticleTitle><Paragraph><ParagraphNum/><ParagraphSentence>文。</ParagraphSentence></Paragraph></Article></Chapter></MainProvision></LawBody></Law>"
_TRUTH_HTML = "<body><nav>no</nav><h1>Top</h1><p>Text[1] one.</p><h2>References</h2><p>gone</p><h2>Next</h2><table><tr><td>a</td><td>b</td></tr><tr><td>1</td><td>2</td></tr></table><div class='mw-x'></div></body>"


@cases(
    "q_truth_cases", "id int, kind string, content string", [(1, "latex", _LATEX), (2, "xml", _XML), (3, "xml", _JP), (4, "html", _TRUTH_HTML)],
    {"id": "INTEGER", "text": "VARCHAR", "headings": "VARCHAR[]", "levels": "INTEGER[]", "paragraphs": "VARCHAR[]", "tables": "VARCHAR"},
    [(1, "A Title One Some text with and café. Cap a b 1 2 Two More — text.", ["A Title", "One", "Two"], [1, 2, 3], ["Some text with and café.", "Cap", "More — text."], '[[["a","b"],["1","2"]]]'),
     (2, "Gesetz § 1 Ziel Satz. 1. eins", ["Gesetz", "§ 1 Ziel"], [1, 2], ["Satz.", "1. eins"], "[]"),
     (3, "法 第一号 第一章 第一条 文。", ["法", "第一章", "第一条"], [1, 2, 3], ["第一号", "文。"], "[]"),
     (4, "Top Text one. Next a b 1 2", ["Top", "Next"], [1, 2], ["Text one."], '[[["a","b"],["1","2"]]]')],
)
def q_truth(df: DataFrame) -> DataFrame:
    return parse_truth(df).select("id", "text", "headings", F.col("heading_levels").alias("levels"), "paragraphs", F.to_json("tables").alias("tables"))


@query("q_truth_pages")
def q_truth_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.lit("html").alias("kind"), F.col("html").alias("content"))
    return parse_truth(p).select("id", "text", "headings", "heading_levels", "paragraphs")

