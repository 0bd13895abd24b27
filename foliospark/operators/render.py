"""Renderings of nodes, page texts and tables: Markdown, text, HTML, JSON, CSV rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.text import strip
from foliospark.operators.ranks import prefix_sums
from foliospark.operators.blocks import grid_markdown

SEPARATOR = "\n---\n"


def _ordered_join(df: DataFrame, by: str, piece: str, glue: str, *keys: str) -> DataFrame:
    """(by, text): pieces of each group joined in the order of the keys."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(*keys, piece))), lambda x: x[piece])
    return df.groupBy(by).agg(F.array_join(parts, glue).alias("text"))


def _pieces(nodes: DataFrame, marks: bool) -> DataFrame:
    """A text for each node; a separator where the page changes."""
    head = F.concat(F.repeat(F.lit("#"), F.coalesce("level", F.lit(1))), F.lit(" "), F.col("content")) if marks else F.col("content")
    items = F.array_join(F.transform("items", lambda x: F.concat(F.lit("- "), x)), "\n")
    flat = F.transform("grid", lambda r: F.transform(r, lambda c: F.replace(c, F.lit("\n"), F.lit(" "))))
    text = F.when(F.col("type") == "heading", head).when(F.col("type") == "list", items).when(F.col("type") == "table", grid_markdown(flat)).otherwise(F.col("content"))
    return nodes.withColumn("piece", text)


def render_markdown(nodes: DataFrame, separator: str | None = None, marks: bool = True) -> DataFrame:
    """(doc_id, text): nodes joined by blank lines, a newline at the end."""
    out = _pieces(nodes, marks)
    if separator is not None:
        w = Window.partitionBy("doc_id").orderBy("ord")
        turned = F.coalesce(F.lag("page").over(w) != F.col("page"), F.lit(False))
        out = out.withColumn("piece", F.when(turned, F.concat_ws("\n\n", F.lit(separator.strip("\n")), F.when(strip("piece") != "", F.col("piece")))).otherwise(F.col("piece")))
    docs = _ordered_join(out.where(strip("piece") != ""), "doc_id", "piece", "\n\n", "ord")
    every = nodes.select("doc_id").distinct().join(docs, "doc_id", "left")
    return every.select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n")).alias("text"))


def render_text(nodes: DataFrame, separator: str | None = None) -> DataFrame:
    """As ``render_markdown`` without heading marks."""
    return render_markdown(nodes, separator, marks=False)


def escape_html(c: str | Column) -> Column:
    """``& < > " '`` as character references."""
    out = F.col(c) if isinstance(c, str) else c
    for sign, to in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(sign), F.lit(to))
    return out


def render_html(nodes: DataFrame, title: str = "") -> DataFrame:
    """(doc_id, text): a plain HTML page of the nodes."""
    level = F.coalesce("level", F.lit(1)).cast("string")
    wrap = lambda tag, x: F.concat(F.lit(f"<{tag}>"), x, F.lit(f"</{tag}>"))
    items = F.array_join(F.transform("items", lambda x: wrap("li", escape_html(x))), "")
    rows = F.array_join(F.transform("grid", lambda r: wrap("tr", F.array_join(F.transform(r, lambda c: wrap("td", escape_html(c))), ""))), "\n")
    text = (
        F.when(F.col("type") == "heading", F.concat(F.lit("<h"), level, F.lit(">"), escape_html("content"), F.lit("</h"), level, F.lit(">")))
        .when(F.col("type") == "list", wrap("ul", items))
        .when(F.col("type") == "table", wrap("table", rows))
        .otherwise(wrap("p", escape_html("content")))
    )
    docs = _ordered_join(nodes.withColumn("piece", text).where("piece is not null"), "doc_id", "piece", "\n", "ord")
    head = F.concat(F.lit('<!DOCTYPE html>\n<html><head><meta charset="utf-8"><title>'), escape_html(F.lit(title)), F.lit("</title></head><body>\n"))
    return docs.select("doc_id", F.concat(head, F.col("text"), F.lit("\n</body></html>\n")).alias("text"))


def json_trees(nodes: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(doc_id, tree): the structure tree of each document as JSON."""
    cells = F.transform("grid", lambda r, i: F.struct((i + 1).alias("row number"), F.transform(r, lambda c, j: F.struct((i + 1).alias("row number"), (j + 1).alias("column number"), F.lit(1).alias("row span"), F.lit(1).alias("column span"), c.alias("content"))).alias("cells")))
    node = F.struct(
        "ord", F.struct(
            F.col("type"), F.col("level").alias("heading level"), F.col("page").alias("page number"), F.col("content"), F.when(F.col("items").isNotNull(), F.size("items")).alias("number of list items"),
            F.transform("items", lambda x: F.struct(F.lit("list item").alias("type"), F.col("page").alias("page number"), x.alias("content"))).alias("list items"),
            F.when(F.col("grid").isNotNull(), F.size("grid")).alias("number of rows"), F.when(F.col("grid").isNotNull(), F.size(F.col("grid")[0])).alias("number of columns"), cells.alias("rows"),
        ).alias("node"),
    )
    docs = nodes.groupBy("doc_id").agg(F.max("page").alias("pages"), F.sort_array(F.collect_list(F.struct("ord", F.to_json(node["node"]).alias("j")))).alias("kids"))
    kids = F.concat(F.lit("["), F.array_join(F.transform("kids", lambda x: x["j"]), ","), F.lit("]"))
    out = docs.join(names, "doc_id", "left") if names is not None else docs.withColumn("name", F.col("doc_id").cast("string"))
    return out.select("doc_id", F.concat(F.lit('{"file name":'), F.to_json(F.array("name")).substr(F.lit(2), F.length(F.to_json(F.array("name"))) - 2), F.lit(',"number of pages":'), F.greatest("pages", F.lit(1)).cast("string"), F.lit(',"kids":'), kids, F.lit("}")).alias("tree"))


def merged(texts: DataFrame, title: str = "title", body: str = "text", order: str = "doc_id") -> DataFrame:
    """One text of all documents: a table of contents, then each under a heading of level 1.

    One value in one task, for small sets; ``write_merged`` writes the same bytes as files for sets of any size.
    """
    parts = merged_parts(texts, title, body, order)
    both = parts.select(F.lit(0).alias("part"), F.col("n"), F.col("entry").alias("piece"), F.lit("\n").alias("g")).unionByName(parts.select(F.lit(1).alias("part"), "n", F.col("section").alias("piece"), F.lit("\n\n").alias("g")))
    return both.groupBy().agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "n", "piece", "g"))), lambda x: F.concat(x["piece"], x["g"])), "").alias("text"))


def merged_parts(texts: DataFrame, title: str = "title", body: str = "text", order: str = "doc_id") -> DataFrame:
    """(n, entry, section): the lines of contents and the sections that ``merged`` joins."""
    anchor = F.concat(F.lit("doc-"), F.col(order).cast("string"))
    deeper = F.regexp_replace(body, r"(?m)^(#{1,5}) ", "#$1 ")
    return texts.select(
        F.col(order).alias("n"), F.concat(F.lit("- ["), F.col(title), F.lit("](#"), anchor, F.lit(")")).alias("entry"),
        F.concat(F.lit('<a id="'), anchor, F.lit('"></a>\n\n# '), F.col(title), F.lit("\n\n"), strip(deeper)).alias("section"),
    )


def merged_lines(texts: DataFrame, title: str = "title", body: str = "text", order: str = "doc_id") -> DataFrame:
    """(part, n, piece, at, bytes): what ``merged`` joins, in order, with the byte where each piece starts.

    The pieces stand in range partitions, so the sums of bytes need no task that sees them all.
    """
    parts = merged_parts(texts, title, body, order)
    lines = parts.select(F.lit(0).alias("part"), "n", F.concat("entry", F.lit("\n")).alias("piece")).unionByName(parts.select(F.lit(1).alias("part"), "n", F.concat("section", F.lit("\n\n")).alias("piece")))
    return prefix_sums(lines.withColumn("bytes", F.octet_length("piece").cast("long")), (), ("part", "n"), F.col("bytes"), "at")


def write_merged(texts: DataFrame, path: str, title: str = "title", body: str = "text", order: str = "doc_id", files: int | None = None) -> DataFrame:
    """Write ``merged`` as text files whose names are in reading order; put end to end they are its bytes.

    Gives the index of the pieces (part, n, at, bytes), so that one document's section can be read alone.
    """
    lines = merged_lines(texts, title, body, order)
    spread = lines.repartitionByRange(files, "part", "n") if files else lines.repartitionByRange("part", "n")
    # the sink ends each record with the line break that every piece ends with
    spread.sortWithinPartitions("part", "n").select(F.substring("piece", F.lit(1), F.length("piece") - 1).alias("value")).write.option("lineSep", "\n").text(path)
    return lines.select("part", "n", "at", "bytes")


def page_fallback(pages: DataFrame, separator: str = SEPARATOR) -> DataFrame:
    """(doc_id, text) of plain page texts, a separator before each page but the first."""
    w = Window.partitionBy("doc_id").orderBy("page")
    piece = F.when(F.row_number().over(w) > 1, F.concat(F.lit(separator.strip("\n")), F.lit("\n\n"), strip("text"))).otherwise(strip("text"))
    return _ordered_join(pages.withColumn("piece", piece), "doc_id", "piece", "\n\n", "page")


def table_cells(nodes: DataFrame) -> DataFrame:
    """(doc_id, table, page, r, c, content): the cells of all tables, numbered from 1."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    tables = nodes.where("type = 'table'").withColumn("table", F.row_number().over(w))
    rows = tables.select("doc_id", "table", "page", F.posexplode("grid").alias("r", "row"))
    return rows.select("doc_id", "table", "page", (F.col("r") + 1).alias("r"), F.posexplode("row").alias("c", "content")).withColumn("c", F.col("c") + 1)


def cells_to_grid(cells: DataFrame, by: tuple[str, ...] = ("doc_id", "table")) -> DataFrame:
    """Dense grids of (r, c, content) cells; a spanning cell stands at its anchor only."""
    size = cells.groupBy(*by).agg(F.max("r").alias("n_r"), F.max("c").alias("n_c"), F.map_from_entries(F.collect_list(F.struct(F.struct("r", "c"), F.col("content")))).alias("m"))
    row = lambda r: F.transform(F.sequence(F.lit(1), F.col("n_c")), lambda c: F.coalesce(F.element_at("m", F.struct(r.cast("int").alias("r"), c.cast("int").alias("c"))), F.lit("")))
    return size.select(*by, F.transform(F.sequence(F.lit(1), F.col("n_r")), row).alias("grid"))


def csv_lines(nodes: DataFrame) -> DataFrame:
    """(doc_id, table, page, r, line): rows of all tables as CSV lines."""
    quote = lambda c: F.when(c.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    w = Window.partitionBy("doc_id").orderBy("ord")
    tables = nodes.where("type = 'table'").withColumn("table", F.row_number().over(w))
    return tables.select("doc_id", "table", "page", F.posexplode("grid").alias("r", "row")).select("doc_id", "table", "page", (F.col("r") + 1).alias("r"), F.array_join(F.transform("row", quote), ",").alias("line"))
