"""Reading-order blocks and what windows over them give: paths, sections, outlines.

A block row is (doc_id, ord, kind, level, page, text). ``ord`` orders a document; nothing
depends on the order of rows in a partition. All windows here share one partitioning by
document, so a document is shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.text import estimate_tokens, snippet, strip

LEVELS = range(1, 7)
MOST_SECTIONS, LISTED_SECTIONS = 3, 20


def grid_markdown(grid: str | Column) -> Column:
    """A grid of cells as a Markdown table whose first row is the header."""
    grid = F.col(grid) if isinstance(grid, str) else grid
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: F.replace(c, F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size(grid[0])))
    lines = F.transform(grid, line)
    return F.when(F.size(grid) > 0, F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.greatest(F.size(grid) - 1, F.lit(0)))), "\n"))


def flatten(nodes: DataFrame) -> DataFrame:
    """Blocks of node rows: list items one by one, tables as Markdown, the rest as text."""
    kind = F.when(F.col("type") == "heading", "heading").when(F.col("type") == "table", "table").otherwise("text")
    parts = F.when(F.col("type") == "list", F.transform("items", lambda x: F.concat(F.lit("- "), strip(x)))).when(F.col("type") == "table", F.array(grid_markdown("grid"))).otherwise(F.array(strip("content")))
    out = nodes.select("doc_id", "ord", kind.alias("kind"), F.when(kind == "heading", F.greatest(F.coalesce("level", F.lit(1)), F.lit(1))).alias("level"), "page", F.posexplode(parts).alias("k", "text"))
    out = out.where("text is not null and text not in ('', '-', '- ')")
    return out.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord", "k")).cast("int")).drop("k")


def line_blocks(docs: DataFrame, id_col: str = "doc_id", text: str = "text", page: int = 1) -> DataFrame:
    """The lines of plain texts as blocks; empty ones are left out."""
    lines = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text, "\n")).alias("ord", "text"))
    return lines.where("text <> ''").select("doc_id", (F.col("ord") + 1).alias("ord"), F.lit("text").alias("kind"), F.lit(None).cast("int").alias("level"), F.lit(page).alias("page"), "text")


def with_path(blocks: DataFrame, by: str = "doc_id") -> DataFrame:
    """``path``: the headings above each block, the block itself included.

    The last heading of a level counts if it stands after the last one of every level above.
    """
    upto = Window.partitionBy(by).orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    level = F.least(F.col("level"), F.lit(max(LEVELS)))
    last = {k: F.max(F.when((F.col("kind") == "heading") & (level == k), F.struct("ord", "text"))).over(upto) for k in LEVELS}
    out = blocks.withColumns({f"_h{k}": v for k, v in last.items()})
    steps = []
    for k in LEVELS:
        above = [F.coalesce(F.col(f"_h{j}.ord"), F.lit(-1)) for j in range(1, k)]
        highest = F.greatest(*above) if len(above) > 1 else (above[0] if above else F.lit(-1))
        steps.append(F.when(F.col(f"_h{k}.ord") > highest, F.col(f"_h{k}.text")))
    return out.withColumn("path", F.array_compact(F.array(*steps))).drop(*(f"_h{k}" for k in LEVELS))


def with_sections(blocks: DataFrame, by: str = "doc_id") -> DataFrame:
    """``section_end`` (where a heading's section ends) and ``section_tokens``; null elsewhere."""
    whole = Window.partitionBy(by).orderBy("ord")
    after = whole.rowsBetween(1, Window.unboundedFollowing)
    tokens = estimate_tokens("text")
    out = blocks.withColumn("_sum", F.sum(tokens).over(whole.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    out = out.withColumn("_before", F.col("_sum") - tokens).withColumn("_last", F.max("ord").over(Window.partitionBy(by)) + 1).withColumn("_all", F.sum(tokens).over(Window.partitionBy(by)))
    level = F.least(F.col("level"), F.lit(max(LEVELS)))
    ends = {f"_e{k}": F.min(F.when((F.col("kind") == "heading") & (level <= k), F.struct("ord", "_before"))).over(after) for k in LEVELS}
    out = out.withColumns(ends)
    own, upto = F.lit(None).cast("int"), F.lit(None).cast("long")
    for k in LEVELS:
        own = F.when(level == k, F.coalesce(F.col(f"_e{k}.ord"), F.col("_last"))).otherwise(own)
        upto = F.when(level == k, F.coalesce(F.col(f"_e{k}._before"), F.col("_all"))).otherwise(upto)
    is_head = F.col("kind") == "heading"
    out = out.withColumn("section_end", F.when(is_head, own)).withColumn("section_tokens", F.when(is_head, upto - F.col("_before")))
    return out.drop("_sum", "_before", "_last", "_all", *ends)


def outline(blocks: DataFrame, by: str = "doc_id") -> DataFrame:
    """(doc_id, ord, level, title, page, tokens): headings with their sections' tokens.

    Text before the first heading is a row of level 0 without a title.
    """
    s = with_sections(blocks, by)
    heads = s.where("kind = 'heading'").select(by, "ord", "level", F.col("text").alias("title"), "page", F.col("section_tokens").alias("tokens"))
    first = Window.partitionBy(by).orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = blocks.withColumn("_n", F.sum((F.col("kind") == "heading").cast("int")).over(first)).where("_n = 0")
    preface = ahead.groupBy(by).agg(F.min("ord").alias("ord"), F.lit(0).alias("level"), F.lit(None).cast("string").alias("title"), F.min("page").alias("page"), F.sum(estimate_tokens("text")).alias("tokens"))
    return heads.unionByName(preface.select(*heads.columns))


def find_sections(blocks: DataFrame, name: str, by: str = "doc_id") -> DataFrame:
    """Headings that a name means: exact matches of a document replace its partial ones."""
    want = name.strip().lower()
    s = with_sections(blocks, by).where("kind = 'heading'")
    low = F.lower(strip("text"))
    s = s.where(F.contains(low, F.lit(want))).withColumn("exact", low == want)
    s = s.withColumn("_any", F.max("exact").over(Window.partitionBy(by))).where("exact or not _any")
    return s.select(by, "ord", "level", F.col("text").alias("title"), "page", "section_end", F.col("section_tokens").alias("tokens"), "exact")


def section_text(blocks: DataFrame, name: str, by: str = "doc_id") -> DataFrame:
    """All sections that a name means, as Markdown."""
    found = find_sections(blocks, name, by)
    f, b = found.alias("f"), blocks.alias("b")
    inside = f.join(b, (F.col(f"f.{by}") == F.col(f"b.{by}")) & (F.col("b.ord") >= F.col("f.ord")) & (F.col("b.ord") < F.col("f.section_end")))
    piece = F.when(F.col("b.kind") == "heading", F.concat(F.repeat(F.lit("#"), F.least(F.col("b.level"), F.lit(6))), F.lit(" "), F.col("b.text"))).otherwise(F.col("b.text"))
    out = inside.groupBy(F.col(f"f.{by}").alias(by), F.col("f.ord").alias("ord"), F.col("f.title").alias("title"), F.col("f.tokens").alias("tokens")).agg(
        F.min("b.page").alias("page"), F.max("b.page").alias("last_page"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("b.ord").alias("o"), piece.alias("t")))), lambda x: x["t"]), "\n\n").alias("markdown")
    )
    return out.select(by, "title", "page", "last_page", "tokens", "markdown")


def section_lookup(blocks: DataFrame, name: str, by: str = "doc_id") -> DataFrame:
    """``section_text`` as a reader asks for it; above MOST_SECTIONS only a list of them."""
    found = find_sections(blocks, name, by)
    if found.limit(MOST_SECTIONS + 1).count() <= MOST_SECTIONS:
        return section_text(blocks, name, by)
    listed = found.orderBy(by, "ord").limit(LISTED_SECTIONS)
    return listed.select(by, "title", "page", F.col("page").alias("last_page"), "tokens", F.lit(None).cast("string").alias("markdown"))


def search(blocks: DataFrame, query: str, limit: int = 10, by: str = "doc_id", order: str | None = None) -> DataFrame:
    """Blocks that hold every term, best first: score is the sum of occurrences.

    Ties keep document and block order. The result is a top-k of at most 50 rows.
    """
    terms = query.lower().split()
    if not terms:
        raise ValueError("empty query")
    low = F.lower("text")
    hit, score = F.lit(True), F.lit(0)
    for t in terms:
        hit = hit & F.contains(low, F.lit(t))
        score = score + ((F.length(low) - F.length(F.replace(low, F.lit(t), F.lit("")))) / len(t)).cast("int")
    found = blocks.where(hit).withColumn("score", score).withColumn("snippet", snippet("text", F.lit(terms[0])))
    cols = [c for c in (by, "ord", "page", "path", "score", "snippet") if c in found.columns]
    return found.orderBy(F.desc("score"), order or by, "ord").limit(min(max(limit, 1), 50)).select(*cols)
